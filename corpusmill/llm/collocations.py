"""Operator 12: phrases that occur together more than by chance, mined in two passes over mergeable Misra-Gries summaries.

First pass: every n-gram falls into one of many parts by its hash. Tasks send on counts of what they have seen, packed by part. Each
part (a range of hashes) is merged into a Misra-Gries summary whose capacity exceeds the part's mass (occurrences) over the threshold, so that what
all its decrements take from a count is below the threshold and every frequent n-gram survives. A part's memory is bounded by its
capacity; the number of parts grows with the corpus.

Second pass: n-grams that survive are counted exactly, as strings. The survivors' hashes go to the workers as a bitmap of a fixed size. What
passes it without having survived is counted too and falls below the threshold, so the bitmap's size touches time only.

Scores are integers and decimals throughout: (10^6 a a) div (l r) of 38 digits, exact for counts up to 10^15.

Defined cases: null, empty and blank texts have no words; null languages are ``und``; very long texts are counted in slices that overlap by the
words a phrase can reach back; repeated rows count as often as they are there; ties in score and count go by the phrase's bytes; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.workspace import Workspace, shuffle_partitions

#: A piece ends at these bytes, words at space and tab.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: No byte of UTF-8; stands for an end of a piece.
MARK = b"\xff"
_TABLE = bytes(0xFF if b in BREAKS else 0x20 if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Ids(dict):
    """Words numbered as they come; number 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def phrase_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words and the numbers of all, with 0 at the ends of pieces."""
    joined = MARK.join(t.translate(_TABLE) for t in texts).replace(MARK, b" \xff ")
    # Only blanks cut words: bytes that split() would take for white space besides have been marks or are none of them.
    ids = _Ids({MARK: 0})
    words = joined.split()
    numbers = np.fromiter(map(ids.__getitem__, words), "i8", len(words))
    return list(ids), numbers


def counted_phrases(ids: np.ndarray, n_words: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, word numbers of each distinct phrase, count) for sizes up to ``longest``; phrases never hold an end of a piece."""
    good = ids > 0
    # A phrase's key: the number of its first words (a row of ``names``), then the others, to the base n_words.
    key, names, span = ids, np.arange(n_words, dtype="i8")[:, None], n_words
    for size in range(1, longest + 1):
        if size > 1:
            if span * n_words >= 1 << 62:
                found, key = np.unique(key, return_inverse=True)
                names, span = _words_of(found, names, n_words, size - 1), len(found)
            good = good[:-1] & (ids[size - 1 :] > 0)
            key, span = key[:-1] * n_words + ids[size - 1 :], span * n_words
        found, count = np.unique(key[good], return_counts=True)
        if not len(found):
            return
        yield size, _words_of(found, names, n_words, size), count


def _words_of(keys: np.ndarray, names: np.ndarray, n_words: int, size: int) -> np.ndarray:
    last = []
    for _ in range(size - names.shape[1]):
        last.append(keys % n_words)
        keys = keys // n_words
    return np.column_stack([names[keys], *reversed(last)])


def phrase_hashes(word_hash: np.ndarray, own: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(len(own), np.uint64(seed * 2 + 1), "u8")
    for column in own.T:
        h = (h ^ word_hash[column]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _by_language(batches: Iterator[pa.RecordBatch], most: int, longest: int) -> Iterator[tuple[str, list[bytes], np.ndarray, int]]:
    """(language, words, numbers, words seen before) of slices of about ``most`` bytes. At most four times that wait, of all languages together. Longer texts are cut into slices that begin with the last words of the one before."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            text = text.as_py()
            if not text:
                continue
            if len(text) > most:
                yield from ((lang, *x) for x in _long_text(text, most, longest))
                continue
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            full = lang if sizes[lang] > most else max(sizes, key=sizes.get) if sum(sizes.values()) > 4 * most else None
            if full is not None:
                yield full, *phrase_words(held.pop(full)), 0
                del sizes[full]
    for lang, texts in held.items():
        yield lang, *phrase_words(texts), 0


def _long_text(text: bytes, most: int, longest: int) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """Slices of a text, cut at blanks or ends of pieces. Each begins with the last words of the one before, whose own phrases aren't counted again."""
    at, before = 0, []
    while at < len(text):
        end = min(len(text), at + most)
        while end < len(text) and text[end] not in BREAKS + BLANKS:
            end += 1
        part = text[at:end].translate(_TABLE).replace(MARK, b" \xff ").split()
        ids = _Ids({MARK: 0})
        numbers = np.fromiter(map(ids.__getitem__, before + part), "i8", len(before) + len(part))
        yield list(ids), numbers, len(before)
        before = (before + part)[-(longest - 1) :] if longest > 1 else []
        at = end


def _slice_counts(ids: np.ndarray, n_words: int, longest: int, again: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if not again:
        yield from counted_phrases(ids, n_words, longest)
        return
    # Phrases that lie in the first ``again`` words were counted with the slice before.
    old = {(size, tuple(o)): c for size, own, count in counted_phrases(ids[:again], n_words, longest) for o, c in zip(own.tolist(), count.tolist())}
    for size, own, count in counted_phrases(ids, n_words, longest):
        less = np.fromiter((old.get((size, tuple(o)), 0) for o in own.tolist()), "i8", len(own)) if any(s == size for s, _ in old) else 0
        left = count - less
        yield size, own[left > 0], left[left > 0]


def _parts(part_bits: int, longest: int, most: int, held: int):
    """Packed counts by part: part, mass, hashes (u8) and counts (i8) as bytes. Counts of up to ``held`` n-grams are added up before they are sent."""

    def packed(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        # Hashes come sorted, and a part is a range of them.
        part = (h >> np.uint64(64 - part_bits)).astype("i8")
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.concatenate([starts[1:], [len(part)]])
        small = c.max() < 1 << 32
        return pa.RecordBatch.from_arrays(
            [pa.array(part[starts]), pa.array(np.add.reduceat(c, starts)), pa.array([h[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([c[a:b].astype("<u4" if small else "<i8").tobytes() for a, b in zip(starts, ends)], pa.binary())],
            names=["part", "mass", "hashes", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, n = [], [], 0
        for lang, words, ids, again in _by_language(batches, most, longest):
            base = xxhash.xxh64_intdigest(lang.encode())
            word_hash = np.fromiter((xxhash.xxh64_intdigest(w, base) for w in words), "u8", len(words))
            for size, own, count in _slice_counts(ids, len(words), longest, again):
                hashes.append(phrase_hashes(word_hash, own, size))
                counts.append(count)
                n += len(count)
            if n >= held:
                h, c = summed(np.concatenate(hashes), np.concatenate(counts))
                hashes, counts, n = [h], [c], len(h)
                if n >= held // 2:
                    yield packed(h, c)
                    hashes, counts, n = [], [], 0
        if n:
            yield packed(*summed(np.concatenate(hashes), np.concatenate(counts)))

    return run


def summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return h, c
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[starts], np.add.reduceat(c, starts)


class Summary:
    """A Misra-Gries summary of at most ``capacity`` counters; ``add`` merges counts into it. Of each count it has lost ``lost`` at most, and lost * (capacity + 1) never exceeds the mass."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.h, self.c = np.zeros(0, "u8"), np.zeros(0, "i8")
        self._more: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def add(self, h: np.ndarray, c: np.ndarray) -> None:
        self._more.append((h, c))
        self._n += len(h)
        if self._n > max(100_000, self.capacity):
            self.settle()

    def settle(self) -> None:
        self.h, self.c = summed(np.concatenate([self.h, *(h for h, _ in self._more)]), np.concatenate([self.c, *(c for _, c in self._more)]))
        self._more, self._n = [], 0
        if len(self.h) > self.capacity:
            least = int(np.partition(self.c, len(self.c) - self.capacity - 1)[len(self.c) - self.capacity - 1])
            self.lost += least
            keep = self.c > least
            self.h, self.c = self.h[keep], self.c[keep] - least

    def possible(self, threshold: int) -> np.ndarray:
        """Those whose count can have been the threshold: what is left of it and what all decrements took."""
        self.settle()
        return self.h[self.c + self.lost >= threshold]


def _merged(threshold: int):
    """Rows of a part come together: (part, total, hashes, counts). One row a part: its survivors' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, None

        def done() -> pa.RecordBatch:
            h = summary.possible(threshold)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([h.tobytes()], pa.binary())], names=["part", "n", "hashes"])

        for batch in batches:
            for p, total, h, c in zip(*(batch.column(i) for i in range(4))):
                if p.as_py() != part:
                    if summary:
                        yield done()
                    part, summary = p.as_py(), Summary(total.as_py() // threshold + 1)
                h, c = np.frombuffer(h.as_buffer(), "u8"), c.as_buffer()
                summary.add(h, np.frombuffer(c, "<u4" if len(c) == 4 * len(h) else "<i8").astype("i8"))
        if summary:
            yield done()

    return run


def surviving_phrases(docs: DataFrame, threshold: int, longest: int, part_bits: int, slice_bytes: int = 1 << 20, held: int = 600_000) -> DataFrame:
    """docs: lang, text. part, n, hashes: of every part the n-grams that can be as frequent as the threshold."""
    packed = docs.mapInArrow(_parts(part_bits, longest, slice_bytes, held), "part long, mass long, hashes binary, counts binary")
    whole = packed.withColumn("total", F.sum("mass").over(Window.partitionBy("part"))).select("part", "total", "hashes", "counts")
    return whole.mapInArrow(_merged(threshold), "part long, n long, hashes binary")


def _bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in batch.column(0):
                at = (np.frombuffer(h.as_buffer(), "u8") >> np.uint64(64 - bits)).astype("i8")
                block = at >> 16
                for b in np.unique(block):
                    own = np.zeros(1 << 16, "u1")
                    own[at[block == b] & 0xFFFF] = 1
                    yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["block", "bits"])

    return run


def _or(rows: pa.Table) -> pa.Table:
    merged = functools.reduce(operator.or_, (np.frombuffer(b.as_buffer(), "u1") for b in rows["bits"]))
    return pa.table({"block": rows["block"][:1], "bits": pa.array([merged.tobytes()], pa.binary())})


def survivor_bitmap(survivors: DataFrame, bits: int = 27) -> np.ndarray:
    """2^bits bits (16 MB), set at the leading bits of the survivors' hashes. Of fixed size whatever the corpus: 8 KB blocks, made on the workers."""
    blocks = survivors.select("hashes").mapInArrow(_bits(bits), "block long, bits binary").groupBy("block").applyInArrow(_or, "block long, bits binary")
    out = np.zeros(1 << (bits - 3), "u1")
    for row in blocks.toLocalIterator():
        out[row["block"] << 13 : (row["block"] + 1) << 13] = np.frombuffer(row["bits"], "u1")
    return out


def _exact(bitmap, bits: int, longest: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = bitmap.value
        for lang, words, ids, again in _by_language(batches, most, longest):
            base = xxhash.xxh64_intdigest(lang.encode())
            word_hash = np.fromiter((xxhash.xxh64_intdigest(w, base) for w in words), "u8", len(words))
            yield _rows(lang, [b""], 0, np.array([int((ids[again:] > 0).sum())]))
            for size, own, count in _slice_counts(ids, len(words), longest, again):
                at = (phrase_hashes(word_hash, own, size) >> np.uint64(64 - bits)).astype("i8")
                hit = (there[at >> 3] >> (7 - (at & 7)).astype("u1")) & 1 > 0
                own, count = own[hit], count[hit]
                for i in range(0, len(own), 20_000):
                    yield _rows(lang, [b" ".join([words[w] for w in o]) for o in own[i : i + 20_000].tolist()], size, count[i : i + 20_000])

    def _rows(lang: str, phrases: list[bytes], size: int, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(phrases), size, "i4")), pa.array(count.astype("i8"))], names=["lang", "phrase", "size", "a"])

    return run


def frequent_phrases(docs: DataFrame, threshold: int = 10, longest: int = 3, part_bytes: int = 64 << 20, slice_bytes: int = 1 << 20, held: int = 600_000, bits: int = 27) -> DataFrame:
    """docs: lang, text. lang, phrase, size, a: every phrase of up to ``longest`` words with at least ``threshold`` occurrences, and one row of size 0 a language with all its words."""
    spark = docs.sparkSession
    ws = Workspace(spark, "phrases")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = max(6, math.ceil(math.log2(max(4 * shuffle_partitions(spark), size / part_bytes))))
    survivors = ws.keep(surviving_phrases(docs, threshold, longest, part_bits, slice_bytes, held), "survivors")
    bitmap = spark.sparkContext.broadcast(survivor_bitmap(survivors, bits))
    counts = docs.mapInArrow(_exact(bitmap, bits, longest, slice_bytes), "lang string, phrase string, size int, a long").groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a"))
    kept = ws.keep(counts.filter((F.col("a") >= threshold) | (F.col("size") == 0)), "counts")
    bitmap.unpersist()
    ws.drop(survivors)
    return kept


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = 10, longest: int = 3, covered: int = 50, top: int = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of 2 to ``longest`` words; one whose words lie in a longer phrase with ``covered`` percent of its occurrences is left out."""
    docs = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counts = frequent_phrases(docs, threshold, longest, **options)
    known = counts.filter("size > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("of"))
    found = counts.filter("size > 1")
    words = F.split("phrase", " ")
    joined = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    # Both parts of each cut meet their counts; of a phrase's cuts the one with the lowest score stays.
    cuts = found.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    scored = cuts.join(known.select("lang", F.col("part").alias("head"), F.col("of").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("part").alias("rest"), F.col("of").alias("r")), ["lang", "rest"])
    score = F.expr("(1000000 * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " ")))
    longer = found.filter("size > 2").select("lang", F.explode(F.array_distinct(F.flatten(inner))).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {covered} * a")
    ranked = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).filter(F.col("rank") <= top)
    n = counts.filter("size = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
