"""Operator 6: SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay code [23, 12, 7].
A word's keys are the codewords at distance 4 or less: one, or six for a word at distance 3 from the code. Any two words that
differ in at most two bits share a key. Of at most four differing bits, two of the three segments have at most two each, so
two fingerprints that link share a key of some pair of segments. Rows meet on that key and are compared in full.

The fingerprint of the query is that of the word shingles. Four bits of it are but a few percent of a text, so that texts just over a
similarity of 0.8 seldom link. ``drop_similar`` therefore takes fingerprints of the set of words, which an edit changes five times less
than the shingles, three of them with functions of their own; texts that link in any are candidates, whose shingles are then compared in full.
Of pairs at 0.80 to 0.85 it finds 0.94, over that 0.97 and more (measured on edited texts), and none below the similarity.

Equal fingerprints are one node. Inside a key's rows only a spanning forest of the links is sent on, never all pairs. Key groups
over ``block_rows`` are dealt again as pairs of blocks, each in a task of its own.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; a text of fewer words than a shingle is
one shingle; a very long text is hashed in parts; null ids come after all others; repeated rows and ids keep a row each; of a
component with ties in id one row stays, by its text and then its other columns; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.shared_regions import shingle_hashes, word_hashes
from corpusmill.operators.components import connected_components
from corpusmill.workspace import Workspace, shuffle_partitions

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, generator of the cyclic Golay code.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, A-Z lower-cased, words cut at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], "<u8")
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t or b"", shingle) for t in texts], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "h", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, h (a hash of the text), fp."""
    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col).alias("h"), F.col(text_col)).mapInArrow(_fingerprints(shingle), "doc_id long, h long, fp long")


@cache
def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high and low part of a word; the error of least weight of each syndrome; for errors of weight 3 the messages of the five weight-7 codewords that cover it (else -1)."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    high = np.array([syndrome(m << 11) for m in range(4096)], "i4")
    error = np.zeros(2048, "i4")
    bits = [1 << i for i in range(23)]
    near = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[i + 1 :]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[i + 1 :], i + 1) for c in bits[j + 1 :])]
    for e in near:
        error[syndrome(e)] = e
    codewords = (np.arange(4096, dtype="i4") << 11) | high
    sevens = codewords[np.bitwise_count(codewords) == 7]
    cover = np.full((2048, 5), -1, "i4")
    for s, e in enumerate(error):
        if int(e).bit_count() == 3:
            cover[s] = sevens[(sevens & e) == e] >> 11
    return high, error, cover


def segment_keys(words: np.ndarray) -> np.ndarray:
    """For 23-bit words, the messages (12 bits) of all codewords within distance 4: six columns, -1 where there are fewer."""
    high, error, cover = code_tables()
    s = high[words >> 11] ^ (words & 0x7FF)
    message = (words ^ error[s]) >> 11
    more = cover[s]
    return np.concatenate([message[:, None], np.where(more >= 0, message[:, None] ^ more, -1)], axis=1)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, key) for every pair of segments and every pair of their codewords."""
    parts = [segment_keys(((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype("i4")) for at, n in SEGMENTS]
    rows, keys = [], []
    for p, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = parts[i][:, :, None], parts[j][:, None, :]
        there = (a >= 0) & (b >= 0)
        key = (np.int64(p) << 24) | (a.astype("i8") << 12) | b
        rows.append(np.nonzero(there)[0])
        keys.append(key[there])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().view("u8")
        for at in range(0, len(fp), 2000):
            rows, keys = fuzzy_keys(fp[at : at + 2000])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at : at + 2000][rows].view("i8"))], names=["key", "fp"])


def _forest(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, inside one group of distinct fingerprints, all that are connected: a search that compares each node reached with those not reached yet."""
    left, a, b = fp, [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            close = np.bitwise_count(left ^ x) <= most
            if close.any():
                got = left[close]
                a.append(np.full(len(got), x))
                b.append(got)
                front.extend(got)
                left = left[~close]
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def group_links(keys: np.ndarray, fp: np.ndarray, most: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """keys sorted, fp distinct inside a key."""
    a, b = [fp[:0]], [fp[:0]]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, "i8")
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        x, y = _forest(fp[s : s + n], most)
        a.append(x)
        b.append(y)
    at = np.flatnonzero(np.repeat(sizes <= small, sizes))
    for lag in range(1, small):
        at = at[at + lag < len(keys)]
        at = at[keys[at] == keys[at + lag]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= most]
        a.append(fp[hit])
        b.append(fp[hit + lag])
    return np.concatenate(a), np.concatenate(b)


LINKS = "src long, dst long, late_key long"


def _linked(most: int, limit: int):
    """Rows come sorted by key. Groups up to ``limit`` are linked; rows of larger ones are handed on under late_key."""

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view("i8")), pa.array(pairs[:, 1].view("i8")), pa.nulls(len(pairs), pa.int64())], names=["src", "dst", "late_key"])

    def late(key: int, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fp.view("i8")), pa.nulls(len(fp), pa.int64()), pa.array(np.full(len(fp), key))], names=["src", "dst", "late_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fp, over = np.zeros(0, "i8"), np.zeros(0, "u8"), None
        for batch in batches:
            if not len(batch):
                continue
            keys, fp = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy().view("u8")])
            if over is not None:
                n = int(np.searchsorted(keys, over, "right"))
                if n:
                    yield late(over, fp[:n])
                keys, fp = keys[n:], fp[n:]
                if not len(keys):
                    continue
                over = None
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                a, b = group_links(keys[:cut], fp[:cut], most)
                if len(a):
                    yield links(a, b)
                keys, fp = keys[cut:], fp[cut:]
            if len(keys) > limit:
                over = int(keys[0])
                yield late(over, fp)
                keys, fp = keys[:0], fp[:0]
        if len(keys):
            a, b = group_links(keys, fp, most)
            if len(a):
                yield links(a, b)

    return run


def fingerprint_links(fps: DataFrame, most: int = 4, block_rows: int = 20_000, partitions: int | None = None) -> DataFrame:
    """fps: distinct fp. Links (src, dst) that connect all fingerprints connected by pairs of at most ``most`` (4 at most) differing bits."""
    if most > 4:
        raise ValueError("the segment keys hold for at most four differing bits")
    ws = Workspace(fps.sparkSession, "golay")
    n = partitions or shuffle_partitions(fps.sparkSession)
    found = ws.keep(fps.mapInArrow(_keyed, "key long, fp long").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_linked(most, block_rows), LINKS), "links")
    late = found.filter("late_key is not null").select(F.col("late_key").alias("key"), F.col("src").alias("fp"))
    sizes = late.groupBy("key").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") * 2 / block_rows).cast("long"))
    blocks = late.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "fp")
    again = pairs.repartition(n, "pair").sortWithinPartitions("pair").mapInArrow(_linked(most, 1 << 62), LINKS)
    return found.filter("late_key is null").select("src", "dst").unionByName(again.select("src", "dst")).distinct()


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """doc_id, h, fp, component_id: the smallest id reachable over links, the document itself included."""
    ws = Workspace(docs.sparkSession, "simhash")
    signed = ws.keep(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = ws.keep(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    parts = connected_components(fingerprint_links(nodes.select("fp"), most))
    named = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = ws.keep(named.join(smallest, "component").select("fp", "component_id"), "ids")
    return signed.join(ids, "fp").select("doc_id", "h", "fp", "component_id")


def fingerprint_components(docs: DataFrame, **options) -> DataFrame:
    return near_duplicate_components(docs, **options).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _mixed(x: np.ndarray, function: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15 + 2 * function * 0x1234567)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_fingerprints(text: bytes, functions: int) -> list[int]:
    """A SimHash of the set of words for each hash function; zero without words."""
    words = np.unique(word_hashes(text))
    if not len(words):
        return [0] * functions
    out = []
    for f in range(functions):
        h, ones = _mixed(words, f), np.zeros(64, "i8")
        for at in range(0, len(h), 8192):
            ones += np.unpackbits(h[at : at + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]))
    return out


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Distinct shingle hashes, sorted; of fewer words than a shingle all are one, of none there is none."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        words = word_hashes(text)
        h = shingle_hashes(text, len(words)) if len(words) else h
    return np.unique(h)


def _word_fingerprints(functions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [word_fingerprints(t.as_py() or b"", functions) for t in batch.column(3).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(fps, pa.list_(pa.int64()))], names=["h", "k", "doc_id", "fps"])

    return run


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingle_set(t.as_py() or b"", shingle).tobytes() for t in some.column(1).cast(pa.binary())], pa.binary())], names=["node", "set"])

    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both >= similarity * (len(x) + len(y) - both)
            if good.any():
                at = pa.array(np.flatnonzero(good))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["src", "dst"])

    return run


def _row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits of a row's id and text, never null."""
    parts = [F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").isNull(), F.col(f"`{text_col}`")]
    return [F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit(1), *parts).alias("k")]


def _banded(bands: int, rows: int):
    """A key of ``rows`` min-hashes for each band, and the bytes of the set; a set without shingles has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for node, cell, data in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)):
                own = np.frombuffer(data.as_buffer(), "u8")
                if not len(own):
                    continue
                least = np.array([_mixed(own, f).min() for f in range(bands * rows)], "u8").reshape(bands, rows)
                mixed = least[:, 0]
                for r in range(1, rows):
                    mixed = _mixed(mixed, r) ^ least[:, r]
                parts.append((np.full(bands, node), np.full(bands, cell), np.arange(bands, dtype="i4"), mixed.view("i8"), np.full(bands, own.nbytes)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["node", "cell", "band", "key", "bytes"])

    return run


def alike_classes(sets: list[np.ndarray], classes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect all classes connected by alike sets of one group. Every set outside the greatest class meets all of other classes at once, by counts over the places of its values; one with too many values of its own is like none."""
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(value)
    row = np.repeat(np.arange(len(sets)), sizes)
    places, starts = row[np.argsort(value, kind="stable")], np.cumsum(often) - often
    names, root, members = np.unique(classes, return_inverse=True, return_counts=True)
    shared = np.bincount(row, weights=often[value] > 1, minlength=len(sets))
    out, left = [], len(names)
    for x in np.flatnonzero((root != members.argmax()) & (shared >= similarity * sizes)).tolist():
        if left == 1:
            break
        own = value[ends[x] - sizes[x] : ends[x]]
        n = often[own]
        at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(places[at], minlength=len(sets))
        good = (root != root[x]) & (np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x])) & (both >= similarity * (sizes + sizes[x] - both))
        for r in np.unique(root[good]).tolist():
            out.append((int(names[root[x]]), int(names[r])))
            root[root == r] = root[x]
            left -= 1
    return out


def _alike_classes(similarity: float):
    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), "u8") for x in group["set"]]
        found = alike_classes(sets, group["class"].to_numpy(), similarity)
        return pa.table({c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate(("src", "dst"))})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """src, dst of the pairs (a, b) whose sets are alike."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return met.mapInArrow(_alike(similarity), "src long, dst long")


#: Bytes of the sets of one group that a task holds; greater groups are dealt as pairs of blocks.
GROUP_BYTES = 16_000_000


def class_links(keys: DataFrame, sets: DataFrame, similarity: float, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """keys: node, cell, band, key, bytes, settled (a written table); sets: node, set. Links (src, dst) that connect all classes ``settled`` connected by alike sets that share a key of a band. A group's sets come once to the task that compares them, so its rows grow with its size and no pair is a row."""
    # A group with one class has nothing to tell; of groups with the same members one is enough.
    of = ["cell", "band", "key"]
    same = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in range(2)]
    groups = keys.groupBy(*of).agg(F.min("settled").alias("low"), F.max("settled").alias("high"), F.sum("bytes").alias("bytes"), F.count("*").alias("n"), *same).filter("low <> high")
    groups = groups.groupBy("cell", "n", "x0", "x1").agg(F.min(F.struct("band", "key", "bytes")).alias("one")).select("cell", "one.*")
    groups = groups.select(*of, F.when(F.col("bytes") <= group_bytes, 1).otherwise(F.ceil(F.col("bytes") * 2 / group_bytes)).cast("long").alias("blocks"))
    dealt = keys.join(groups, of).withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("node", F.col("settled").alias("class"), F.xxhash64(*of, F.least("own", "other"), F.greatest("own", "other")).alias("group"))
    return dealt.join(sets.select("node", "set"), "node").select("group", "class", "set").groupBy("group").applyInArrow(_alike_classes(similarity), "src long, dst long").distinct()


def _settled(ws: Workspace, sets: DataFrame, pairs: DataFrame, links: DataFrame, similarity: float, bands: int, rows: int) -> DataFrame:
    """node, component over links and over those found among texts whose candidates reach each other but that links leave apart: those that share a band of min-hashes are verified too. Equal sets stand for each other."""
    settled = ws.keep(connected_components(links), "settled")
    cells = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = cells.select("node", F.col("component").alias("cell")).join(settled.select("node", F.col("component").alias("settled")), "node", "left").withColumn("settled", F.coalesce("settled", "node"))
    named = ws.keep(named, "cells")
    apart = named.groupBy("cell").agg(F.min("settled").alias("low"), F.max("settled").alias("high")).filter("low <> high").select("cell")
    one = sets.filter("node = leader").select("node", "set")
    keys = one.join(named.join(apart, "cell", "left_semi").select("node", "cell"), "node").select("node", "cell", "set").mapInArrow(_banded(bands, rows), "node long, cell long, band int, key long, bytes long")
    keys = ws.keep(keys.join(named.select("node", "settled"), "node"), "bands")
    joined = ws.keep(class_links(keys, one, similarity), "joined")
    ws.drop(keys)
    if joined.isEmpty():
        return settled
    classes = connected_components(joined).select(F.col("node").alias("settled"), "component")
    return named.join(classes, "settled", "left").select("node", F.coalesce("component", "settled").alias("component"))


#: Rows of keys that are sent to every worker, 16 bytes each; where there are more, both sides meet in a shuffle.
FEW = 1_000_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, functions: int = 3, most: int = 4, bands: int = 20, band_rows: int = 4) -> DataFrame:
    """h, k (keys of a row's id and text), doc_id, rows (of these keys), component and stays: whether it is the smallest id of its component. Components are of verified links between candidates. Texts with equal shingles are linked by their digest; a text is verified against the first one of its own fingerprint and of those that link with it; where that leaves texts apart whose fingerprints reach each other, those that share a band of min-hashes are verified as well. Two texts at the similarity share none of the ``bands`` with a probability of (1 - similarity ** band_rows) ** bands, 3 in 100,000; those that do share one meet in one task, or in pairs of blocks of a large group."""
    ws = Workspace(docs.sparkSession, "similar")
    h, k = _row_keys(id_col, text_col)
    made = docs.select(h, k, F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_word_fingerprints(functions), "h long, k long, doc_id long, fps array<long>")
    nodes = made.groupBy("h", "k").agg(F.first("doc_id").alias("doc_id"), F.first("fps").alias("fps"), F.count("*").alias("rows"))
    nodes = ws.keep(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    pairs = None
    for f in range(functions):
        own = nodes.select("node", F.col("fps")[f].alias("fp"))
        first = ws.keep(own.groupBy("fp").agg(F.min("node").alias("first")), "first")
        links = fingerprint_links(first.select("fp"), most)
        ends = [first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in ("src", "dst")]
        across = links.join(ends[0], "src").join(ends[1], "dst").select(F.least("src_node", "dst_node").alias("a"), F.greatest("src_node", "dst_node").alias("b"))
        inside = own.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
        some = ws.keep(across.unionByName(inside), f"pairs{f}")
        pairs = some if pairs is None else pairs.unionByName(some)
    pairs = ws.keep(pairs.distinct(), "pairs")
    asked = ws.keep(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("h", "k", "node"), "asked")
    rows = docs.select(h, k, F.col(f"`{text_col}`").alias("text")).join(_few(asked, asked.count()), ["h", "k"]).select("node", "text")
    sets = rows.mapInArrow(_shingle_sets(shingle), "node long, set binary").dropDuplicates(["node"])
    sets = ws.keep(sets.withColumn("digest", F.sha2("set", 256)), "sets")
    leaders = sets.groupBy("digest").agg(F.min("node").alias("leader"))
    sets = ws.keep(sets.join(leaders, "digest").select("node", "leader", "set"), "led")
    same = sets.filter("node <> leader").select(F.col("leader").alias("src"), F.col("node").alias("dst"))
    led = [sets.select(F.col("node").alias(c), F.col("leader").alias(f"{c}_leader")) for c in "ab"]
    classes = ws.keep(pairs.join(led[0], "a").join(led[1], "b").select(F.least("a_leader", "b_leader").alias("a"), F.greatest("a_leader", "b_leader").alias("b")).distinct(), "classes")
    links = ws.keep(same.unionByName(_verified(classes.filter("a <> b"), sets, similarity)), "links")
    parts = ws.keep(_settled(ws, sets, pairs, links, similarity, bands, band_rows), "parts")
    ws.drop(sets, pairs)
    named = nodes.drop("fps").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least"))
    return named.join(least, "component").select("h", "k", "doc_id", "rows", "component", (F.col("least.node") == F.col("node")).alias("stays"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of texts whose word shingles are alike the one with the smallest id, with the columns of ``docs``; of rows equal in id and text the first by the other columns."""
    groups = Workspace(docs.sparkSession, "similar").keep(similar_groups(docs, id_col, text_col, **options), "groups")
    gone = groups.filter("not stays").select(F.col("h").alias("__h"), F.col("k").alias("__k"))
    twice = groups.filter("stays and rows > 1").select(F.col("h").alias("__h"), F.col("k").alias("__k"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    h, k = _row_keys(id_col, text_col)
    rows = docs.select(F.struct(*names).alias("__row"), h.alias("__h"), k.alias("__k"))
    rows = rows.join(_few(gone, gone.count()), ["__h", "__k"], "left_anti")
    repeated = twice.count()
    if repeated:
        single = rows.join(_few(twice, repeated), ["__h", "__k"], "left_anti")
        again = rows.join(_few(twice, repeated), ["__h", "__k"], "left_semi").withColumn("__all", F.xxhash64(*[F.col("__row")[c].cast("string") for c in docs.columns]))
        again = again.withColumn("__nth", F.row_number().over(Window.partitionBy("__h", "__k").orderBy("__all"))).filter("__nth = 1").select("__row", "__h", "__k")
        rows = single.unionByName(again)
    return rows.select("__row.*")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, **options) -> DataFrame:
    """The document with the smallest id of each component, with the columns of ``docs``."""
    groups = near_duplicate_components(docs, id_col, text_col, shingle, **options)
    stay = groups.filter("doc_id <=> component_id").groupBy("component_id").agg(F.min(F.struct("h", "doc_id")).alias("least")).select(F.col("least.h").alias("__h"), F.xxhash64(F.col("least.doc_id").isNull(), "least.doc_id").alias("__id"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    key = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(F.struct(*names).alias("__row"), F.xxhash64(f"`{text_col}`").alias("__h"), F.xxhash64(key.isNull(), key).alias("__id"), F.xxhash64(*[c.cast("string") for c in names]).alias("__all"))
    rows = rows.join(stay, ["__h", "__id"], "left_semi")
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__h", "__id").orderBy("__all"))).filter("__nth = 1").select("__row.*")
