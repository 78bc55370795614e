"""Operator 13: tokens of two tokenizers over the same text, aligned by diagonal run skipping.

Each token ends at a byte offset. Where both tokenizers end a token the text is cut into groups. The walk keeps an index shift between the two
arrays of ends: while one token meets one, the arrays agree at that shift, and stretches of one, two, four, ... more ends are compared at
once; where a stretch differs, halving finds how far it agrees, and all of it is jumped. A group that is not one to one is resolved end by
end, and leaves a new shift.

Links are the pairs of tokens whose byte ranges overlap. How many documents hold a pair linked is summed from the distinct pairs of each
document, counted in tasks before they are shuffled. The pairs come back to the documents twice over: the most frequent ones, at most ``sent``, are
sent to every worker; the others, each in few documents, meet their documents in a join.

Both encoders run once per distinct unit of a text (a split of the first tokenizer's own pattern; spaces with what follows them, which no piece of the
second crosses) and remember a bounded number of units. Texts of other characters than Latin letters and common signs, or with a unit that
doesn't come back byte for byte, go through the whole tokenizers.

Defined cases: texts that are null, empty or don't come back byte for byte have no tokens: zeros and an empty digest; special tokens in a text
are plain text; very long texts are aligned whole, in memory in proportion to the text; repeated rows and ids are rows, and documents, of their own; null ids stay; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokenize import byte_alphabet, slices
from corpusmill.workspace import Workspace

# Letters, numbers, white space and signs among which the byte-level tokenizer's pattern splits as below; it has other classes beyond them.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\x09-\x0D\x20"
PLAIN = re.compile("[\\x09-\\x0D\\x20-\\x7E\xa1-\xac\xae-\xff‐-‧‰-›]*")
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
RUNS = re.compile(" +[^ ]*")
BLANK = "▁"


class _Units(dict):
    """unit -> ids as bytes; None if its tokens aren't its bytes. Emptied when full, which costs time only."""

    def __init__(self, encode, sizes: list[bytes], limit: int = 500_000):
        self.encode, self.tokens, self.limit = encode, sizes, limit

    def __missing__(self, unit: str) -> bytes | None:
        ids = self.encode(unit)
        if len(self) > self.limit:
            self.clear()
        self[unit] = found = array("I", ids).tobytes() if b"".join([self.tokens[i] for i in ids]) == unit.encode() else None
        return found


class TokenPair:
    """Both tokenizers. ``encode(text)``: ids of each over space + text, None where either doesn't give its bytes."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet = byte_alphabet()
        back = {c: i for i, c in enumerate(alphabet)}
        n = self.a.get_vocab_size()
        self.a_tokens = [bytes(back.get(c, 0) for c in self.a.id_to_token(i)) for i in range(n)]
        self.b_tokens = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in ts], "i8") for ts in (self.a_tokens, self.b_tokens))
        # No piece goes on from another character into a space, so that spaces begin a unit.
        self.units = not any(b" " in t.lstrip(b" ") for t in self.b_tokens)
        model, blank = self.a.model, self.b.piece_to_id(BLANK)
        self.a_units = _Units(lambda u: [t.id for t in model.tokenize("".join([alphabet[x] for x in u.encode()]))], self.a_tokens)
        self.b_units = _Units(lambda u: self.b.encode(u[1:]) if len(u) > 1 else [blank], self.b_tokens)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        if not text:
            return None
        if self.units and PLAIN.fullmatch(text):
            spaced = " " + text
            runs = RUNS.findall(spaced) if "  " in spaced else [" " + w for w in text.split(" ")]
            try:
                return tuple(np.frombuffer(b"".join(map(units.__getitem__, parts)), "<u4") for units, parts in ((self.a_units, SPLIT.findall(spaced)), (self.b_units, runs)))
            except TypeError:  # a unit without ids
                pass
        return self.whole(text)

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        want = b" " + text.encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if any(b"".join([tokens[i] for i in ids]) != want for ids, tokens in ((a, self.a_tokens), (b, self.b_tokens))):
            return None
        return np.array(a, "<u4"), np.array(b, "<u4")


_pairs: dict[tuple[str, str], TokenPair] = {}


def token_pair(byte_level: str, pieces: str) -> TokenPair:
    """One of each Python worker and pair of files."""
    if (byte_level, pieces) not in _pairs:
        _pairs[byte_level, pieces] = TokenPair(byte_level, pieces)
    return _pairs[byte_level, pieces]


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two increasing arrays with the same last end: tokens before each group's end, of a and of b, and the links' token numbers, of a and of b."""
    kind, size = ("<u4", 4) if not len(ends_a) or ends_a[-1] < 1 << 32 else ("<u8", 8)
    raw_a, raw_b, a, b = ends_a.astype(kind).tobytes(), ends_b.astype(kind).tobytes(), ends_a.tolist(), ends_b.tolist()
    n, m, i, j = len(a), len(b), 0, 0
    # Links of irregular groups, and the last token of each; all other tokens are jumped, one to one.
    link_a, link_b, last_a, last_b = [], [], [], []
    while i < n:
        if a[i] == b[j]:
            # Ends agree at this shift for ``run`` tokens at least, up to those before x and y.
            run, x, y, left = 1, i + 1, j + 1, min(n - i, m - j)
            more = True
            while more and 2 * run <= left:
                more = raw_a[x * size : (x + run) * size] == raw_b[y * size : (y + run) * size]
                if more:
                    run, x, y = 2 * run, x + run, y + run
            step = run if more else run >> 1
            while step:
                if run + step <= left and raw_a[x * size : (x + step) * size] == raw_b[y * size : (y + step) * size]:
                    run, x, y = run + step, x + step, y + step
                step >>= 1
            i, j = x, y
        else:
            p, q = a[i], b[j]
            while True:
                link_a.append(i)
                link_b.append(j)
                if p < q:
                    i += 1
                    p = a[i]
                elif q < p:
                    j += 1
                    q = b[j]
                else:
                    break
            last_a.append(i)
            last_b.append(j)
            i += 1
            j += 1
    irregular = [np.array(x, "i8") for x in (link_a, link_b)]
    ends, links = [], []
    for total, own, last in ((n, irregular[0], last_a), (m, irregular[1], last_b)):
        jumped = np.ones(total, bool)
        jumped[own] = False
        links.append(np.concatenate([np.flatnonzero(jumped), own]))
        jumped[last] = True
        ends.append(np.flatnonzero(jumped) + 1)
    return *ends, *links


def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0 .. n - 1, padded with zero bytes."""
    width = len(str(max(0, n - 1)))
    return np.array([str(i) for i in range(n)], f"S{width}").view("u1").reshape(n, width)


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, digits_a: np.ndarray, digits_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    n, m, width = len(ids_a), len(ids_b), max(digits_a.shape[1], digits_b.shape[1])
    of_a, of_b = (np.repeat(np.arange(len(g)), np.diff(g, prepend=0)) for g in (group_a, group_b))
    at_a = np.arange(n) + np.concatenate([[0], group_b[:-1]])[of_a]
    at_b = np.arange(m) + group_a[of_b]
    out = np.zeros((n + m, width + 1), "u1")
    out[at_a, : digits_a.shape[1]] = digits_a[ids_a]
    out[at_b, : digits_b.shape[1]] = digits_b[ids_b]
    out[:, width] = ord(",")
    out[at_a[group_a - 1], width] = ord("|")
    out[at_b[group_b - 1], width] = ord(";")
    return out.tobytes().translate(None, b"\0")[:-1]


class Aligner:
    """Alignment of a text: ids of both tokenizers, group ends, distinct linked pairs (a * pieces + b) and how often each is linked."""

    def __init__(self, byte_level: str, pieces: str):
        self.pair = token_pair(byte_level, pieces)
        self.pieces = len(self.pair.b_tokens)
        self.digits = [_digits(len(t)) for t in (self.pair.a_tokens, self.pair.b_tokens)]

    def __call__(self, text: str | None):
        found = self.pair.encode(text)
        if found is None:
            return None
        a, b = found
        group_a, group_b, link_a, link_b = aligned(np.cumsum(self.pair.a_sizes[a]), np.cumsum(self.pair.b_sizes[b]))
        keys, times = np.unique(a[link_a].astype("u8") * np.uint64(self.pieces) + b[link_b], return_counts=True)
        return a, b, group_a, group_b, keys, times


def align_texts(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids and, for each group, the tokens of either before its end (a_ends, b_ends); null without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(byte_level, pieces)
        for batch in slices(batches, 200):
            rows = [align(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r and r[i].astype("i4") for r in rows], pa.list_(pa.int32())) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _digested(byte_level: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(byte_level, pieces)
        for batch in slices(batches, 500):
            numbers, digests, keys, times = [], [], [], []
            for text in batch.column(1):
                found = align(text.as_py())
                if found is None:
                    numbers.append((0, 0, 0, 0))
                    digests.append("")
                    keys.append(b"")
                    times.append(b"")
                    continue
                a, b, group_a, group_b, key, many = found
                numbers.append((len(a), len(b), len(group_a), int(many.sum())))
                digests.append(hashlib.sha256(groups_text(a, b, group_a, group_b, *align.digits)).hexdigest())
                keys.append(key.astype("<u8").tobytes())
                times.append(many.astype("<u4").tobytes())
            columns = [pa.array(c, pa.int64()) for c in np.array(numbers, "i8").reshape(-1, 4).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(keys, pa.binary()), pa.array(times, pa.binary())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"])

    return run


def _pair_counts(held: int):
    """Each document's pairs count once; sums of up to ``held`` pairs are made before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, n = np.zeros(0, "u8"), np.zeros(0, "i8"), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([keys, *waiting])
            weights = np.concatenate([counts, np.ones(len(every) - len(keys), "i8")])
            order = np.argsort(every, kind="stable")
            every, weights = every[order], weights[order]
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            return every[starts], np.add.reduceat(weights, starts)

        def rows() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000].astype("i8")), pa.array(counts[at : at + 50_000])], names=["pair", "n"])

        for batch in batches:
            for k in batch.column(0):
                waiting.append(np.frombuffer(k.as_buffer(), "<u8"))
                n += len(waiting[-1])
                if n >= held:
                    keys, counts = merged()
                    waiting, n = [], 0
                    if len(keys) >= held:
                        yield from rows()
                        keys, counts = keys[:0], counts[:0]
        if n:
            keys, counts = merged()
        yield from rows()

    return run


def _looked_up(table):
    """Sums over the pairs that were sent; the others as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = table.value
        for batch in slices(batches, 500):
            keys, times = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in ((6, "<u8"), (7, "<u4")))
            lengths = np.array([len(k) // 8 for k in batch.column(6).to_pylist()], "i8")
            row = np.repeat(np.arange(len(batch)), lengths)
            keys, times = keys.astype("i8"), times.astype("i8")
            at = np.minimum(np.searchsorted(pairs, keys), max(0, len(pairs) - 1))
            hit = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
            sums = []
            for values in (best, counts):
                total = np.zeros(len(batch), "i8")
                np.add.at(total, row[hit], times[hit] * (values[at[hit]] if len(pairs) else 0))
                sums.append(pa.array(total))
            left = ~hit
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[left], minlength=len(batch)))]).astype("i4"))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[left])) for x in (keys, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), *sums, *rest], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rest", "rest_times"])

    return run


def alignment_digest(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", sent: int = 1_000_000, held: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as any of its first token), count_sum (documents of each link's pair, over links), groups_sha256."""
    spark = docs.sparkSession
    ws = Workspace(spark, "alignment")
    made = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_digested(byte_level, pieces), DIGEST + ", keys binary, times binary")
    kept = ws.keep(made, "aligned", compression="zstd")
    n_pieces = len(token_pair(byte_level, pieces).b_tokens)
    counted = kept.select("keys").mapInArrow(_pair_counts(held), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {n_pieces}"))
    counted = ws.keep(counted, "pairs")
    most = counted.groupBy("a").agg(F.max("n").alias("most"))
    pairs = ws.keep(counted.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "counts")
    # Of the powers of two the least that leaves ``sent`` pairs at most; there are no more than 64.
    powers = sorted(((r["p"], r["pairs"]) for r in pairs.groupBy((F.length(F.bin("n")) - 1).alias("p")).agg(F.count("*").alias("pairs")).collect()), reverse=True)
    least, total = None, 0
    for p, n in powers:
        total += n
        if total > sent:
            break
        least = 1 << p
    few = pairs.filter(F.col("n") >= least).toArrow().sort_by("pair") if least else None
    table = spark.sparkContext.broadcast(tuple(few[c].to_numpy() for c in ("pair", "n", "best")) if few else tuple(np.zeros(0, "i8") for _ in range(3)))
    told = kept.mapInArrow(_looked_up(table), DIGEST + ", n_best long, count_sum long, rest array<long>, rest_times array<long>")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if total <= sent:
        return told.select(*columns)
    told = ws.keep(told.withColumn("row", F.monotonically_increasing_id()), "told", compression="zstd")
    rest = told.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("r")).select("row", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("times"))
    more = rest.join(pairs.filter(F.col("n") < least) if least else pairs, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    return told.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).select(*columns)
