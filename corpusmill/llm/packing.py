"""Operator 4: packing of token pieces into sequences by swap-based local search.

Pieces are dealt in turn into shards of bounded size. Each shard starts from its pieces as they come, a new sequence wherever the
next one doesn't fit, and then raises the sum of squared fills: the emptiest sequence gives its pieces to the others, as they are,
one for one, two for one or two for two, each time by the exchange that leaves the smallest gap, until it is empty and another is the emptiest.
What a shard leaves open is dealt again into fewer shards, level by level, down to one shard; only lengths and keys travel, never
texts.

The search ends at the lower bound (all tokens over the capacity), or when the ``tries`` emptiest sequences find no exchange, or after
``sweeps`` sweeps in which none fell empty: limits of effort, which leave gaps but no piece out. Levels end when one settles less than a tenth
of its pieces: documents of such lengths don't go together.

Defined cases: null or empty texts are one piece of the end id; longer documents are cut at the capacity, so a very long text is many
full pieces; repeated rows and null ids are packed as separate rows; pieces that tie in length are taken in order of their rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokenize import encoder, slices
from corpusmill.workspace import Workspace

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, step = encoder(path), array("I", [end_id]).tobytes(), 4 * capacity
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(text) + end
                rows += [(doc, k, at >> 2, len(ids[at : at + step]) >> 2, zlib.crc32(ids[at : at + step])) for k, at in enumerate(range(0, len(ids), step))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of each whole text, where the text lies: no shuffle."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_cut(tokenizer, end_id, capacity), PIECES)


def next_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Pieces as they come, a new sequence where one doesn't fit; full ones by themselves."""
    bins: list[list[int]] = []
    now, left = None, 0
    for i, n in enumerate(lengths):
        if n >= capacity:
            bins.append([i])
        elif n <= left:
            now.append(i)
            left -= n
        else:
            now, left = [i], capacity - n
            bins.append(now)
    return bins


def _sums(pieces: list[tuple[int, int]]) -> list[int]:
    """Distinct lengths and sums of two, sorted. Lengths of one sequence add up to its capacity, so that few of them are distinct."""
    counts: dict[int, int] = {}
    for n, _ in pieces:
        counts[n] = counts.get(n, 0) + 1
    one = sorted(counts)
    return sorted({*one, *(x + y for i, x in enumerate(one) for y in one[i + (counts[x] < 2) :])})


def _taken(pieces: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """One or two pieces of that size together."""
    at = bisect_left(pieces, (size, -1))
    if at < len(pieces) and pieces[at][0] == size:
        return [pieces[at]]
    for i, (n, _) in enumerate(pieces):
        j = bisect_left(pieces, (size - n, -1), i + 1)
        if j < len(pieces) and pieces[j][0] == size - n:
            return [pieces[i], pieces[j]]
    raise ValueError(size)


def _best_exchange(target_sums: list[int], sums: list[int], gap: int) -> tuple[int, int, int]:
    """The exchange that moves most tokens into a gap: (tokens, length of none, one or two that leave the target, length of one or two that come)."""
    best = (0, 0, 0)
    for out in (0, *target_sums):
        at = bisect_right(sums, out + gap)
        if at and sums[at - 1] - out > best[0]:
            best = (sums[at - 1] - out, out, sums[at - 1])
            if best[0] == gap:
                break
    return best


def local_search(lengths: list[int], bins: list[list[int]], capacity: int, tries: int = 32, sweeps: int = 300) -> list[list[int]]:
    """Empties sequences into the gaps of others; every exchange raises the sum of squared fills, for what gives is the emptiest of all."""
    least = -(-sum(lengths) // capacity)
    held = [sorted((lengths[i], i) for i in b) for b in bins]
    fill = [sum(n for n, _ in b) for b in held]
    known: list[list[int] | None] = [None] * len(bins)  # the sums of each sequence, until it changes
    count, stuck, idle = len(bins), set(), 0
    while count > least and len(stuck) < tries and idle < sweeps:
        open_bins = sorted((f, k) for k, f in enumerate(fill) if 0 < f < capacity)
        donor = next((k for _, k in open_bins if k not in stuck), None)
        if donor is None:
            break
        moved, gives = False, held[donor]
        sums = _sums(gives)
        for _, k in open_bins:
            if k == donor or fill[k] < fill[donor]:
                continue
            while gives and fill[k] < capacity:
                known[k] = known[k] or _sums(held[k])
                gain, out, into = _best_exchange(known[k], sums, capacity - fill[k])
                if not gain:
                    break
                known[k] = known[donor] = None
                leaving = _taken(held[k], out) if out else []
                for x in _taken(gives, into):
                    gives.remove(x)
                    insort(held[k], x)
                for x in leaving:
                    held[k].remove(x)
                    insort(gives, x)
                fill[k] += gain
                fill[donor] -= gain
                moved, sums = True, _sums(gives)
            if not gives:
                break
        idle += 1
        if moved:
            stuck.clear()
        else:
            stuck.add(donor)
        if not gives:
            count -= 1
            idle = 0
    return [[i for _, i in reversed(b)] for b in held if b]


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of positions in ``lengths``."""
    return local_search(lengths, next_fit(lengths, capacity), capacity)


def _pack_shard(level: int, capacity: int, open_below: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if len(b)]
        if not kept:
            return
        rows = pa.Table.from_batches(kept)
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows.column("length").to_pylist()
        sequence, offset, again = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8"), np.zeros(len(lengths), bool)
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        for k, members in enumerate(pack(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base | k, at
                at += lengths[i]
            again[members] = at < open_below * capacity
        yield from rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("again", pa.array(again)).to_batches(max_chunksize=10_000)

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 4096, shard_rows: int = 20_000, open_below: float = 0.99) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of doc_id, piece, start, length, ids_crc32. A shard holds about ``shard_rows`` rows; sequences filled to less than ``open_below`` are packed again."""
    ws = Workspace(pieces.sparkSession, "packing")
    left = ws.keep(pieces, "pieces")
    rows, level, done = left.count(), 0, []
    while True:
        shards = max(1, -(-rows // shard_rows))
        dealt = left.repartition(shards) if shards > 1 else left.coalesce(1)
        packed = ws.keep(dealt.mapInArrow(_pack_shard(level, capacity, open_below), f"{PIECES}, sequence_id long, offset long, again boolean"), f"level{level}")
        open_rows = packed.filter("again").count() if shards > 1 else 0
        last = open_rows == 0 or open_rows > 0.9 * rows
        done.append((packed if last else packed.filter("not again")).drop("again"))
        if last:
            break
        ws.drop(left) if level == 0 else None
        left, rows, level = packed.filter("again").select("doc_id", "piece", "start", "length", "ids_crc32"), open_rows, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    return pack_pieces(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), capacity, **options)
