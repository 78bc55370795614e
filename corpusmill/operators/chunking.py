"""Documents to chunks. Every strategy takes (id, text, ...) rows and gives a row per chunk with chunk_index, start_char, end_char and content.

Strategies that need only offsets are array expressions; those that fill chunks greedily from pieces read each document once in
an Arrow batch and find chunk borders by binary search over running lengths.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import strip, strip_lines, words
from corpusmill.workspace import Workspace, shuffle_partitions

DEFAULTS = {
    "document": {},
    "paragraph": {"min_size": 50},
    "fixed": {"size": 1000, "overlap": 100, "min_size": 50},
    "recursive": {"size": 1000, "overlap": 200, "min_size": 100},
    "semantic": {"size": 1000, "overlap": 200, "min_size": 100},
    "late": {"size": 512, "min_size": 50},
    "raptor": {"size": 1000, "min_size": 50},
}


def whole_documents(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.filter(F.length(text) > 0).withColumns({"chunk_index": F.lit(0), "start_char": F.lit(0), "end_char": F.length(text), "content": F.col(text)})


def fixed_windows(df: DataFrame, id_col: str, text: str, size: int = 1000, overlap: int = 100, min_size: int = 50) -> DataFrame:
    """Windows of ``size`` characters every size - overlap; short ones are dropped unless they touch the end."""
    step = size - overlap if size > overlap else size
    n = F.length(text)
    windows = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda at: F.struct(at.alias("start_char"), F.least(at + size, n).alias("end_char"), strip(F.substring(F.col(text), at + 1, F.lit(size))).alias("content")))
    kept = F.filter(windows, lambda w: (F.length(w["content"]) >= min_size) | (w["end_char"] == n))
    return df.filter(n > 0).select("*", F.posexplode(kept).alias("chunk_index", "__w")).select("*", "__w.*").drop("__w")


def paragraphs(df: DataFrame, id_col: str, text: str, min_size: int = 50) -> DataFrame:
    """Blocks between blank lines, with their true offsets."""
    parts = F.split(text, "\n\n")
    # Running offsets inside the row: each part starts two characters after the one before.
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda done, p: F.concat(done, F.array(F.element_at(done, -1) + F.length(p) + 2)))

    def block(p: Column, at: Column) -> Column:
        start = at + F.length(p) - F.length(F.regexp_replace(p, r"(?U)^\s+", ""))
        return F.struct(strip(p).alias("content"), start.alias("start_char"), (start + F.length(strip(p))).alias("end_char"))

    kept = F.filter(F.zip_with(parts, F.slice(ends, F.lit(1), F.size(parts)), block), lambda w: (F.length(w["content"]) > 0) & (F.length(w["content"]) >= min_size))
    return df.filter(F.col(text).isNotNull()).select("*", F.posexplode(kept).alias("chunk_index", "__w")).select("*", "__w.*").drop("__w")


def overlapped(splits: DataFrame, id_col: str, order_col: str, split_col: str, overlap: int, min_size: int = 0) -> DataFrame:
    """Each split behind the tail of the one before; positions run over splits and one joint each."""
    w = Window.partitionBy(id_col).orderBy(order_col)
    tail = F.coalesce(F.expr(f"right({split_col}, {overlap})"), F.lit("")) if overlap else F.lit("")
    rows = splits.withColumns({"pos": F.coalesce(F.sum(F.length(split_col) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "before": F.lag(split_col).over(w), "nth": F.row_number().over(w) - 1})
    tail = F.expr(f"right(before, {overlap})") if overlap else F.lit("")
    rows = rows.withColumn("tail", F.when(F.col("before").isNotNull(), tail).otherwise(F.lit("")))
    joined = F.when(F.col("tail") != "", F.concat("tail", F.lit(" "), split_col)).otherwise(F.col(split_col))
    rows = rows.withColumns({"content": strip(joined), "start_char": F.when(F.col("tail") != "", F.greatest(F.lit(0), F.col("pos") - F.length("tail") - 1)).otherwise(F.col("pos")), "end_char": F.col("pos") + F.length(split_col), "chunk_index": F.col("nth")})
    return rows.filter(F.length("content") >= min_size).drop("pos", "before", "nth", "tail")


def sections(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Markdown headings: level, title, 1-based line."""
    rows = df.select(id_col, F.posexplode(F.split(text, "\n")).alias("at", "line")).filter(F.col("line").startswith("#"))
    rows = rows.select(id_col, F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), strip(F.regexp_extract("line", "(?s)^#+(.*)$", 1)).alias("title"), (F.col("at") + 1).alias("line_number"))
    return rows.filter("title <> ''")


def text_stats(text: str) -> dict[str, Column]:
    lines = F.split(text, "\n")
    return {"line_count": F.size(lines), "empty_line_count": F.size(F.filter(lines, lambda x: strip(x) == "")), "word_count": F.size(words(F.col(text))), "char_count": F.length(text)}


# Greedy strategies ------------------------------------------------------------------------------------------------


def greedy_runs(lengths: list[int], joint: int, limit: int, first_limit: int | None = None, skip_empty: bool = False) -> list[tuple[int, int]]:
    """Runs [a, b) of pieces, each as long as fits: the sum of lengths plus ``joint`` between pieces is at most ``limit`` (``first_limit`` in the first), a run has a piece at least. With ``skip_empty`` a run begins at a piece that is not empty."""
    ends = np.cumsum(np.asarray(lengths, "i8") + joint)
    begins = np.flatnonzero(np.asarray(lengths, "i8") > 0)
    runs, a = [], 0
    while a < len(lengths):
        if skip_empty:
            at = int(np.searchsorted(begins, a))
            if at == len(begins):
                break
            a = int(begins[at])
        base, most = int(ends[a - 1]) if a else 0, limit if runs or first_limit is None else first_limit
        b = max(a + 1, int(np.searchsorted(ends, base + most + joint, "right")))
        runs.append((a, b))
        a = b
    return runs


def recursive_splits(text: str, separators: tuple[str, ...], size: int, keep_separators: bool = False) -> list[str]:
    """Pieces under ``size`` by the first separator the text has, gathered greedily; longer ones are split by later separators."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    cut = separators[at]
    rest = separators[at + 1 :] if cut else ()
    pieces, glue = (text.split(cut) if cut else list(text)), cut if keep_separators else ""
    out: list[str] = []
    long = [i for i, p in enumerate(pieces) if len(p) >= size]
    for a, b in zip([-1, *long], [*long, len(pieces)]):
        if a >= 0:
            out += recursive_splits(pieces[a], rest, size, keep_separators) if rest else [pieces[a]]
        run = pieces[a + 1 : b]
        out += [glue.join(run[x:y]) for x, y in greedy_runs([len(p) for p in run], len(glue), size)]
    return out


SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
SPAN_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\n+")


def located(text: str, parts: list[str]) -> list[tuple[str, int, int]]:
    out, at = [], 0
    for part in parts:
        start = text.find(part, at)
        start = at if start < 0 else start
        at = start + len(part)
        out.append((part, start, at))
    return out


def semantic_chunks(text: str, size: int, overlap: int, short: int = 20) -> list[tuple[str, int, int, int]]:
    """(content, start, end, sentences). Sentences under ``short`` join the next; a chunk opens with as many last sentences of the one before as fit the overlap."""
    found = located(text, [s for p in SENTENCE_END.split(text) if (s := p.strip())])
    units: list[list] = []
    for s, a, b in found:
        if units and len(units[-1][0]) < short:
            units[-1] = [f"{units[-1][0]} {s}", units[-1][1], b]
        else:
            units.append([s, a, b])
    out, first, total = [], 0, 0
    for i, (s, _, _) in enumerate(units):
        wider = total + len(s) + (i > first)
        if wider > size and i > first:
            out.append((first, i))
            back, room = i, overlap
            while overlap > 0 and back > first and len(units[back - 1][0]) <= room:
                back -= 1
                room -= len(units[back][0]) + 1
            first = back
            wider = sum(len(u[0]) for u in units[first : i + 1]) + i - first
        total = wider
    if units:
        out.append((first, len(units)))
    return [(" ".join(u[0] for u in units[a:b]), units[a][1], units[b - 1][2], b - a) for a, b in out]


def late_spans(text: str, size: int) -> list[tuple[str, int, int, int]]:
    """(content, start, end, nth). Joined spaces aren't counted against ``size``; spans beyond it are cut at words, the first part of such a span a character earlier."""
    spans: list[str] = []
    held = ""
    for part in (p for p in SPAN_END.split(text) if p.strip()):
        if len(held) + len(part) <= size:
            held = f"{held} {part}".strip() if held else part
            continue
        if held:
            spans.append(held)
        held = part if len(part) <= size else ""
        if not held:
            tokens = part.split()
            spans += [" ".join(tokens[a:b]) for a, b in greedy_runs([len(t) for t in tokens], 1, size, size - 1)]
    spans += [held] if held else []
    placed = located(text, [s.strip() for s in spans if s.strip()])
    numbers = [i for i, s in enumerate(spans) if s.strip()]
    return [(s, a, b, i) for (s, a, b), i in zip(placed, numbers)]


def raptor_leaves(text: str, size: int) -> list[tuple[str, int, int]]:
    """Leaves of a summary tree: pieces of the first separator the text has, gathered with it up to ``size``."""
    if len(text) <= size:
        parts = [text] if text.strip() else []
    else:
        cut = next((s for s in ("\n\n", "\n", ". ", " ") if s in text), None)
        if cut is None:
            parts = [text[i : i + size] for i in range(0, len(text), size)]
        else:
            pieces = text.split(cut)
            parts = [cut.join(pieces[a:b]) for a, b in greedy_runs([len(p) for p in pieces], len(cut), size, skip_empty=True)]
    return [(s.strip(), a, b) for s, a, b in located(text, parts)]


#: Documents whose pieces a task holds in Python.
DOCUMENTS_AT_ONCE = 128


def per_document(df: DataFrame, id_col: str, text: str, split: Callable[[str], list[tuple]], extra: str = "") -> DataFrame:
    """A row per tuple that ``split`` gives for a document: (content, start_char, end_char, *extra)."""
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())] + ([T.StructField(extra, T.IntegerType())] if extra else []))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # A few documents at a time, so that not all pieces of a batch are held at once.
            for first in range(0, len(whole), DOCUMENTS_AT_ONCE):
                batch = whole.slice(first, DOCUMENTS_AT_ONCE)
                ids, rows = batch.column(0), []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    rows += [(i, k, *row) for k, row in enumerate(split(t))] if t else []
                if rows:
                    at, *columns = zip(*rows)
                    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return df.select(id_col, strip_lines(F.col(text)).alias(text)).mapInArrow(run, schema)


def recursive(df: DataFrame, id_col: str, text: str, size: int = 1000, overlap: int = 200, min_size: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", " ", ""), keep_separators: bool = False) -> DataFrame:
    splits = per_document(df, id_col, text, lambda t: [(s, 0, 0) for s in recursive_splits(t, separators, size, keep_separators)]).select(id_col, F.col("chunk_index").alias("at"), F.col("content").alias("split"))
    return overlapped(splits, id_col, "at", "split", overlap, min_size).drop("at", "split")


def semantic(df: DataFrame, id_col: str, text: str, size: int = 1000, overlap: int = 200, min_size: int = 100) -> DataFrame:
    return per_document(df, id_col, text, lambda t: semantic_chunks(t, size, overlap), "sentence_count").filter(F.length("content") >= min_size)


def late(df: DataFrame, id_col: str, text: str, size: int = 512, min_size: int = 50) -> DataFrame:
    rows = per_document(df, id_col, text, lambda t: late_spans(t, size), "nth").withColumn("chunk_index", F.col("nth")).drop("nth")
    return rows.filter(F.length("content") >= min_size).withColumns({"span_start_token": F.floor(F.col("start_char") / 4), "span_end_token": F.floor(F.col("end_char") / 4)})


def raptor(df: DataFrame, id_col: str, text: str, size: int = 1000, min_size: int = 0) -> DataFrame:
    rows = per_document(df, id_col, text, lambda t: raptor_leaves(t, size)).withColumn("tree_level", F.lit(0))
    return rows.filter(F.length("content") >= min_size)


#: Fixed value: what lies between the contents of a parent's children.
SEPARATOR = "\n\n---\n\n"


def raptor_parents(chunks: DataFrame, id_col: str, cluster_size: int = 5, cut: int = 8000, summarise: Callable[[Column], Column] = lambda c: F.substring(c, 1, 500), vec_col: str | None = None) -> DataFrame:
    """One level up: clusters of a document's chunks become parents, named by the hash of their children's hashes. Without vectors every ``cluster_size`` chunks are one; with them, documents of more chunks than that are clustered by k-means, clusters numbered as they first occur."""
    part = F.floor(F.col("chunk_index") / cluster_size).cast("int")
    if vec_col:
        found = cluster_chunks(chunks, id_col, vec_col, cluster_size)
        first = found.groupBy(id_col, "cluster").agg(F.min("chunk_index").alias("first"), F.count("*").alias("rows"))
        whole = Window.partitionBy(id_col)
        first = first.select(id_col, "cluster", (F.row_number().over(whole.orderBy("first")) - 1).alias("nth"), (F.sum("rows").over(whole) > cluster_size).alias("many"))
        chunks = chunks.join(found.join(first, [id_col, "cluster"]).select(id_col, "chunk_index", "nth", "many"), [id_col, "chunk_index"])
        part = F.when(F.col("many"), F.col("nth")).otherwise(part)
    # Of a parent's children all hashes are gathered, but only those contents that begin before the cut.
    chunks = chunks.withColumn("parent_index", part)
    start = F.sum(F.length("content") + F.lit(len(SEPARATOR))).over(Window.partitionBy(id_col, "parent_index").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.withColumn("shown", F.when(F.coalesce(start, F.lit(0)) < cut, F.col("content")))
    grouped = chunks.groupBy(id_col, "parent_index").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.md5("content").alias("hash"), "shown"))).alias("c"), F.max("tree_level").alias("level"))
    shown = F.array_join(F.filter(F.col("c.shown"), lambda x: x.isNotNull()), SEPARATOR)
    return grouped.select(id_col, F.col("parent_index").alias("chunk_index"), (F.col("level") + 1).alias("tree_level"), F.md5(F.array_join(F.col("c.hash"), "|")).alias("parent_id"), F.size("c").alias("children"), summarise(F.substring(shown, 1, cut)).alias("content"))


def raptor_tree(leaves: DataFrame, id_col: str, levels: int = 3, embed: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """Leaves and up to ``levels`` levels of parents; a document stops where one chunk is left. ``embed`` adds the column ``vec`` to a level, by which it is clustered."""
    ws = Workspace(leaves.sparkSession, "tree")
    out = level = leaves.select(id_col, "chunk_index", "tree_level", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("children"), "content")
    for _ in range(levels):
        many = Window.partitionBy(id_col)
        below = level.withColumn("n", F.count("*").over(many)).filter("n > 1")
        level = raptor_parents(ws.keep(embed(below), "below"), id_col, vec_col="vec", **options) if embed else raptor_parents(below, id_col, **options)
        level = ws.keep(level, "level")
        out = out.unionByName(level)
    return out


def ranked_chunks(chunks: DataFrame, id_col: str, run: int = 1024) -> DataFrame:
    """With the columns rank (from 0, by chunk_index) and n (chunks of the document), from counts of runs, so that no task sorts a whole document."""
    chunks = chunks.withColumn("__run", F.floor(F.col("chunk_index") / run))
    counts = chunks.groupBy(id_col, "__run").agg(F.count("*").alias("__rows"))
    whole = Window.partitionBy(id_col)
    before = F.sum("__rows").over(whole.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(id_col, "__run", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__rows").over(whole).alias("n"))
    nth = F.row_number().over(Window.partitionBy(id_col, "__run").orderBy("chunk_index")) - 1
    return chunks.join(counts, [id_col, "__run"]).withColumn("rank", nth + F.col("__before")).drop("__run", "__before")


def _nearest_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, ranks, clusters, distances = [], [], [], []
        for i, (rank, x, cluster, c) in enumerate(zip(*(batch.column(j) for j in range(1, 5)))):
            rank, x, cluster, c = (v.values.to_numpy(zero_copy_only=False) for v in (rank, x, cluster, c))
            x, c = x.reshape(len(rank), -1), c.reshape(len(cluster), -1)
            for r, v in zip(rank, x):
                d = ((v - c) ** 2).sum(1)
                at = d.argmin()
                keys.append(i), ranks.append(r), clusters.append(cluster[at]), distances.append(d[at])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(ranks, pa.int64()), pa.array(clusters, pa.int64()), pa.array(distances, pa.float64())], names=[batch.schema.names[0], "rank", "cluster", "d"])


def _assigned(points: DataFrame, centres: DataFrame, id_col: str, block: int) -> DataFrame:
    """id, rank, cluster: the nearest centre of each point, ties to the lowest. Blocks of points meet blocks of centres; a document of many points is dealt over salts of eight blocks."""
    p = points.groupBy(id_col, F.floor(F.col("rank") / block).alias("b")).agg(F.array_sort(F.collect_list(F.struct("rank", "x"))).alias("p"))
    p = p.select(id_col, F.floor(F.col("b") / 8).alias("salt"), F.col("p.rank").alias("ranks"), F.flatten("p.x").alias("xs"))
    c = centres.groupBy(id_col, F.floor(F.col("cluster") / block).alias("b"), "n").agg(F.array_sort(F.collect_list(F.struct("cluster", "x"))).alias("c"))
    c = c.select(id_col, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / (8 * block)))).alias("salt"), F.col("c.cluster").alias("clusters"), F.flatten("c.x").alias("cs"))
    schema = T.StructType([points.schema[id_col], T.StructField("rank", T.LongType()), T.StructField("cluster", T.LongType()), T.StructField("d", T.DoubleType())])
    near = p.join(c, [id_col, "salt"]).select(id_col, "ranks", "xs", "clusters", "cs").mapInArrow(_nearest_centres, schema)
    return near.groupBy(id_col, "rank").agg(F.min(F.struct("d", "cluster")).alias("near")).select(id_col, "rank", F.col("near.cluster").alias("cluster"))


def _means(points: DataFrame, id_col: str, block: int) -> DataFrame:
    """id, cluster, mean: sums of at most ``block`` points, then of those sums, in order of rank, so that reruns agree."""

    def total(c: str) -> Column:
        vectors = F.transform(F.array_sort(c), lambda v: v["x"])
        return F.aggregate(F.slice(vectors, 2, F.size(vectors)), vectors[0], lambda s, v: F.zip_with(s, v, lambda a, b: a + b))

    some = points.groupBy(id_col, "cluster", F.floor(F.col("rank") / block).alias("b")).agg(F.collect_list(F.struct("rank", "x")).alias("v"))
    some = some.select(id_col, "cluster", F.struct(F.col("b").alias("rank"), total("v").alias("x")).alias("s"), F.size("v").alias("rows"))
    every = some.groupBy(id_col, "cluster").agg(F.collect_list("s").alias("v"), F.sum("rows").alias("rows"))
    return every.select(id_col, "cluster", F.transform(total("v"), lambda a: a / F.col("rows")).alias("mean"))


#: Chunks, and numbers in their vectors, of a document that one task clusters in all its steps; longer ones go step by step, dealt in blocks.
WHOLE_CHUNKS, WHOLE_VALUES = 4096, 1 << 19


def _settled(x: np.ndarray, k: int, rounds: int, block: int) -> np.ndarray:
    """The cluster of each row of one document, with the steps and the order of sums of the dealt form."""
    if k == 1:
        return np.zeros(len(x), "i8")
    centres, own, at_once = x[:k], None, max(1, (1 << 18) // max(1, k * x.shape[1]))
    for _ in range(rounds):
        new = np.concatenate([((x[a : a + at_once, None] - centres) ** 2).sum(2).argmin(1) for a in range(0, len(x), at_once)])
        if own is not None and (new == own).all():
            break
        own, sums = new, np.zeros(k * x.shape[1])
        for a in range(0, len(x), block):
            at = own[a : a + block, None] * x.shape[1] + np.arange(x.shape[1])
            sums += np.bincount(at.ravel(), x[a : a + block].ravel(), len(sums))
        rows = np.bincount(own, minlength=k)[:, None]
        centres = np.where(rows > 0, sums.reshape(k, -1) / np.maximum(rows, 1), centres)
    return own


def _clusters_of_documents(cluster_size: int, rounds: int, block: int):
    """Rows id, rank, x in the order of id and rank: id, rank, cluster. One document waits at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, done = [], None, []

        def end() -> None:
            x = np.concatenate(held)
            done.append((name, _settled(x, max(1, len(x) // cluster_size), rounds, block)))
            held.clear()

        def told() -> pa.RecordBatch:
            ids = pa.concat_arrays([pa.repeat(i, len(own)) for i, own in done])
            ranks = np.concatenate([np.arange(len(own)) for _, own in done])
            own = np.concatenate([own for _, own in done])
            done.clear()
            return pa.RecordBatch.from_arrays([ids, pa.array(ranks, pa.int64()), pa.array(own, pa.int64())], names=[names[0], "rank", "cluster"])

        for batch in batches:
            names, ids, vectors = batch.schema.names, batch.column(0), batch.column(2)
            values, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            first = np.flatnonzero(batch.column(1).to_numpy() == 0).tolist()
            for a, b in zip([0, *first], [*first, len(batch)]):
                if a in first[:1] or a > 0:
                    if held:
                        end()
                    name = ids[a] if a < len(batch) else None
                if b > a:
                    held.append(values[offsets[a] : offsets[b]].reshape(b - a, -1).copy())
            if done:
                yield told()
        if held:
            end()
            yield told()

    return run


def cluster_chunks(chunks: DataFrame, id_col: str, vec_col: str, cluster_size: int = 5, rounds: int = 20, block: int = 256, whole: int = WHOLE_CHUNKS) -> DataFrame:
    """id, chunk_index, cluster: k-means of the chunk vectors of every document, k a ``cluster_size``-th of its chunks. Centres start as the first k chunks; ties go to the lowest cluster, an empty one keeps its centre. Steps go on for documents whose chunks still move, ``rounds`` at most. Vectors of a document have one length and no nulls. Documents of up to ``whole`` chunks are dealt by id and take all steps in one task; longer ones are clustered at once, blocks of their chunks over all tasks, with the same results."""
    ws = Workspace(chunks.sparkSession, "clusters")
    points = ranked_chunks(chunks.select(id_col, "chunk_index", F.col(vec_col).cast("array<double>").alias("x")), id_col)
    points = ws.keep(points, "points")
    short = (F.col("n") <= whole) & (F.col("n") * F.size("x") <= WHOLE_VALUES)
    dealt = points.filter(short).select(id_col, F.col("rank").cast("long").alias("rank"), "x").repartition(shuffle_partitions(chunks.sparkSession), id_col).sortWithinPartitions(id_col, "rank")
    schema = T.StructType([points.schema[id_col], T.StructField("rank", T.LongType()), T.StructField("cluster", T.LongType())])
    found = ws.keep(dealt.mapInArrow(_clusters_of_documents(cluster_size, rounds, block), schema), "found")
    long = points.filter(~short)
    if not long.isEmpty():
        found = found.unionByName(_clusters_by_steps(ws, long, id_col, cluster_size, rounds, block))
    return points.join(found, [id_col, "rank"]).select(id_col, F.col("chunk_index").cast("int").alias("chunk_index"), F.col("cluster").cast("int").alias("cluster"))


def _clusters_by_steps(ws: Workspace, points: DataFrame, id_col: str, cluster_size: int, rounds: int, block: int) -> DataFrame:
    """id, rank, cluster of documents of any length, all at once: a step is a written table."""
    moving = points
    k = F.greatest(F.lit(1), F.floor(F.col("n") / cluster_size))
    centres = points.filter(F.col("rank") < k).select(id_col, F.col("rank").cast("long").alias("cluster"), "x", "n")
    own, settled = None, []
    for _ in range(rounds):
        new = ws.keep(_assigned(moving, centres, id_col, block), "assigned")
        if own is not None:
            ids = ws.keep(new.join(own.withColumnRenamed("cluster", "was"), [id_col, "rank"]).filter("cluster <> was").select(id_col).distinct(), "moving")
            settled.append(new.join(ids, id_col, "left_anti"))
            if ids.isEmpty():
                break
            moving, new, centres = (d.join(ids, id_col, "left_semi") for d in (moving, new, centres))
        own = new
        means = _means(moving.join(own, [id_col, "rank"]), id_col, block)
        centres = ws.keep(centres.join(means, [id_col, "cluster"], "left").select(id_col, "cluster", F.coalesce("mean", "x").alias("x"), "n"), "centres")
    else:
        settled.append(own)
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return found.select(id_col, F.col("rank").cast("long").alias("rank"), "cluster")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"document": whole_documents, "paragraph": paragraphs, "fixed": fixed_windows, "recursive": recursive, "semantic": semantic, "late": late, "raptor": raptor}


def chunk(df: DataFrame, strategy: str, id_col: str, text: str, strict: bool = False, **options) -> DataFrame:
    """Dispatch with each strategy's defaults; an unknown name means recursive, or an error if ``strict``."""
    if strategy not in STRATEGIES and strict:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    name = strategy if strategy in STRATEGIES else "recursive"
    return STRATEGIES[name](df, id_col, text, **(DEFAULTS[name] | options))
