"""Operator 9: mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule goes to the source in whose share of [0, 1) the point frac(i * golden ratio) falls. Slots are ranked per
source; rank r takes block r of the source: its documents in hash order, laid end to end twice and cut into blocks of equal
tokens. Documents and slots meet in a join on (source, block), and what the slots dealt take is the mix: the number of slots is
that of blocks in all targets, so a source gets its share of them within a block or two at the end of the mix and at every slot
before it. Ranks and positions are running sums in steps (inside bounded chunks, then over chunk totals), so that no task holds a
whole source.

Blocks are of 256 words or less: so small that the slots are 1,000 for each source at least, which keeps small mixes near their
targets too.

Defined cases: a null text has size 0 and is never taken; a null source is a source, last in order; repeated rows are taken
each for itself; null ids are ids of their own; a very long text is cut by block borders like any other; a table without words
gives targets 0 and no slots; an empty table gives an empty result; other columns are ignored. Rows that are equal in id, source
and text are told apart by their other columns, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.workspace import Workspace

GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """totals: source, source_size. Adds sid (order of the source), weight and target: ``share`` of all tokens by weight, no source above ``most`` times its size. The level at which the rest is shared is found in one pass over the sources ordered by where they stop."""
    by_name, by_stop = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("stop", "sid")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = totals.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumns({"cap": most * F.col("source_size"), "want": share * F.sum("source_size").over(everything), "stop": most * F.col("source_size") / F.col("weight")})
    before, onward = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("want") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    rows = rows.withColumn("line", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "sid", "level"))).over(everything)["level"])
    return rows.select("sid", "source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.coalesce("line", F.col("stop")) * F.col("weight")).alias("target"))


#: Sources that are sent to every worker; where there are more, tables meet in a shuffle.
FEW = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def running_totals(counts: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """counts: key, at (0, 1, ...), value. Adds ``before``, the sum of the values at smaller places of the key: inside 4,096 places, then over the sums of those."""
    part = counts.withColumn("__part", F.shiftright(at, 12))
    inside = Window.partitionBy(key, "__part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(key, "__part").agg(F.sum(value).alias("__sum")).select(key, "__part", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__start"))
    rows = part.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, [key, "__part"])
    return rows.withColumn("before", F.col("__start") + F.col("__in")).drop("__part", "__start", "__in")


def schedule(targets: DataFrame, slots: int, sources: int) -> DataFrame:
    """The slots with their source and their rank among its slots: sid, slot, rank."""
    spark = targets.sparkSession
    running = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    shares = targets.filter("target > 0").withColumn("sum", F.sum("target").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("high", F.sum("target").over(running) / F.col("sum"))
    # The border of two sources is one number, so that a point is in one of them; the last one ends at 1.
    shares = shares.withColumns({"low": F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0.0)), "high": F.when(F.lead("sid").over(Window.orderBy("sid")).isNull(), F.lit(1.0)).otherwise(F.col("high"))})
    cells = shares.select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % 1).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    dealt = points.join(_small(cells, sources), "cell").filter("u >= low and u < high").select("sid", "slot", F.shiftright("slot", 12).alias("chunk"))
    counts = dealt.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    ranked = dealt.withColumn("in_chunk", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot"))).join(running_totals(counts, "sid", "chunk", "n"), ["sid", "chunk"])
    return ranked.select("sid", "slot", (F.col("before") + F.col("in_chunk") - 1).alias("rank"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """128 bits of a row's id, source and text, never null."""
    parts = [F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`").cast("long"), F.col(f"`{source_col}`").isNull(), F.col(f"`{source_col}`").cast("string"), F.col(f"`{text_col}`").isNull(), F.col(f"`{text_col}`")]
    return [F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit(1), *parts).alias("k")]


def mix_rows(docs: DataFrame, block: int | None = None, chunk_rows: int = 512, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per document with its target and what the mix takes of it: doc_id, h, k, nth (of rows equal in h and k), size, source_size, target, taken, slot (the first), and takes, an array of (epoch, lo, hi in words, slot)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    sizes = ws.keep(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), *_keyed(docs, id_col, text_col, source_col)), "sizes")
    targets = ws.keep(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))).coalesce(1), "targets")
    rows, (words, sources) = sizes.count(), targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    block = block or int(max(8, min(256, words // (1000 * max(1, sources)))))
    bits = max(0, (-(-rows // chunk_rows) - 1).bit_length())
    bucket = F.shiftrightunsigned(F.col("h"), 64 - bits) if bits else F.lit(0).cast("long")
    keyed = sizes.join(_small(targets, sources), sizes["source"].eqNullSafe(targets["source"])).drop("source").withColumn("bucket", bucket)
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "k")
    placed = keyed.withColumns({"before": F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "row": F.row_number().over(inside), "nth": F.row_number().over(Window.partitionBy("sid", "bucket", "h", "k").orderBy("size"))})
    starts = running_totals(keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("n")), "sid", "bucket", "n").select("sid", "bucket", F.col("before").alias("start"))
    placed = placed.join(starts, ["sid", "bucket"]).withColumn("at", F.col("start") + F.col("before"))
    # An epoch lays the whole source end to end once; no target is above two, and no block goes on beyond the second.
    turns = placed.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch")).withColumn("from", F.col("epoch") * F.col("source_size") + F.col("at")).withColumn("to", F.col("from") + F.col("size"))
    parts = turns.withColumn("block", F.explode_outer(F.when(F.col("to") > F.col("from"), F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)))))
    plays = schedule(targets, int(words / block + 0.5), sources).select("sid", F.col("rank").alias("block"), "slot")
    met = parts.join(plays, ["sid", "block"], "left").withColumns({"lo": F.greatest("from", F.col("block") * block), "hi": F.least("to", (F.col("block") + 1) * block)})
    dealt = lambda c: F.when(F.col("slot").isNotNull(), c)
    whose = [F.first(c).alias(c) for c in ("doc_id", "h", "k", "nth", "size", "source_size", "target")]
    one = met.groupBy("sid", "bucket", "row", "epoch").agg(*whose, F.coalesce(F.sum(dealt(F.col("hi") - F.col("lo"))), F.lit(0)).alias("words"), F.min(dealt(F.col("lo") - F.col("from"))).alias("lo"), F.max(dealt(F.col("hi") - F.col("from"))).alias("hi"), F.min("slot").alias("slot"))
    both = one.groupBy("sid", "bucket", "row").agg(*whose, F.sum("words").alias("taken"), F.min("slot").alias("slot"), F.array_sort(F.collect_list(F.when(F.col("words") > 0, F.struct("epoch", "lo", "hi", "slot")))).alias("takes"))
    return both.drop("bucket", "row")


def mix_taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, slot (the first of the schedule that takes words of it, null if none does)."""
    return mix_rows(docs, **options).select("doc_id", "size", "source_size", "target", "taken", "slot")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ordered: bool = True, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken, in the order of the schedule if ``ordered``. Where a block border ends the mix of a source, the last text is the words taken."""
    takes = mix_rows(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).filter("taken > 0").select(*(F.col(c).alias(f"__{c}") for c in ("h", "k", "nth", "size", "takes")))
    names = list(docs.columns)
    h, k = _keyed(docs, id_col, text_col, source_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), h.alias("__h"), k.alias("__k"), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in names]).alias("__all"))
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__h", "__k").orderBy("__all"))).drop("__all")
    met = rows.join(takes, ["__h", "__k", "__nth"]).select("__row", "__size", "__h", F.explode("__takes").alias("__take"))
    whole = (F.col("__take.lo") == 0) & (F.col("__take.hi") == F.col("__size"))
    # The words from lo to hi with the white space between them.
    words = F.regexp_extract_all(F.col("__row")[text_col], F.lit(r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("__take.lo") + 1).cast("int"), (F.col("__take.hi") - F.col("__take.lo")).cast("int")), "")
    met = met.orderBy("__take.slot", "__take.epoch", "__h", "__take.lo") if ordered else met
    return met.select(*[F.when(whole, F.col("__row")[c]).otherwise(cut).alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in names])
