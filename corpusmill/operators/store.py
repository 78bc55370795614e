"""A keyed table of files in buckets that grows by epochs: inserts read Bloom filters and the keys of few segments, merges rewrite the buckets they touch, a refresh drops segments without reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.workspace import Workspace

PLACE = ["store_scope", "store_bucket"]
SEGMENT = "store_scope string, store_bucket int, store_epoch long, n long"
#: Keys of a block of a filter, which has 32,768 bits, and bits set for each: about one stranger in a hundred passes.
BLOCK_KEYS, PROBES = 3000, 4


def buckets_for(rows: int, each: int = 1_000_000, least: int = 4) -> int:
    """Buckets of about ``each`` rows."""
    return max(least, -(-rows // each))


def _bit(bits: Column, at: Column) -> Column:
    return F.getbit(F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), at % 8) == 1


class KeyedStore:
    """Rows by unique key under ``path``. A key is the value of its columns, nulls included, in one scope, the value of the column ``part`` (such as a configuration).

    rows/store_epoch=E/store_scope=S/store_bucket=B holds what epoch E wrote of a bucket: a segment. filters/ holds its Bloom filters, in blocks of 4 KB for each 3,000 keys. manifest/epoch=E lists all live
    segments after E, and is complete once its marker of success is there: readers see whole epochs, and what a failed attempt left is written over. An epoch that is complete is not done again. Epochs go up; there is
    one writer at a time. Choose ``buckets`` so that a bucket of the largest scope stays within some million rows; a batch of b keys reads b buckets of filters at most, however many rows the store has.
    Of rows with the same key in one batch the least by their other columns counts, which must be of types that can be ordered. Names that begin with ``store_`` are taken."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType, part: str | None = None, buckets: int = 64, segments: int = 8):
        self.spark, self.path, self.keys, self.part, self.buckets, self.segments = spark, path.rstrip("/"), list(keys), part, buckets, segments
        self.columns = schema.names
        place = [T.StructField("store_scope", T.StringType()), T.StructField("store_bucket", T.IntegerType()), T.StructField("store_epoch", T.LongType())]
        self._rows = T.StructType([*schema.fields, T.StructField("store_key", T.BinaryType()), *place])
        self._filters = T.StructType([T.StructField("block", T.LongType()), T.StructField("bits", T.BinaryType()), *place])

    # What is there

    def epochs(self) -> list[int]:
        """The complete ones that have not been cleared."""
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        where = Path(f"{self.path}/manifest")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(name[6:]) for name in found if name.startswith("epoch=") and fs.exists(Path(f"{self.path}/manifest/{name}/_SUCCESS")))

    def live(self, epoch: int | None = None) -> DataFrame:
        """The segments as of an epoch, by default the last."""
        done = [e for e in self.epochs() if epoch is None or e <= epoch]
        return self.spark.read.schema(SEGMENT).parquet(f"{self.path}/manifest/epoch={done[-1]}") if done else self.spark.createDataFrame([], SEGMENT)

    def read(self, epoch: int | None = None) -> DataFrame:
        return self._load("rows", self.live(epoch).collect()).select(*self.columns)

    def _load(self, kind: str, segments: list[Row]) -> DataFrame:
        schema = self._rows if kind == "rows" else self._filters
        paths = [f"{self.path}/{kind}/store_epoch={s.store_epoch}/store_scope={s.store_scope}/store_bucket={s.store_bucket}" for s in segments]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Keys

    def _scope(self, value: Column | None) -> Column:
        return F.lit("all") if value is None else F.concat(F.lit("s"), F.md5(F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """With the key's digest, scope and bucket."""
        scope = self._scope(F.col(self.part) if self.part else None)
        key = F.unhex(F.sha2(F.to_json(F.struct(*self.keys)), 256))
        return rows.withColumns({"store_key": key, "store_scope": scope}).withColumn("store_bucket", F.pmod(F.xxhash64("store_key"), F.lit(self.buckets)).cast("int"))

    def _one_each(self, rows: DataFrame) -> DataFrame:
        placed = self._placed(rows.select(*self.columns))
        least = placed.groupBy(*PLACE, "store_key").agg(F.min(F.struct(*self.columns)).alias("r"))
        return least.select("r.*", "store_key", *PLACE)

    @staticmethod
    def _block(n: Column) -> Column:
        return F.pmod(F.xxhash64("store_key", F.lit(-1)), F.ceil(n / BLOCK_KEYS))

    @staticmethod
    def _probe(i: int) -> Column:
        return F.pmod(F.xxhash64("store_key", F.lit(i)), F.lit(32_768)).cast("int")

    def _touched(self, placed: DataFrame, live: DataFrame) -> list[Row]:
        return live.join(placed.select(*PLACE).distinct(), PLACE, "left_semi").collect()

    def _unseen(self, one: DataFrame, near: list[Row], ws: Workspace) -> DataFrame:
        """Rows of ``one`` whose key is in none of the segments of their buckets."""
        if not near:
            return one
        meets = one.select("store_key", *PLACE).join(self.spark.createDataFrame(near, SEGMENT), PLACE).withColumn("block", self._block(F.col("n")))
        passed = meets.join(self._load("filters", near), [*PLACE, "store_epoch", "block"])
        for i in range(PROBES):
            passed = passed.filter(_bit(F.col("bits"), self._probe(i)))
        hits = ws.keep(passed.select("store_key", *PLACE, "store_epoch"), "hits")
        held = hits.select(*PLACE, "store_epoch").distinct().collect()
        stored = self._load("rows", held).select("store_key", *PLACE)
        known = stored.join(hits.select("store_key", *PLACE).distinct(), [*PLACE, "store_key"], "left_semi")
        return one.join(known, [*PLACE, "store_key"], "left_anti")

    def unseen(self, rows: DataFrame) -> DataFrame:
        """One row of each key that the store doesn't have."""
        ws = Workspace(self.spark, "store")
        one = ws.keep(self._one_each(rows), "batch")
        return self._unseen(one, self._touched(one, self.live()), ws).select(*self.columns)

    # Epochs

    def _open(self, epoch: int) -> bool:
        done = self.epochs()
        if epoch in done:
            return False
        if done and epoch < done[-1]:
            raise ValueError(f"epoch {epoch} comes after {done[-1]}")
        return True

    def _commit(self, epoch: int, rows: DataFrame, stays: DataFrame) -> None:
        rows.select(*self.columns, "store_key", *PLACE).hint("rebalance", *[F.col(c) for c in PLACE]).write.partitionBy(*PLACE).mode("overwrite").parquet(f"{self.path}/rows/store_epoch={epoch}")
        keys = self.spark.read.schema(self._rows).option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows/store_epoch={epoch}").select("store_key", *PLACE)
        counts = keys.groupBy(*PLACE).agg(F.count("*").alias("n"))
        bits = keys.join(counts, PLACE).select(*PLACE, self._block(F.col("n")).alias("block"), F.explode(F.array(*[self._probe(i) for i in range(PROBES)])).alias("at"))
        bits.groupBy(*PLACE, "block").agg(F.bitmap_construct_agg("at").alias("bits")).hint("rebalance", *[F.col(c) for c in PLACE]).write.partitionBy(*PLACE).mode("overwrite").parquet(f"{self.path}/filters/store_epoch={epoch}")
        new = counts.select(*PLACE, F.lit(epoch).cast("long").alias("store_epoch"), "n")
        stays.select(new.columns).unionByName(new).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/epoch={epoch}")

    def insert(self, rows: DataFrame, epoch: int) -> None:
        """Adds the rows whose key is new. Buckets that reach ``segments`` segments are written together."""
        if not self._open(epoch):
            return
        ws = Workspace(self.spark, "store")
        one, live = ws.keep(self._one_each(rows), "batch"), self.live()
        near = self._touched(one, live)
        new = self._unseen(one, near, ws)
        many: dict[tuple, list[Row]] = {}
        for s in near:
            many.setdefault((s.store_scope, s.store_bucket), []).append(s)
        crowded = [s for group in many.values() if len(group) >= self.segments for s in group]
        if crowded:
            new = new.unionByName(self._load("rows", crowded).drop("store_epoch"))
            live = live.join(self.spark.createDataFrame(crowded, SEGMENT), [*PLACE, "store_epoch"], "left_anti")
        self._commit(epoch, new, live)

    def merge(self, rows: DataFrame, epoch: int) -> None:
        """The rows replace those of the same key or are added. Buckets with a row of the batch are written anew, others stay as they are."""
        if self._open(epoch):
            ws, live = Workspace(self.spark, "store"), self.live()
            one = ws.keep(self._one_each(rows), "batch")
            old = self._load("rows", self._touched(one, live)).drop("store_epoch").join(one.select("store_key", *PLACE), [*PLACE, "store_key"], "left_anti")
            self._commit(epoch, old.unionByName(one), live.join(one.select(*PLACE).distinct(), PLACE, "left_anti"))

    def delete(self, gone: DataFrame, epoch: int) -> None:
        """Without the rows of these keys (the key columns and ``part``). Buckets that have none of them are not read."""
        if self._open(epoch):
            ws, live = Workspace(self.spark, "store"), self.live()
            marked = ws.keep(self._placed(gone).select("store_key", *PLACE).distinct(), "gone")
            old = self._load("rows", self._touched(marked, live)).drop("store_epoch").join(marked, [*PLACE, "store_key"], "left_anti")
            self._commit(epoch, old, live.join(marked.select(*PLACE).distinct(), PLACE, "left_anti"))

    def refresh(self, value, rows: DataFrame, epoch: int) -> None:
        """All rows of the scope ``value`` of ``part`` go, unread; those of ``rows``, which must be of that scope, come in their place."""
        if self.part is None:
            raise ValueError("a refresh needs a column of scopes")
        if self._open(epoch):
            ws = Workspace(self.spark, "store")
            one = ws.keep(self._one_each(rows), "batch")
            same = self._scope(F.lit(value))
            if not one.filter(F.col("store_scope") != same).isEmpty():
                raise ValueError(f"rows of another scope than {value!r}")
            self._commit(epoch, one, self.live().filter(F.col("store_scope") != same))

    def clear(self, before: int) -> None:
        """Deletes manifests of epochs under ``before``, other than the last, and the segments of those epochs that no manifest left has. Not while older epochs are read."""
        done = self.epochs()
        gone = [e for e in done[:-1] if e < before]
        old, left = self._all_live(gone), self._all_live([e for e in done if e not in gone])
        dead = old.join(left, [*PLACE, "store_epoch"], "left_anti").collect()
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for e in gone:
            fs.delete(Path(f"{self.path}/manifest/epoch={e}"), True)
        for s in dead:
            for kind in ("rows", "filters"):
                fs.delete(Path(f"{self.path}/{kind}/store_epoch={s.store_epoch}/store_scope={s.store_scope}/store_bucket={s.store_bucket}"), True)

    def _all_live(self, epochs: list[int]) -> DataFrame:
        paths = [f"{self.path}/manifest/epoch={e}" for e in epochs]
        rows = self.spark.read.schema(SEGMENT).parquet(*paths) if paths else self.spark.createDataFrame([], SEGMENT)
        return rows.select(*PLACE, "store_epoch").distinct()
