"""Structured Streaming over the change log: current tuples, and permissions that follow them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.changes import WRITE
from ..sources.tuples import COLUMNS, KEY

LOG_SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", operation string, changed_at timestamp_ntz, seq bigint"


def read_log(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The log's Parquet folder as a stream of appended rows."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """current (tuple columns, changed_at, seq, live) after a batch of changes; deleted keys stay as dead rows, so that a
    late or repeated batch can't bring them back."""
    new = changes.select(*COLUMNS, "changed_at", "seq", (F.col("operation") == WRITE).alias("live"))
    last = Window.partitionBy(*KEY).orderBy(F.col("changed_at").desc(), F.col("seq").desc())
    return current.unionByName(new).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


class TupleTable:
    """Current tuples in buckets by a hash of the key. A batch writes anew the buckets that it touches, below its number, and
    a list of where each bucket's newest content is; a replay of the batch writes the same again. What older batches wrote
    stays, so any version can be read. The number of buckets is fixed when the table is first written.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = ", ".join(f"{c} string" for c in COLUMNS) + ", changed_at timestamp_ntz, seq bigint, live boolean"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def _places(self, n: int) -> dict[int, int]:
        """Of each bucket that has content, the batch that wrote it last (at most one entry a bucket)."""
        if n < 0:
            return {}
        return {r["bucket"]: r["v"] for r in self.spark.read.schema("bucket int, v bigint").parquet(f"{self.path}/list/v{n}").collect()}

    def _content(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(places.items())])

    def version(self, n: int) -> DataFrame:
        return self._content(self._places(n))

    def upsert(self, batch: DataFrame, n: int) -> None:
        before = self._places(n - 1)
        touched = {r[0] for r in batch.select(self._bucket()).distinct().collect()}
        if touched:
            after = apply_changes(self._content({b: v for b, v in before.items() if b in touched}), batch).withColumn("bucket", self._bucket())
            after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{n}")
        places = sorted((before | dict.fromkeys(touched, n)).items())
        self.spark.createDataFrame(places, "bucket int, v bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list/v{n}")

    def tuples(self, n: int) -> DataFrame:
        return self.version(n).filter("live").select(*COLUMNS)


def follow(log: DataFrame, table: TupleTable, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, **trigger):
    """A query that keeps ``table`` current; ``then`` gets the tuples after each batch (to renew materialised permissions)."""

    def each(batch: DataFrame, n: int) -> None:
        table.upsert(batch, n)
        if then is not None:
            then(table.tuples(n), n)

    return log.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
