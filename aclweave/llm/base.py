"""What the corpus operators share: tables, shared work folders, folds and Arrow passes."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Most bytes of text that a worker holds as Python objects at once, but for single longer texts.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session that names none (a test) gets one made and set; on a cluster a folder of the driver's own machine
    would be lost on the others, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="aclweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/aclweave-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs no recompute."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_held_out(doc_id: Column) -> Column:
    """The fold that nothing is learnt from: crc32 of the id's text leaves 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batch: pa.RecordBatch, rows: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``size`` bytes of text (a longer text has a part of its own)."""
    lengths = None
    if "text" in batch.schema.names and pa.types.is_string(batch.schema.field("text").type):
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < batch.num_rows:
        end = min(start + rows, batch.num_rows)
        if lengths is not None:
            end = start + max(1, int(np.searchsorted(np.cumsum(lengths[start:end]), size, "right")))
            end = min(end, start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def arrow_pass(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str | StructType, rows: int = 512, size: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow in slices of at most ``rows`` rows and some megabytes of text, so that memory stays bounded.

    make() runs once a task and returns a function from columns (lists) to columns (lists or arrays).
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, rows, size):
                out = fn({n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A table's schema with further columns, all of which may be null."""
    return StructType([StructField(f.name, f.dataType) for f in schema] + StructType.fromDDL(ddl).fields)


class Cover:
    """Spans of a text as disjoint sorted intervals, to ask whether another span touches any."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start
