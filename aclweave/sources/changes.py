"""The change log: an append-only table of writes and deletes, and what follows from it.

Rows are tuples with ``operation``, ``changed_at`` and ``seq``, which breaks ties. Deletes of absent tuples and repeated
writes are logged too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tuples import COLUMNS, KEY, page

WRITE, DELETE = "TUPLE_OPERATION_WRITE", "TUPLE_OPERATION_DELETE"


def log_of(writes: DataFrame | None, deletes: DataFrame | None, at, first_seq: int = 0) -> DataFrame:
    """Log rows of one request: deletes first, then writes."""
    parts = [df.select(*COLUMNS).withColumn("operation", F.lit(op)) for df, op in ((deletes, DELETE), (writes, WRITE)) if df is not None]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("changed_at", F.lit(at).cast("timestamp_ntz")).withColumn("seq", F.monotonically_increasing_id() + first_seq)


def read_changes(log: DataFrame, object_type: str | None = None, size: int = 50, token: str | None = None) -> tuple[DataFrame, str | None]:
    """A page of changes, oldest first, and the next page's token."""
    if object_type is not None:
        log = log.filter(F.col("object_type") == object_type)
    return page(log, ("changed_at", "seq"), size, token)


def state(log: DataFrame, as_of=None) -> DataFrame:
    """The tuples that the log leaves (at a time, if one is given): the last operation of each key, where it is a write."""
    if as_of is not None:
        log = log.filter(F.col("changed_at") <= F.lit(as_of).cast("timestamp_ntz"))
    last = Window.partitionBy(*KEY).orderBy(F.col("changed_at").desc(), F.col("seq").desc())
    return log.withColumn("_n", F.row_number().over(last)).filter((F.col("_n") == 1) & (F.col("operation") == WRITE)).drop("_n", "operation")
