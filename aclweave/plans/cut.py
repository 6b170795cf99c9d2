"""Where plans are cut: tables written to the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df written and read again, so that loops keep short plans and lost executors cost no recompute.

    Only a local session that names no folder (a test) gets one made and set; elsewhere that is an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="aclweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/plan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
