"""A materialised permission table: every (relation, user, object) that Check would allow, for look-ups by join."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model.ast import Model
from ..plans.cut import stored
from ..sources.tuples import format_user, with_columns
from .listing import list_objects


def materialise(model: Model, tuples: DataFrame, nodes: list[tuple[str, str]], users: DataFrame | None = None) -> DataFrame:
    """object_type, relation, object_id, user for each of nodes (type, relation), without request contexts.

    users: one column ``user``; by default everyone whom a tuple names. Conditions see only their tuples' contexts.
    """
    if users is None:
        named = with_columns(tuples).filter(F.col("user_relation").isNull() & (F.col("user_id") != "*"))
        users = named.select(format_user(F.col("user_type"), F.col("user_id"), F.col("user_relation")).alias("user")).distinct()
    asked = stored(users.select(F.col("user").alias("request_id"), "user"))
    parts = [list_objects(model, tuples, asked, r, t).select(F.lit(t).alias("object_type"), F.lit(r).alias("relation"), "object_id", F.col("request_id").alias("user")) for t, r in nodes]
    return functools.reduce(DataFrame.unionByName, parts)
