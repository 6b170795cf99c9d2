"""Expand: a relation's rewrite as a tree, one level deep, with the users that tuples name at its leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model.ast import Computed, Difference, FromParent, Model, Rewrite, This, Union
from ..sources.tuples import format_user, with_columns


def expand(model: Model, tuples: DataFrame, object_: str, relation: str) -> dict:
    """The tree of one object as nested dictionaries; users in order."""
    type_, _, id_ = object_.partition(":")
    d = model.relation(type_, relation)
    if d is None:
        raise ValueError(f"unknown relation {type_}#{relation}")
    here = F.col("object_type") == type_, F.col("object_id") == id_
    named = with_columns(tuples).filter(here[0] & here[1])

    def users(r: str) -> list[str]:
        rows = named.filter(F.col("relation") == r).select(format_user(F.col("user_type"), F.col("user_id"), F.col("user_relation")).alias("u"))
        return sorted({x["u"] for x in rows.distinct().collect()})  # one object's

    def tree(r: Rewrite) -> dict:
        name = f"{object_}#{relation}"
        if isinstance(r, This):
            return {"name": name, "leaf": {"users": users(relation)}}
        if isinstance(r, Computed):
            return {"name": name, "leaf": {"computed": f"{object_}#{r.relation}"}}
        if isinstance(r, FromParent):
            return {"name": name, "leaf": {"tupleset": f"{object_}#{r.tupleset}", "computed": [f"{p}#{r.relation}" for p in users(r.tupleset)]}}
        if isinstance(r, Difference):
            return {"name": name, "difference": {"base": tree(r.base), "subtract": tree(r.subtract)}}
        return {"name": name, "union" if isinstance(r, Union) else "intersection": [tree(c) for c in r.children()]}

    return tree(d.rewrite)


def expand_rows(model: Model, tuples: DataFrame, objects: DataFrame, object_type: str, relation: str) -> DataFrame:
    """Trees of many objects (object_id) as rows: object_id, path, node_type, value (an ordered array of text)."""
    d = model.relation(object_type, relation)
    if d is None:
        raise ValueError(f"unknown relation {object_type}#{relation}")
    objects = objects.select("object_id").distinct()
    leaves: list[tuple[str, str, str]] = []
    nodes: list[tuple[str, str, str]] = []

    def walk(r: Rewrite, path: str) -> None:
        if isinstance(r, This):
            leaves.append((path, "users", relation))
        elif isinstance(r, Computed):
            nodes.append((path, "computed", r.relation))
        elif isinstance(r, FromParent):
            leaves.append((path, "tuple_to_userset", f"{r.tupleset}#{r.relation}"))
        else:
            nodes.append((path, type(r).__name__.lower(), ""))
            for i, c in enumerate(r.children()):
                walk(c, f"{path}.{i}")

    walk(d.rewrite, "0")
    spark = tuples.sparkSession
    fixed = spark.createDataFrame(nodes, "path string, node_type string, name string") if nodes else spark.createDataFrame([], "path string, node_type string, name string")
    out = objects.crossJoin(F.broadcast(fixed))  # a row for each inner node of the model's rewrite
    out = out.select("object_id", "path", "node_type", F.when(F.col("name") == "", F.array().cast("array<string>")).otherwise(F.array("name")).alias("value"))
    rows = with_columns(tuples).filter(F.col("object_type") == object_type)
    for path, kind, name in leaves:
        tupleset, _, computed = name.partition("#")
        user = format_user(F.col("user_type"), F.col("user_id"), F.col("user_relation"))
        user = F.concat(user, F.lit(f"#{computed}")) if computed else user
        got = rows.filter(F.col("relation") == tupleset).groupBy("object_id").agg(F.array_sort(F.collect_set(user)).alias("value"))  # one object's users
        own = objects.join(got, "object_id", "left").select("object_id", F.lit(path).alias("path"), F.lit(kind).alias("node_type"), F.coalesce("value", F.array().cast("array<string>")).alias("value"))
        out = out.unionByName(own)
    return out
