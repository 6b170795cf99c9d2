"""Relationship tuples: schema, text forms, checks, filtered and paged reads, merged writes.

A tuple's key is object, relation and user (with the userset relation, null meaning none); condition name and context belong
to it but don't identify it. Writing a key again with another condition is a conflict; deleting ignores conditions.
"""

from __future__ import annotations

import base64
import functools
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model.ast import Model

COLUMNS = ("object_type", "object_id", "relation", "user_type", "user_id", "user_relation", "condition_name", "condition_context")
KEY = COLUMNS[:6]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
#: Longest field lengths in bytes.
LIMITS = {"object_type": 254, "object_id": 256, "relation": 50, "user_id": 512, "condition_name": 256}


class ConditionConflict(ValueError):
    """A key is stored with one condition and written with another."""


class Relations:
    """Tuples kept apart by object type and relation, so that who reads one relation plans only what holds it."""

    def __init__(self, spark: SparkSession, parts: list[tuple[str, str, DataFrame]]):
        self.spark, self.parts = spark, [(t, r, with_columns(df)) for t, r, df in parts]

    def rows(self, type_: str, relation: str) -> DataFrame:
        own = [df for t, r, df in self.parts if (t, r) == (type_, relation)]
        return functools.reduce(DataFrame.unionByName, own) if own else self.spark.createDataFrame([], SCHEMA)

    def all(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [df for _, _, df in self.parts], self.spark.createDataFrame([], SCHEMA))


def with_columns(df: DataFrame | Relations) -> DataFrame:
    """df with all tuple columns, missing ones null, further ones kept after them."""
    if isinstance(df, Relations):
        return df.all()
    own = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS]
    return df.select(*own, *[c for c in df.columns if c not in COLUMNS])


def read(spark: SparkSession, path: str, store_id: str | None = None) -> DataFrame:
    """A Parquet table of tuples, perhaps partitioned by store_id and object_type; filters reach the scan."""
    df = spark.read.parquet(path)
    return with_columns(df if store_id is None else df.filter(F.col("store_id") == store_id))


def read_jdbc(spark: SparkSession, url: str, dbtable: str, **options: str) -> DataFrame:
    """Tuples of a relational database."""
    return with_columns(spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load())


def write_jdbc(df: DataFrame, url: str, dbtable: str, mode: str = "append", **options: str) -> None:
    """Tuples to a relational database, by as many connections as ``numPartitions`` says (Spark's option)."""
    with_columns(df).write.format("jdbc").mode(mode).options(url=url, dbtable=dbtable, **options).save()


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ("object_type",)) -> None:
    """Tuples as Parquet, laid out so that a type's tuples are read alone and relations are skipped by statistics."""
    df.repartition(*partition_by, F.pmod(F.xxhash64("object_id"), F.lit(32))).sortWithinPartitions(*partition_by, "relation", "object_id").write.mode(mode).partitionBy(*partition_by).parquet(path)


def from_text(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Tuples from (user, relation, object[, condition name, context]) in text form."""
    data = []
    for user, relation, object_, *more in rows:
        o_type, _, o_id = object_.partition(":")
        u_type, _, rest = user.partition(":")
        u_id, _, u_rel = rest.partition("#")
        name, context = (*more, None, None)[:2]
        if not (o_type and o_id and u_type and u_id and relation):
            raise ValueError(f"not a tuple: {user} {relation} {object_}")
        data.append((o_type, o_id, relation, u_type, u_id, u_rel or None, name, json.dumps(context) if isinstance(context, dict) else context))
    return spark.createDataFrame(data, SCHEMA)


def parse_user(user: Column) -> tuple[Column, Column, Column]:
    """(type, id, relation or null) of ``type:id`` or ``type:id#relation``; nulls where it is neither.

    The first ``#`` ends the id and the first colon the type, so ids may hold colons.
    """
    head = F.substring_index(user, "#", 1)
    type_ = F.substring_index(head, ":", 1)
    id_ = F.substring(head, F.length(type_) + 2, F.length(head))
    relation = F.substring(user, F.length(head) + 2, F.length(user))
    good = (type_ != "") & (id_ != "") & ((head == user) | (relation != ""))
    return F.when(good, type_), F.when(good, id_), F.when(good & (relation != ""), relation)


def parse_object(object_: Column) -> tuple[Column, Column]:
    """(type, id), split at the first colon; nulls where either is empty."""
    type_ = F.substring_index(object_, ":", 1)
    id_ = F.substring(object_, F.length(type_) + 2, F.length(object_))
    good = (type_ != "") & (id_ != "")
    return F.when(good, type_), F.when(good, id_)


def format_user(type_: Column, id_: Column, relation: Column) -> Column:
    return F.concat(type_, F.lit(":"), id_, F.coalesce(F.concat(F.lit("#"), relation), F.lit("")))


def problems(df: DataFrame, model: Model | None = None) -> DataFrame:
    """df with ``problem``: why a tuple can't be written, null if it can.

    The form is always checked; with a model also that type, relation and condition are defined in it.
    """
    rules: list[tuple[Column, str]] = []
    for c in ("object_type", "object_id", "relation", "user_type", "user_id"):
        rules.append((F.col(c).isNull() | (F.col(c) == ""), f"{c} is empty"))
    for c, n in LIMITS.items():
        rules.append((F.octet_length(c) > n, f"{c} is longer than {n} bytes"))
    rules.append((~F.col("object_type").rlike("^[A-Za-z0-9_-]+$"), "object_type has other characters than letters, digits, _ and -"))
    rules.append((~F.col("relation").rlike(r"^[^:#@\s]+$"), "relation has a forbidden character"))
    rules.append((F.octet_length("condition_context") > 10_240, "condition_context is longer than 10 KB"))
    rules.append((_depth(F.col("condition_context")) > 10, "condition_context is nested more than 10 deep"))
    if model is not None:
        known = [f"{t}#{r}" for t, rs in model.types.items() for r in rs]
        rules.append((~F.col("object_type").isin(list(model.types)), "object_type is not defined"))
        rules.append((~F.concat_ws("#", "object_type", "relation").isin(known), "relation is not defined on the type"))
        rules.append((F.col("condition_name").isNotNull() & ~F.col("condition_name").isin(list(model.conditions)), "condition is not defined"))
    problem = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in rules])
    return df.withColumn("problem", problem)


def _depth(text: Column) -> Column:
    """How deep JSON text is nested: brackets outside quotes, counted by their running sum."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    state = F.aggregate(
        F.filter(F.split(bare, ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda s, c: F.struct((s["d"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("d"), F.greatest(s["m"], s["d"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("m")),
    )
    return state["m"]


def filtered(df: DataFrame, object_type: str | None = None, object_id: str | None = None, relation: str | None = None, user: str | None = None, condition_name: str | None = None) -> DataFrame:
    """The tuples that meet all given terms; a user without ``#`` means tuples without userset relation."""
    for name, value in (("object_type", object_type), ("object_id", object_id), ("relation", relation), ("condition_name", condition_name)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    if user is not None:
        head, hash_, rel = user.partition("#")
        type_, _, id_ = head.partition(":")
        if not type_ or not id_ or (hash_ and not rel):
            raise ValueError(f"not a user: {user}")
        df = df.filter((F.col("user_type") == type_) & (F.col("user_id") == id_) & F.col("user_relation").eqNullSafe(F.lit(rel or None)))
    return df


def read_api(df: DataFrame, user: str | None = None, relation: str | None = None, object_: str | None = None) -> DataFrame:
    """Tuples by a partial key in text form: ``type:`` filters by type; an object without a colon filters nothing."""
    type_, colon, id_ = (object_ or "").partition(":")
    terms = {"object_type": type_ or None, "object_id": id_ or None} if colon else {}
    return filtered(df, relation=relation or None, user=user or None, **terms)


def page(df: DataFrame, order: tuple[str, ...], size: int = 100, token: str | None = None, descending: bool = False) -> tuple[DataFrame, str | None]:
    """One page in ``order`` (columns that identify a row; null first) and the token of the next, or None at the end.

    The token holds the last row's order columns, so a page costs a filter and a top-n, however far it lies.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) if dict(df.dtypes)[c] == "string" else F.col(c) for c in order]
    if token is not None:
        last = json.loads(base64.urlsafe_b64decode(token))
        values = [F.lit(v).cast(dict(df.dtypes)[c]) for c, v in zip(order, last, strict=True)]
        after = functools.reduce(lambda rest, kv: ((kv[0] < kv[1]) if descending else (kv[0] > kv[1])) | ((kv[0] == kv[1]) & rest), reversed(list(zip(keys, values, strict=True))), F.lit(False))
        df = df.filter(after)
    top = df.orderBy(*[k.desc() if descending else k.asc() for k in keys]).limit(size + 1)
    rows = top.collect()  # at most a page and one
    spark = df.sparkSession
    more = len(rows) > size
    out = spark.createDataFrame(rows[:size], df.schema)
    if not more:
        return out, None
    tail = [rows[size - 1][c] if rows[size - 1][c] is not None else "" for c in order]
    return out, base64.urlsafe_b64encode(json.dumps(tail, default=str).encode()).decode()


def conflicts(stored: DataFrame, writes: DataFrame) -> DataFrame:
    """Keys that are stored with another condition than they are written with."""
    same = functools.reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}")) for c in KEY])
    differs = ~F.col("s.condition_name").eqNullSafe(F.col("w.condition_name")) | ~F.col("s.condition_context").eqNullSafe(F.col("w.condition_context"))
    return stored.alias("s").join(writes.alias("w"), same & differs).select(*[F.col(f"w.{c}").alias(c) for c in KEY], F.col("s.condition_name").alias("stored_condition"), F.col("w.condition_name").alias("written_condition")).distinct()


def merged(stored: DataFrame, writes: DataFrame | None = None, deletes: DataFrame | None = None, check: bool = True) -> DataFrame:
    """The tuples after deletes, then writes; writing a stored tuple again changes nothing."""
    if deletes is not None:
        stored = _without(stored, deletes)
    if writes is None:
        return stored
    if check and not (found := conflicts(stored, writes)).isEmpty():
        raise ConditionConflict(str([tuple(r) for r in found.limit(5).collect()]))
    new = _without(writes.dropDuplicates(list(KEY)), stored)
    return stored.unionByName(new, allowMissingColumns=True)


def with_keys(rows: DataFrame, others: DataFrame) -> DataFrame:
    """The rows whose key is among the others'."""
    return _matched(rows, others, "left_semi")


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    return _matched(rows, others, "left_anti")


def _matched(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
    right = others.select(*[F.col(c).alias(f"_o_{c}") for c in KEY])
    same = [rows[c].eqNullSafe(right[f"_o_{c}"]) if c == "user_relation" else rows[c] == right[f"_o_{c}"] for c in KEY]
    return rows.join(right, functools.reduce(lambda x, y: x & y, same), how)


# what the engine's single look-ups are, as sets


def objects_by_type(df: DataFrame, object_type: str, limit: int | None = None) -> DataFrame:
    out = df.filter(F.col("object_type") == object_type).select("object_id").distinct().orderBy("object_id")
    return out if limit is None else out.limit(limit)


def objects_with_parents(df: DataFrame, object_type: str, tupleset: str, parents: DataFrame) -> DataFrame:
    """Objects whose ``tupleset`` names any of parents (user_type, user_id), with that tuple's condition; any number of parents."""
    links = df.filter((F.col("object_type") == object_type) & (F.col("relation") == tupleset) & F.col("user_relation").isNull())
    return links.join(parents.select("user_type", "user_id").distinct(), ["user_type", "user_id"], "left_semi").select("object_id", "condition_name", "condition_context").distinct()


def objects_for_user(df: DataFrame, object_type: str, relation: str, users: DataFrame) -> DataFrame:
    """For users (user_type, user_id): objects that name them or everyone of their type; the direct tuple wins."""
    from pyspark.sql import Window

    own = df.filter((F.col("object_type") == object_type) & (F.col("relation") == relation) & F.col("user_relation").isNull()).select("object_id", "user_type", F.col("user_id").alias("_named"), "condition_name", "condition_context")
    users = users.select("user_type", "user_id").distinct()
    direct = own.withColumnRenamed("_named", "user_id").join(users, ["user_type", "user_id"]).withColumn("_rank", F.lit(0))
    everyone = own.filter("_named = '*'").drop("_named").join(users.filter("user_id != '*'"), "user_type").withColumn("_rank", F.lit(1))
    both = direct.unionByName(everyone)
    first = Window.partitionBy("user_type", "user_id", "object_id").orderBy("_rank", F.col("condition_name").asc_nulls_first(), F.col("condition_context").asc_nulls_first())
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("user_type", "user_id", "object_id", "condition_name", "condition_context")
