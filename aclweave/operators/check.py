"""Check for batches of requests."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model.ast import Model
from ..plans.cut import stored
from ..plans.evaluate import Evaluator
from ..sources.tuples import COLUMNS, Relations, parse_object, parse_user, with_columns

#: Requests in one batch, bytes of one context.
MAX_ITEMS, MAX_CONTEXT = 50, 10_240


def canonical(context: Column) -> Column:
    """JSON text with sorted keys, so that equal contexts are one; null where it isn't an object."""
    return F.when(F.try_parse_json(context).isNotNull() & context.rlike(r"^\s*\{"), F.to_json(F.try_parse_json(context)))


def batch_check(model: Model, tuples: DataFrame | Relations, requests: DataFrame, contextual: DataFrame | None = None, link_conditions: bool = False, max_items: int | None = None, max_context: int | None = None) -> DataFrame:
    """requests with ``allowed``, ``error`` and ``error_kind``.

    requests: request_id, user (``type:id`` or ``type:id#relation``), relation, object, and perhaps context (JSON).
    contextual: request_id and tuple columns; each request sees its own. Equal (user, relation, object, context) are
    evaluated once. ``error`` says why a request has no answer: a malformed or unknown part, a condition that failed where
    it decides, or a bound (``max_items`` requests of one ``batch_id``, ``max_context`` bytes of context) that it exceeds;
    then ``allowed`` is false. All of these are the caller's (kind ``validation``); what is the engine's own fault is raised.
    """
    u_type, u_id, u_rel = parse_user(F.col("user"))
    o_type, o_id = parse_object(F.col("object"))
    raw = F.col("context").cast("string") if "context" in requests.columns else F.lit(None).cast("string")
    known = [f"{t}#{r}" for t, rs in model.types.items() for r in rs]
    q = requests.select("*", u_type.alias("_ut"), u_id.alias("_ui"), u_rel.alias("_ur"), o_type.alias("_ot"), o_id.alias("_oi"), F.coalesce(canonical(raw), F.lit("{}")).alias("_ctx"))
    # kept, as seeds and pairs both read it; with contextual tuples seeds are about as many as requests, and a third copy is too much
    q = stored(q) if contextual is None else q
    problem = F.when(F.col("_ut").isNull(), F.lit("invalid user")).when(F.col("_ot").isNull(), F.lit("invalid object")).when(~F.col("_ot").isin(list(model.types)), F.lit("unknown type"))
    problem = problem.when(F.col("relation").isNull() | ~F.concat_ws("#", "_ot", "relation").isin(known), F.lit("unknown relation"))
    if max_context is not None:
        problem = problem.when(F.octet_length(raw) > max_context, F.lit("the context is too large"))
    if max_items is not None:
        by = ["batch_id"] if "batch_id" in requests.columns else []
        sizes = q.groupBy(*by).agg((F.count("*") > max_items).alias("_large"))
        q = q.join(sizes.withColumnsRenamed({c: f"_size_{c}" for c in by}), functools.reduce(lambda a, b: a & b, [q[c].eqNullSafe(F.col(f"_size_{c}")) for c in by], F.lit(True))).drop(*[f"_size_{c}" for c in by])
        problem = F.when(F.col("_large"), F.lit("the batch is too large")).otherwise(problem)
    who = ["_ut", "_ui", "_ur", "_ctx"]
    if contextual is not None:
        seen = contextual.select(F.col("request_id").alias("_own")).distinct()
        q = q.join(seen, q["request_id"] == F.col("_own"), "left")
        who.append("_own")
    q = q.withColumn("_problem", problem)
    seeds = stored(q.filter("_problem IS NULL").select(*who).distinct().withColumn("seed_id", F.monotonically_increasing_id()))
    same = functools.reduce(lambda a, b: a & b, [F.col(f"q.{c}").eqNullSafe(F.col(f"s.{c}")) if c in ("_ur", "_own") else F.col(f"q.{c}") == F.col(f"s.{c}") for c in who])
    asked = stored(q.alias("q").join(seeds.alias("s"), same, "left").select(*[F.col(f"q.{c}") for c in requests.columns], "_ot", "_oi", "_problem", "seed_id"))
    pairs = asked.filter("_problem IS NULL")
    nodes = [(r[0], r[1]) for r in pairs.select("_ot", "relation").distinct().collect()]  # at most the model's relations
    extra = None
    if contextual is not None:
        extra = with_columns(contextual.join(seeds.select("seed_id", F.col("_own").alias("request_id")).filter("request_id IS NOT NULL"), "request_id")).select("seed_id", *COLUMNS)
    users = seeds.select("seed_id", F.col("_ut").alias("user_type"), F.col("_ui").alias("user_id"), F.col("_ur").alias("user_relation"), F.col("_ctx").alias("context"))
    evaluator = Evaluator(model, tuples, users, extra, link_conditions)
    wanted = {n: pairs.filter((F.col("_ot") == n[0]) & (F.col("relation") == n[1])).select("seed_id", F.col("_oi").alias("object_id")) for n in nodes}
    found = evaluator.run(nodes, wanted)
    label = lambda df, n, level: df.select("seed_id", F.lit(n[0]).alias("_ot"), F.lit(n[1]).alias("relation"), F.col("object_id").alias("_oi"), F.lit(level).alias("_level"))
    parts = [label(a[0], n, 2) for n, a in found.items()] + [label(a[1], n, 1) for n, a in found.items() if a[1] is not a[0]]
    empty = requests.sparkSession.createDataFrame([], "seed_id bigint, _ot string, relation string, _oi string, _level int")
    levels = functools.reduce(DataFrame.unionByName, parts) if parts else empty
    if len(parts) > len(found):  # a pair may be in both answers
        levels = levels.groupBy("seed_id", "_ot", "relation", "_oi").agg(F.max("_level").alias("_level"))
    keys = ["seed_id", "_ot", "relation", "_oi"]
    out = asked.join(levels.withColumnsRenamed({k: f"_f_{k}" for k in keys}), functools.reduce(lambda a, b: a & b, [asked[k] == F.col(f"_f_{k}") for k in keys]), "left")
    error = F.coalesce(F.col("_problem"), F.when(F.col("_level") == 1, F.lit("condition failed")))
    allowed = F.col("_problem").isNull() & F.coalesce(F.col("_level") == 2, F.lit(False))
    return out.select(*[F.col(c) for c in requests.columns], allowed.alias("allowed"), error.alias("error"), F.when(error.isNotNull(), F.lit("validation")).alias("error_kind"))


def check(model: Model, tuples: DataFrame, user: str, relation: str, object_: str, context: dict | None = None, contextual: DataFrame | None = None, **options) -> bool:
    """One request; raises ValueError where it has no answer."""
    spark = tuples.sparkSession
    one = spark.createDataFrame([(0, user, relation, object_, json.dumps(context) if context else None)], "request_id bigint, user string, relation string, object string, context string")
    extra = None if contextual is None else contextual.withColumn("request_id", F.lit(0).cast("bigint"))
    row = batch_check(model, tuples, one, extra, **options).first()
    if row["error"]:
        raise ValueError(row["error"])
    return row["allowed"]


def run_assertions(model: Model, tuples: DataFrame, assertions: DataFrame) -> DataFrame:
    """assertions (position, user, relation, object, expectation, perhaps context) with ``allowed`` and ``passed``."""
    got = batch_check(model, tuples, assertions.withColumn("request_id", F.col("position")))
    return got.drop("request_id", "error_kind").withColumn("passed", (F.col("allowed") == F.col("expectation")) & F.col("error").isNull())
