"""Registered queries over the driver's tables, and the SQL that DuckDB answers them with."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import Model, parse_dsl
from .operators import batch_check, expand_rows, list_objects, list_users, run_assertions
from .operators.check import MAX_CONTEXT
from .operators.index import materialise
from .plans.cut import stored
from .sources import changes, tuples
from .sources.catalog import latest_models
from .sources.tuples import COLUMNS

MODEL_TEXT = """
type user
type source
type group
  relations
    define member: [user, group#member]
type region
  relations
    define viewer: [group#member]
type nation
  relations
    define parent: [region]
    define viewer: viewer from parent
type customer
  relations
    define parent: [nation]
    define viewer: viewer from parent
type supplier
  relations
    define parent: [nation]
    define viewer: viewer from parent
type order
  relations
    define parent: [customer]
    define owner: [user]
    define blocked: [user]
    define approver: [user with max_price]
    define viewer: viewer from parent or owner
    define can_edit: owner but not blocked
    define can_sign: owner and approver
type lineitem
  relations
    define parent: [order]
    define viewer: viewer from parent
type part
  relations
    define viewer: [user, user:*]
type document
  relations
    define parent: [source]
    define blocked: [user, user:*]
condition max_price(amount: int, limit: int) {
  request.amount <= request.limit
}
"""


def model() -> Model:
    return parse_dsl(MODEL_TEXT)


#: The tuples that the driver's tables stand for: object type, id, relation, user type, id, userset, condition, context, table.
_V = "CAST({} AS VARCHAR(20))"
_GROUP_OF = "CASE r_regionkey WHEN 0 THEN 'ALL' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END"
_BRANCHES = [
    ("nation", _V.format("n_nationkey"), "parent", "region", _V.format("n_regionkey"), None, None, None, "nation"),
    ("customer", _V.format("c_custkey"), "parent", "nation", _V.format("c_nationkey"), None, None, None, "customer"),
    ("supplier", _V.format("s_suppkey"), "parent", "nation", _V.format("s_nationkey"), None, None, None, "supplier"),
    ("order", _V.format("o_orderkey"), "parent", "customer", _V.format("o_custkey"), None, None, None, "orders"),
    ("order", _V.format("o_orderkey"), "owner", "user", f"CONCAT('c', {_V.format('o_custkey')})", None, None, None, "orders"),
    ("order", _V.format("o_orderkey"), "blocked", "user", f"CONCAT('c', {_V.format('o_custkey')})", None, None, None, "orders WHERE o_orderstatus = 'F'"),
    ("order", _V.format("o_orderkey"), "approver", "user", f"CONCAT('c', {_V.format('o_custkey')})", None, "max_price", f"CONCAT('{{\"limit\":', {_V.format('CAST(FLOOR(o_totalprice) AS BIGINT)')}, '}}')", "orders WHERE o_orderpriority = '1-URGENT'"),
    ("lineitem", f"CONCAT({_V.format('l_orderkey')}, '-', {_V.format('l_linenumber')})", "parent", "order", _V.format("l_orderkey"), None, None, None, "lineitem"),
    ("group", "c_mktsegment", "member", "user", f"CONCAT('c', {_V.format('c_custkey')})", None, None, None, "customer"),
    ("group", "'ALL'", "member", "group", "c_mktsegment", "member", None, None, "customer WHERE c_mktsegment < 'G'"),
    ("group", "'AUTOMOBILE'", "member", "group", "'ALL'", "member", None, None, "region WHERE r_regionkey = 0"),
    ("region", _V.format("r_regionkey"), "viewer", "group", _GROUP_OF, "member", None, None, "region"),
    ("part", _V.format("p_partkey"), "viewer", "user", "'*'", None, None, None, "part WHERE p_size <= 5"),
    ("document", _V.format("doc_id"), "parent", "source", "source", None, None, None, "documents"),
    ("document", _V.format("doc_id"), "blocked", "user", "'*'", None, None, None, "labels WHERE toxic = 1"),
]
#: Branches whose source has several rows for one tuple.
_REPEATED = {7, 9}


def _select(branch: tuple) -> tuple[str, str]:
    o_type, o_id, relation, u_type, u_id, u_rel, condition, context, source = branch
    text = lambda x: "CAST(NULL AS VARCHAR(20))" if x is None else f"'{x}'"
    items = (f"'{o_type}'", o_id, f"'{relation}'", f"'{u_type}'", u_id, text(u_rel), text(condition), "CAST(NULL AS VARCHAR(20))" if context is None else context)
    return ", ".join(f"{x} AS {c}" for x, c in zip(items, COLUMNS, strict=True)), source


TUPLES_SQL = "t AS (" + " UNION ".join(f"SELECT {cols} FROM {source}" for cols, source in map(_select, _BRANCHES)) + ")"
GROUPS_SQL = "gm AS (SELECT object_id AS g, user_id AS u FROM t WHERE object_type = 'group' AND user_relation IS NULL UNION SELECT t.object_id, gm.u FROM t JOIN gm ON t.object_type = 'group' AND t.user_relation = 'member' AND t.user_id = gm.g)"
WITH = f"WITH RECURSIVE {TUPLES_SQL}, {GROUPS_SQL}"


#: Schemas by path: a table's footers are read once, not once a branch.
_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def relations(spark: SparkSession, sf_dir: str) -> tuples.Relations:
    """All tuples, by type and relation."""
    parts = []
    for k, branch in enumerate(_BRANCHES):
        cols, source = _select(branch)
        name, _, where = source.partition(" WHERE ")
        df = table(spark, sf_dir, name)
        df = (df.filter(where) if where else df).selectExpr(*[x.replace("VARCHAR(20)", "STRING") for x in _split(cols)])
        parts.append((branch[0], branch[2], df.distinct() if k in _REPEATED else df))
    return tuples.Relations(spark, parts)


def tuple_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tuples; a filter on type and relation leaves only the branches that have any, and reaches their scans."""
    return relations(spark, sf_dir).all()


def _split(cols: str) -> list[str]:
    """A select list at its top-level commas."""
    out, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(cols):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(cols[at:i].strip())
                at = i + 1
    return [*out, cols[at:].strip()]


def _order_requests(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    """Every order, asked for its customer and for another one."""
    o = table(spark, sf_dir, "orders")
    user = lambda c: F.concat(F.lit("user:c"), c.cast("string"))
    arm = lambda k, c: o.select((F.col("o_orderkey") * 2 + k).alias("request_id"), user(c).alias("user"), F.lit(relation).alias("relation"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("object"))
    return arm(0, F.col("o_custkey")).unionByName(arm(1, (F.col("o_custkey") + 1) % 150))


REQUESTS_SQL = f"""q AS (SELECT o_orderkey * 2 AS request_id, CONCAT('c', {_V.format('o_custkey')}) AS u, {_V.format('o_orderkey')} AS o FROM orders
  UNION ALL SELECT o_orderkey * 2 + 1, CONCAT('c', {_V.format('(o_custkey + 1) % 150')}), {_V.format('o_orderkey')} FROM orders)"""


def _answers(df: DataFrame) -> DataFrame:
    return df.select("request_id", "user", "object", "allowed")


def _order_check(relation: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _answers(batch_check(model(), relations(spark, sf_dir), _order_requests(spark, sf_dir, relation)))

    return run


def _sql_check(allowed: str) -> str:
    return f"{WITH}, {REQUESTS_SQL} SELECT request_id, 'user:' || u AS \"user\", 'order:' || o AS object, {allowed} AS allowed FROM q"


_OWNS = "EXISTS (SELECT 1 FROM t WHERE object_type = 'order' AND relation = 'owner' AND object_id = q.o AND user_id = q.u)"
_BLOCKED = "EXISTS (SELECT 1 FROM t WHERE object_type = 'order' AND relation = 'blocked' AND object_id = q.o AND user_id = q.u)"
#: Orders' users through customer, nation, region and groups.
_CHAIN = """rv AS (SELECT r.object_id AS region, gm.u FROM t r JOIN gm ON gm.g = r.user_id WHERE r.object_type = 'region'),
  co AS (SELECT c.object_id AS customer, rv.u FROM t c JOIN t n ON n.object_type = 'nation' AND n.object_id = c.user_id JOIN rv ON rv.region = n.user_id WHERE c.object_type = 'customer'),
  oc AS (SELECT object_id AS o, user_id AS customer FROM t WHERE object_type = 'order' AND relation = 'parent')"""
_SEES = f"({_OWNS} OR EXISTS (SELECT 1 FROM oc JOIN co USING (customer) WHERE oc.o = q.o AND co.u = q.u))"


def check_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five levels up: may an order's customer see its lines?"""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    q = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    q = q.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.concat(F.lit("user:c"), ((F.col("o_custkey") + 1) % 150).cast("string")).alias("user"), F.lit("viewer").alias("relation"), F.concat(F.lit("lineitem:"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("object"))
    return _answers(batch_check(model(), relations(spark, sf_dir), q))


def check_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.concat(F.lit("user:c"), (F.col("p_partkey") % 150).cast("string")).alias("user"), F.lit("viewer").alias("relation"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("object"))
    return _answers(batch_check(model(), relations(spark, sf_dir), q))


def _sign_requests(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    """Each order with an amount near its price; every seventh request gives none."""
    amount = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit('{"amount":'), (F.floor("o_totalprice") + F.col("o_orderkey") % 3 - 1).cast("string"), F.lit("}")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("user:c"), F.col("o_custkey").cast("string")).alias("user"), F.lit(relation).alias("relation"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("object"), amount.alias("context"))


def check_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batch_check(model(), relations(spark, sf_dir), _sign_requests(spark, sf_dir, "approver"))
    return out.select("request_id", "allowed", F.col("error").isNotNull().alias("failed"))


def check_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batch_check(model(), relations(spark, sf_dir), _sign_requests(spark, sf_dir, "can_sign"))
    return out.select("request_id", "allowed", F.col("error").isNotNull().alias("failed"))


CONDITION_SQL = """SELECT o_orderkey AS request_id, o_orderpriority = '1-URGENT' AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <= 1 AS allowed,
  o_orderpriority = '1-URGENT' AND o_orderkey % 7 = 0 AS failed FROM orders"""


def check_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups that contain each other."""
    c = table(spark, sf_dir, "customer")
    q = c.select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("user:c"), F.col("c_custkey").cast("string")).alias("user"), F.lit("member").alias("relation"), F.lit("group:AUTOMOBILE").alias("object"))
    return _answers(batch_check(model(), relations(spark, sf_dir), q))


def check_batch_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests under two ids each."""
    q = _order_requests(spark, sf_dir, "can_edit")
    return _answers(batch_check(model(), relations(spark, sf_dir), q.unionByName(q.withColumn("request_id", -F.col("request_id") - 1))))


def check_contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of orders, some of which are blocked by the request itself."""
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("user:c"), F.col("o_custkey").cast("string")).alias("user"), F.lit("can_edit").alias("relation"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("object"), F.col("o_custkey"))
    extra = q.filter("request_id % 2 = 0").select("request_id", F.lit("order").alias("object_type"), F.col("request_id").cast("string").alias("object_id"), F.lit("blocked").alias("relation"), F.lit("user").alias("user_type"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("user_id"))
    return _answers(batch_check(model(), relations(spark, sf_dir), q.drop("o_custkey"), extra))


def check_condition_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of orders that are blocked where a condition over a list holds; where it fails, no answer may be given."""
    text = """
type user
type order
  relations
    define owner: [user]
    define blocked: [user with divides]
    define can_edit: owner but not blocked
condition divides(l: list<int>) {
  l.exists(x, 10 / x > 1)
}
"""
    o = table(spark, sf_dir, "orders")
    user, id_ = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_orderkey").cast("string")
    own = lambda relation, condition: o.select(F.lit("order").alias("object_type"), id_.alias("object_id"), F.lit(relation).alias("relation"), F.lit("user").alias("user_type"), user.alias("user_id"), F.lit(condition).cast("string").alias("condition_name"))
    held = own("owner", None).unionByName(own("blocked", "divides").filter("CAST(object_id AS BIGINT) % 2 = 0")).unionByName(own("blocked", "unheard_of").filter("CAST(object_id AS BIGINT) % 9 = 1"))
    # 0 fails unless 2 decides; 20 alone holds for none
    context = F.concat(F.lit('{"l":['), F.element_at(F.array(*[F.lit(x) for x in ("0", "0,2", "20", "2")]), (F.col("o_orderkey") % 8 / 2 + 1).cast("int")), F.lit("]}"))
    q = o.select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("user:"), user).alias("user"), F.lit("can_edit").alias("relation"), F.concat(F.lit("order:"), id_).alias("object"), context.alias("context"))
    return batch_check(parse_dsl(text), held, q).select("request_id", "allowed", F.col("error").isNotNull().alias("failed"))


def user_colon_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose ids hold colons, in text and in parts."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.concat_ws("", F.lit("user:auth0:"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, F.lit("#member")).when(F.col("c_custkey") % 3 == 1, F.lit("#"))).alias("user"))
    t, i, r = tuples.parse_user(F.col("user"))
    return users.select("request_id", t.alias("user_type"), i.alias("user_id"), r.alias("user_relation"))


def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with malformed and unknown parts, large contexts and large batches (a customer's orders are one)."""
    k = F.col("o_orderkey")
    user = F.when(k % 5 == 0, F.lit("nobody")).otherwise(F.concat(F.lit("user:c"), F.col("o_custkey").cast("string")))
    object_ = F.when(k % 7 == 0, F.lit("order:")).when(k % 11 == 0, F.lit("thing:1")).otherwise(F.concat(F.lit("order:"), k.cast("string")))
    context = F.when(k % 17 == 0, F.concat(F.lit('{"x":"'), F.repeat(F.lit("y"), 11_000), F.lit('"}')))
    q = table(spark, sf_dir, "orders").select(k.alias("request_id"), F.col("o_custkey").alias("batch_id"), user.alias("user"), F.when(k % 13 == 0, F.lit("nothing")).otherwise(F.lit("owner")).alias("relation"), object_.alias("object"), context.alias("context"))
    return batch_check(model(), relations(spark, sf_dir), q, max_items=12, max_context=MAX_CONTEXT).select("request_id", "allowed", "error", "error_kind")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.concat(F.lit("user:c"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), user.alias("user"))


def objects_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_objects(model(), relations(spark, sf_dir), _customers(spark, sf_dir), "viewer", "customer")


def objects_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_objects(model(), relations(spark, sf_dir), _customers(spark, sf_dir), "can_edit", "order", mode="direct")


def objects_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_objects(model(), relations(spark, sf_dir), _customers(spark, sf_dir), "owner", "order", limit=5)


def users_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("request_id"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("object"))
    return list_users(model(), tuple_view(spark, sf_dir), q, "viewer", [("user", None)])


def users_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("object"))
    return list_users(model(), tuple_view(spark, sf_dir), q, "viewer", [("user", None)])


def users_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("object"))
    return list_users(model(), tuple_view(spark, sf_dir), q, "can_edit", [("user", None)], mode="direct")


def expand_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("object_id"))
    return expand_rows(model(), tuple_view(spark, sf_dir), objects, "order", "viewer").withColumn("value", F.array_join("value", ","))


def expand_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("object_id"))
    return expand_rows(model(), tuple_view(spark, sf_dir), objects, "group", "member").withColumn("value", F.array_join("value", ","))


def read_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuples.read_api(tuple_view(spark, sf_dir), object_="order:", relation="blocked", user="user:c3").select(*COLUMNS)


def read_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuples.filtered(tuple_view(spark, sf_dir), condition_name="max_price").select(*COLUMNS)


def read_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ("object_type", "object_id", "relation", "user_type", "user_id", "user_relation")
    df = tuples.filtered(tuple_view(spark, sf_dir), object_type="customer")
    _, token = tuples.page(df, order, 100)
    return tuples.page(df, order, 100, token)[0]


def objects_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuples.objects_by_type(tuple_view(spark, sf_dir), "lineitem")


def objects_under_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.lit("nation").alias("user_type"), F.col("n_nationkey").cast("string").alias("user_id"))
    return tuples.objects_with_parents(tuple_view(spark, sf_dir), "customer", "parent", parents).select("object_id")


def objects_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _customers(spark, sf_dir).select(F.lit("user").alias("user_type"), F.concat(F.lit("c"), F.col("request_id").cast("string")).alias("user_id"))
    return tuples.objects_for_user(tuple_view(spark, sf_dir), "order", "approver", users).select("user_id", "object_id", "condition_name", "condition_context")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cols = {"object_type": F.lit("resource"), "object_id": (F.col("event_id") % 50).cast("string"), "relation": F.lit("viewer"), "user_type": F.lit("user"), "user_id": F.col("user_id").cast("string")}
    none = {c: F.lit(None).cast("string") for c in ("user_relation", "condition_name", "condition_context")}
    op = F.when(F.col("event_type") == "error", F.lit(changes.DELETE)).otherwise(F.lit(changes.WRITE))
    return e.select(*[v.alias(k) for k, v in (cols | none).items()], op.alias("operation"), F.col("ts").cast("timestamp_ntz").alias("changed_at"), F.col("event_id").alias("seq"))


LOG_SQL = "log AS (SELECT 'resource' AS object_type, CAST(event_id % 50 AS VARCHAR) AS object_id, CAST(user_id AS VARCHAR) AS user_id, CASE event_type WHEN 'error' THEN 'TUPLE_OPERATION_DELETE' ELSE 'TUPLE_OPERATION_WRITE' END AS operation, ts AS changed_at, event_id AS seq FROM events)"
AS_OF = "2024-01-15 00:00:00"


def changes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    _, token = changes.read_changes(log, "resource")
    return changes.read_changes(log, "resource", 50, token)[0].select("object_id", "user_id", "operation", "changed_at", "seq")


def state_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.state(change_log(spark, sf_dir)).select("object_id", "user_id", "changed_at", "seq")


def state_then(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.state(change_log(spark, sf_dir), dt.datetime.fromisoformat(AS_OF)).select("object_id", "user_id", "changed_at", "seq")


def state_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of files, followed to its end."""
    from .streaming.changes import TupleTable, follow, read_log

    log = change_log(spark, sf_dir)
    stored(log.limit(0))  # sets the shared folder where the session names none
    base = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/stream-{uuid.uuid4().hex}"
    log.repartition(4, "object_id").write.parquet(f"{base}/log")
    kept, last = TupleTable(spark, f"{base}/tuples"), []
    query = follow(read_log(spark, f"{base}/log", 2), kept, f"{base}/checkpoint", lambda _, n: last.append(n))
    query.awaitTermination()
    return kept.version(max(last, default=-1)).filter("live").select("object_id", "user_id", "changed_at", "seq")


def models_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders taken as model versions, their customers as stores."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("store_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    return latest_models(o)


def write_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked tuples go, tuples of all orders come; what is there already stays once."""
    view = tuple_view(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.lit("order").alias("object_type"), F.col("o_orderkey").cast("string").alias("object_id"), F.lit("owner").alias("relation"), F.lit("user").alias("user_type"), F.concat(F.lit("c"), (F.col("o_custkey") % 100).cast("string")).alias("user_id"))
    return tuples.merged(view.filter("object_type = 'order'"), tuples.with_columns(orders), view.filter("object_type = 'order' AND relation = 'blocked'")).select(*COLUMNS)


def write_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = tuple_view(spark, sf_dir).filter("object_type = 'order' AND relation = 'approver'")
    writes = view.withColumn("condition_name", F.when(F.col("object_id").try_cast("bigint") % 2 == 0, F.lit("other")).otherwise(F.col("condition_name")))
    return tuples.conflicts(view, writes).select("object_id", "user_id", "stored_condition", "written_condition")


def tuple_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages taken as tuples: which can't be written, and why."""
    p = table(spark, sf_dir, "pages").select("page_id", F.lit("document").alias("object_type"), F.col("page_id").cast("string").alias("object_id"), F.when(F.col("page_id") % 3 == 0, F.lit("parent")).otherwise(F.col("url")).alias("relation"), F.lit("source").alias("user_type"), F.col("url").alias("user_id"))
    return tuples.problems(tuples.with_columns(p), model()).select("page_id", "problem")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's customer is expected to edit it."""
    q = _order_requests(spark, sf_dir, "can_edit").filter("request_id % 2 = 0").withColumnRenamed("request_id", "position").withColumn("expectation", F.lit(True))
    return run_assertions(model(), relations(spark, sf_dir), q).select("position", "passed")


def permission_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(model(), tuple_view(spark, sf_dir), [("region", "viewer"), ("group", "member")])


def parsed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples' users to text and back."""
    view = tuple_view(spark, sf_dir).select("object_type", "object_id", "relation", tuples.format_user(F.col("user_type"), F.col("user_id"), F.col("user_relation")).alias("user_text"))
    t, i, r = tuples.parse_user(F.col("user_text"))
    return view.withColumns({"user_type": t, "user_id": i, "user_relation": r})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "check_union_ttu": _order_check("viewer"),
    "check_direct": _order_check("owner"),
    "check_exclusion": _order_check("can_edit"),
    "check_intersection": check_intersection,
    "check_ttu_chain": check_lineitems,
    "check_wildcard": check_wildcard,
    "check_condition": check_condition,
    "check_condition_macro": check_condition_macro,
    "user_colon_ids": user_colon_ids,
    "batch_errors": batch_errors,
    "check_recursive_group": check_groups,
    "check_contextual": check_contextual,
    "batch_check_dedup": check_batch_repeats,
    "assertions_run": assertions,
    "list_objects_complete": objects_complete,
    "list_objects_direct": objects_direct,
    "list_objects_truncated": objects_truncated,
    "list_users_complete": users_complete,
    "list_users_wildcard": users_wildcard,
    "list_users_direct": users_direct,
    "expand_tree": expand_orders,
    "expand_direct_users": expand_groups,
    "read_filter": read_tuples,
    "read_condition": read_condition,
    "read_page_keyset": read_second_page,
    "objects_by_type": objects_of_type,
    "objects_with_parents": objects_under_parents,
    "objects_for_user": objects_of_users,
    "read_changes_page": changes_page,
    "tuple_state": state_now,
    "tuple_state_as_of": state_then,
    "tuple_state_streamed": state_streamed,
    "latest_model": models_latest,
    "write_merge": write_merge,
    "condition_conflicts": write_conflicts,
    "tuple_validation": tuple_problems,
    "user_round_trip": parsed_users,
    "permission_index": permission_table,
}

_T = ", ".join(COLUMNS)
_STATE = f"WITH {LOG_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY object_id, user_id ORDER BY changed_at DESC, seq DESC) AS n FROM log{{}}) SELECT object_id, user_id, changed_at, seq FROM l WHERE n = 1 AND operation = 'TUPLE_OPERATION_WRITE'"

ORACLES: dict[str, str] = {
    "check_direct": _sql_check(_OWNS),
    "check_exclusion": _sql_check(f"({_OWNS} AND NOT {_BLOCKED})"),
    "check_union_ttu": f"{WITH}, {_CHAIN}, {REQUESTS_SQL} SELECT request_id, 'user:' || u AS \"user\", 'order:' || o AS object, {_SEES} AS allowed FROM q",
    "check_intersection": CONDITION_SQL,
    "check_condition": CONDITION_SQL,
    "check_condition_macro": """SELECT o_orderkey AS request_id, o_orderkey % 9 <> 1 AND (o_orderkey % 2 = 1 OR o_orderkey % 8 = 4) AS allowed,
  NOT (o_orderkey % 2 = 0 AND o_orderkey % 8 IN (2, 6)) AND (o_orderkey % 9 = 1 OR o_orderkey % 8 = 0) AS failed FROM orders""",
    "user_colon_ids": "SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 <> 1 THEN 'user' END AS user_type, CASE WHEN c_custkey % 3 <> 1 THEN 'auth0:' || CAST(c_custkey AS VARCHAR) END AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'member' END AS user_relation FROM customer",
    "batch_errors": """WITH q AS (SELECT o_orderkey AS k, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 12 THEN 'the batch is too large' WHEN o_orderkey % 5 = 0 THEN 'invalid user' WHEN o_orderkey % 7 = 0 THEN 'invalid object' WHEN o_orderkey % 11 = 0 THEN 'unknown type'
  WHEN o_orderkey % 13 = 0 THEN 'unknown relation' WHEN o_orderkey % 17 = 0 THEN 'the context is too large' END AS error FROM orders)
  SELECT k AS request_id, error IS NULL AS allowed, error, CASE WHEN error IS NOT NULL THEN 'validation' END AS error_kind FROM q""",
    "check_ttu_chain": f"""{WITH}, {_CHAIN}, q AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS request_id, CONCAT('c', {_V.format('(o_custkey + 1) % 150')}) AS u, {_V.format('o_orderkey')} AS o, CONCAT({_V.format('l_orderkey')}, '-', {_V.format('l_linenumber')}) AS l FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT request_id, 'user:' || u AS "user", 'lineitem:' || l AS object, {_SEES} AS allowed FROM q""",
    "check_wildcard": "SELECT p_partkey AS request_id, 'user:c' || CAST(p_partkey % 150 AS VARCHAR) AS \"user\", 'part:' || CAST(p_partkey AS VARCHAR) AS object, p_size <= 5 AS allowed FROM part",
    "check_recursive_group": f"{WITH} SELECT c_custkey AS request_id, 'user:c' || CAST(c_custkey AS VARCHAR) AS \"user\", 'group:AUTOMOBILE' AS object, EXISTS (SELECT 1 FROM gm WHERE g = 'AUTOMOBILE' AND u = 'c' || CAST(c_custkey AS VARCHAR)) AS allowed FROM customer",
    "check_contextual": "SELECT o_orderkey AS request_id, 'user:c' || CAST(o_custkey AS VARCHAR) AS \"user\", 'order:' || CAST(o_orderkey AS VARCHAR) AS object, o_orderstatus <> 'F' AND o_orderkey % 2 <> 0 AS allowed FROM orders",
    "batch_check_dedup": f"{WITH}, {REQUESTS_SQL}, a AS (SELECT request_id, 'user:' || u AS \"user\", 'order:' || o AS object, ({_OWNS} AND NOT {_BLOCKED}) AS allowed FROM q) SELECT * FROM a UNION ALL SELECT -request_id - 1, \"user\", object, allowed FROM a",
    "assertions_run": "SELECT o_orderkey * 2 AS position, o_orderstatus <> 'F' AS passed FROM orders",
    "list_objects_complete": f"{WITH}, {_CHAIN} SELECT DISTINCT c_custkey AS request_id, customer AS object_id FROM customer JOIN co ON co.u = 'c' || CAST(c_custkey AS VARCHAR)",
    "list_objects_direct": "SELECT c_custkey AS request_id, CAST(o_orderkey AS VARCHAR) AS object_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'",
    "list_objects_truncated": "WITH o AS (SELECT c_custkey AS request_id, CAST(o_orderkey AS VARCHAR) AS object_id, row_number() OVER (PARTITION BY c_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) AS n, count(*) OVER (PARTITION BY c_custkey) > 5 AS truncated FROM customer JOIN orders ON o_custkey = c_custkey) SELECT request_id, object_id, truncated FROM o WHERE n <= 5",
    "list_users_complete": f"{WITH}, {_CHAIN} SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS request_id, 'object' AS kind, 'user' AS user_type, u AS user_id, CAST(NULL AS VARCHAR) AS user_relation, false AS excluded FROM nation JOIN rv ON rv.region = CAST(n_regionkey AS VARCHAR)",
    "list_users_wildcard": "SELECT p_partkey AS request_id, 'wildcard' AS kind, 'user' AS user_type, '*' AS user_id, CAST(NULL AS VARCHAR) AS user_relation, false AS excluded FROM part WHERE p_size <= 5",
    "list_users_direct": "SELECT o_orderkey AS request_id, 'object' AS kind, 'user' AS user_type, 'c' || CAST(o_custkey AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS user_relation, o_orderstatus = 'F' AS excluded FROM orders",
    "expand_tree": "SELECT CAST(o_orderkey AS VARCHAR) AS object_id, '0' AS path, 'union' AS node_type, '' AS value FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '0.0', 'tuple_to_userset', 'customer:' || CAST(o_custkey AS VARCHAR) || '#viewer' FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '0.1', 'computed', 'owner' FROM orders",
    "expand_direct_users": f"{WITH} SELECT c.s AS object_id, '0' AS path, 'users' AS node_type, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT user_type || ':' || user_id || coalesce('#' || user_relation, '') AS x FROM t WHERE object_type = 'group' AND object_id = c.s)) AS value FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) c",
    "read_filter": f"WITH {TUPLES_SQL} SELECT {_T} FROM t WHERE object_type = 'order' AND relation = 'blocked' AND user_type = 'user' AND user_id = 'c3' AND user_relation IS NULL",
    "read_condition": f"WITH {TUPLES_SQL} SELECT {_T} FROM t WHERE condition_name = 'max_price'",
    "read_page_keyset": f"WITH {TUPLES_SQL} SELECT {_T} FROM t WHERE object_type = 'customer' ORDER BY object_id, relation, user_type, user_id LIMIT 100 OFFSET 100",
    "objects_by_type": f"WITH {TUPLES_SQL} SELECT DISTINCT object_id FROM t WHERE object_type = 'lineitem'",
    "objects_with_parents": "SELECT CAST(c_custkey AS VARCHAR) AS object_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0",
    "objects_for_user": f"WITH {TUPLES_SQL} SELECT user_id, object_id, condition_name, condition_context FROM t JOIN customer ON user_id = 'c' || CAST(c_custkey AS VARCHAR) WHERE object_type = 'order' AND relation = 'approver'",
    "read_changes_page": f"WITH {LOG_SQL} SELECT object_id, user_id, operation, changed_at, seq FROM log ORDER BY changed_at, seq LIMIT 50 OFFSET 50",
    "tuple_state": _STATE.format(""),
    "tuple_state_streamed": _STATE.format(""),
    "tuple_state_as_of": _STATE.format(f" WHERE changed_at <= TIMESTAMP '{AS_OF}'"),
    "latest_model": "SELECT id, store_id, created_at FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS store_id, o_orderdate AS created_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS n FROM orders) WHERE n = 1",
    "write_merge": f"WITH {TUPLES_SQL} SELECT {_T} FROM t WHERE object_type = 'order' AND relation <> 'blocked' UNION SELECT 'order', CAST(o_orderkey AS VARCHAR), 'owner', 'user', 'c' || CAST(o_custkey % 100 AS VARCHAR), NULL, NULL, NULL FROM orders",
    "condition_conflicts": f"WITH {TUPLES_SQL} SELECT object_id, user_id, condition_name AS stored_condition, 'other' AS written_condition FROM t WHERE object_type = 'order' AND relation = 'approver' AND CAST(object_id AS BIGINT) % 2 = 0",
    "tuple_validation": "SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN CASE WHEN page_id % 3 = 0 THEN 'user_id is empty' ELSE 'relation is empty' END WHEN page_id % 3 <> 0 AND strlen(url) > 50 THEN 'relation is longer than 50 bytes' WHEN strlen(url) > 512 THEN 'user_id is longer than 512 bytes' WHEN page_id % 3 <> 0 AND regexp_matches(url, '[:#@\\s]') THEN 'relation has a forbidden character' WHEN page_id % 3 <> 0 THEN 'relation is not defined on the type' END AS problem FROM pages",
    "user_round_trip": f"WITH {TUPLES_SQL} SELECT object_type, object_id, relation, user_type || ':' || user_id || coalesce('#' || user_relation, '') AS user_text, user_type, user_id, user_relation FROM t",
    "permission_index": f"{WITH} SELECT 'region' AS object_type, 'viewer' AS relation, r.object_id, 'user:' || gm.u AS \"user\" FROM t r JOIN gm ON gm.g = r.user_id WHERE r.object_type = 'region' UNION SELECT 'group', 'member', g, 'user:' || u FROM gm",
}
