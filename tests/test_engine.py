import json
import random

import pytest
from pyspark.sql import functions as F

from aclweave.model import Computed, Difference, FromParent, Intersection, This, Union, parse_dsl
from aclweave.operators import batch_check, check, expand, expand_rows, list_objects, list_users, run_assertions
from aclweave.operators.index import materialise
from aclweave.plans.strata import NotStratified, strata
from aclweave.sources.tuples import from_text

WORK = parse_dsl("""
model
  schema 1.1
type user
type group
  relations
    define member: [user, group#member]
type folder
  relations
    define parent: [folder]
    define viewer: [user, user:*, group#member] or viewer from parent
type doc
  relations
    define parent: [folder]
    define blocked: [user]
    define owner: [user with small]
    define viewer: (owner or viewer from parent) but not blocked
    define both: owner and viewer
condition small(n: int) { n < 10 }
""")
TUPLES = [
    ("user:a", "member", "group:g"), ("group:g#member", "member", "group:h"), ("group:h#member", "member", "group:g"), ("group:h#member", "viewer", "folder:x"), ("folder:x", "parent", "folder:y"), ("folder:y", "parent", "doc:1"),
    ("user:b", "owner", "doc:1", "small", {}), ("user:a", "blocked", "doc:2"), ("folder:y", "parent", "doc:2"), ("user:*", "viewer", "folder:z"), ("folder:z", "parent", "doc:3"), ("user:a", "blocked", "doc:3"),
]
REQUESTS = [
    ("user:a", "viewer", "doc:1", None, True, None), ("user:a", "viewer", "doc:2", None, False, None), ("user:b", "viewer", "doc:1", {"n": 3}, True, None), ("user:b", "viewer", "doc:1", {"n": 30}, False, None),
    ("user:b", "viewer", "doc:1", None, False, "condition failed"), ("user:q", "viewer", "doc:3", None, True, None), ("user:a", "viewer", "doc:3", None, False, None), ("user:b", "both", "doc:1", {"n": 3}, True, None),
    ("group:g#member", "viewer", "folder:y", None, True, None), ("user:a", "nope", "doc:1", None, False, "unknown relation"), ("bad", "viewer", "doc:1", None, False, "invalid user"), ("user:*", "viewer", "folder:z", None, False, None),
    ("user:a", "viewer", "doc:1", None, True, None),
]


@pytest.fixture(scope="module")
def stored(spark):
    return from_text(spark, TUPLES)


def test_batch(spark, stored):
    q = spark.createDataFrame([(i, u, r, o, json.dumps(c) if c else None) for i, (u, r, o, c, *_) in enumerate(REQUESTS)], "request_id int, user string, relation string, object string, context string")
    got = {r.request_id: (r.allowed, r.error) for r in batch_check(WORK, stored, q).collect()}
    assert got == {i: (a, e) for i, (*_, a, e) in enumerate(REQUESTS)}


def test_one_check_with_contextual_tuples(spark, stored):
    assert not check(WORK, stored, "user:c", "viewer", "doc:1")
    assert check(WORK, stored, "user:c", "viewer", "doc:1", contextual=from_text(spark, [("user:c", "member", "group:g")]))
    with pytest.raises(ValueError, match="unknown"):
        check(WORK, stored, "user:c", "nope", "doc:1")


def test_lists(spark, stored):
    q = spark.createDataFrame([(0, "user:a"), (1, "user:zz"), (2, "user:*")], "request_id int, user string")
    assert {tuple(r) for r in list_objects(WORK, stored, q, "viewer", "doc").collect()} == {(0, "1"), (1, "3")}
    assert {tuple(r) for r in list_objects(WORK, stored, q, "viewer", "doc", mode="direct").collect()} == {(1, "3")}
    assert list_objects(WORK, stored, q, "viewer", "nothing").collect() == []
    cut = list_objects(WORK, stored, q, "viewer", "folder", limit=2).collect()
    assert {(r.request_id, r.object_id, r.truncated) for r in cut} == {(0, "x", True), (0, "y", True), (1, "z", False)}
    o = spark.createDataFrame([(0, "doc:1", '{"n":1}'), (1, "doc:3", None)], "request_id int, object string, context string")
    users = {tuple(r) for r in list_users(WORK, stored, o, "viewer", [("user", None)]).collect()}
    assert users == {(0, "object", "user", "a", None, False), (0, "object", "user", "b", None, False), (1, "wildcard", "user", "*", None, False), (1, "object", "user", "a", None, True)}
    sets = {tuple(r) for r in list_users(WORK, stored, o, "viewer", [("group", "member")]).collect()}
    assert sets == {(0, "userset", "group", "g", "member", False), (0, "userset", "group", "h", "member", False)}
    direct = {tuple(r) for r in list_users(WORK, stored, o, "viewer", [("user", None)], mode="direct").collect()}
    assert (0, "object", "user", "b", None, False) in direct


def test_expand(spark, stored):
    tree = expand(WORK, stored, "doc:1", "viewer")
    assert tree["difference"]["base"]["union"][1]["leaf"] == {"tupleset": "doc:1#parent", "computed": ["folder:y#viewer"]}
    rows = expand_rows(WORK, stored, spark.createDataFrame([("x",), ("none",)], "object_id string"), "folder", "viewer").collect()
    assert {(r.object_id, r.path): r.value for r in rows if r.node_type == "users"} == {("x", "0.0"): ["group:h#member"], ("none", "0.0"): []}


def test_assertions_and_permission_table(spark, stored):
    a = spark.createDataFrame([(0, "user:a", "viewer", "doc:1", True), (1, "user:a", "viewer", "doc:2", True)], "position int, user string, relation string, object string, expectation boolean")
    assert [r.passed for r in run_assertions(WORK, stored, a).orderBy("position").collect()] == [True, False]
    rows = {(r.object_id, r.user) for r in materialise(WORK, stored, [("group", "member")]).collect()}
    assert rows == {("g", "user:a"), ("h", "user:a")}


def test_link_conditions(spark):
    m = parse_dsl("type user\ntype f\n relations\n define viewer: [user]\ntype d\n relations\n define parent: [f with c]\n define viewer: viewer from parent\ncondition c(n: int) { n == 1 }")
    t = from_text(spark, [("user:a", "viewer", "f:1"), ("f:1", "parent", "d:1", "c")])
    assert check(m, t, "user:a", "viewer", "d:1")
    assert not check(m, t, "user:a", "viewer", "d:1", {"n": 2}, link_conditions=True)
    assert check(m, t, "user:a", "viewer", "d:1", {"n": 1}, link_conditions=True)


def test_unstratified_models_are_refused():
    m = parse_dsl("type user\ntype d\n relations\n define p: [d]\n define a: [user] but not a from p")
    with pytest.raises(NotStratified):
        strata(m, [("d", "a")])


def _naive(model, tuples, user):
    """Least fixpoint by brute force, stratum by stratum."""
    held = {}
    objects = {(o[0], o[1]) for *_, o in tuples} | {(u[0], u[1]) for u, *_ in tuples}

    def holds(t, i, r, rw):
        d = model.relation(t, r)
        if isinstance(rw, This):
            for u, rel, o in tuples:
                if o != (t, i) or rel != r:
                    continue
                if not any(x.type == u[0] and x.relation == u[2] for x in d.types):
                    continue
                if u == user or (u[2] is None and u[1] == "*" and user[2] is None and u[0] == user[0]) or (u[2] and (u[0], u[1], u[2]) in held):
                    return True
            return False
        if isinstance(rw, Computed):
            return (t, i, rw.relation) in held
        if isinstance(rw, FromParent):
            return any(o == (t, i) and rel == rw.tupleset and u[2] is None and (u[0], u[1], rw.relation) in held for u, rel, o in tuples)
        if isinstance(rw, Difference):
            return holds(t, i, r, rw.base) and not holds(t, i, r, rw.subtract)
        return (any if isinstance(rw, Union) else all)(holds(t, i, r, c) for c in rw.children())

    assert Intersection
    for group in strata(model, [(t, r) for t, rs in model.types.items() for r in rs]):
        grown = True
        while grown:
            grown = False
            for t, r in group:
                for o in objects:
                    if o[0] == t and (t, o[1], r) not in held and holds(t, o[1], r, model.relation(t, r).rewrite):
                        held[(t, o[1], r)] = grown = True
    return held


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_agree_with_brute_force(spark, seed):
    m = parse_dsl("type user\ntype group\n relations\n define member: [user, user:*, group#member]\ntype doc\n relations\n define parent: [doc]\n define banned: [user, group#member]\n define reader: [user, group#member] or reader from parent\n define writer: [user]\n define can: reader but not banned\n define sign: writer and can")
    rng = random.Random(seed)
    ids = lambda k: str(rng.randrange(k))
    user = lambda: ("user", "*" if rng.random() < 0.05 else ids(4), None)
    group = lambda: ("group", ids(4), "member")
    tuples = set()
    for _ in range(26):
        kind = rng.randrange(5)
        tuples.add([(rng.choice([user, group])(), "member", ("group", ids(4))), (("doc", ids(5), None), "parent", ("doc", ids(5))), (rng.choice([user, group])(), "banned", ("doc", ids(5))), (rng.choice([user, group])(), "reader", ("doc", ids(5))), (user(), "writer", ("doc", ids(5)))][kind])
    tuples = [t for t in tuples if not (t[1] in ("banned", "reader", "writer") and t[0][1] == "*")]
    text = lambda u: f"{u[0]}:{u[1]}" + (f"#{u[2]}" if u[2] else "")
    df = from_text(spark, [(text(u), r, f"{o[0]}:{o[1]}") for u, r, o in tuples])
    users = [("user", str(i), None) for i in range(5)] + [("group", "1", "member")]
    want = {(text(u), r, f"doc:{i}"): ("doc", str(i), r) in held for u in users for held in [_naive(m, tuples, u)] for r in ("can", "sign", "reader") for i in range(5)}
    q = spark.createDataFrame([(k, *x) for k, x in enumerate(want)], "request_id int, user string, relation string, object string")
    got = {(r.user, r.relation, r.object): r.allowed for r in batch_check(m, df, q).collect()}
    assert got == want
    who = spark.createDataFrame([(text(u), text(u)) for u in users], "request_id string, user string")
    listed = {(r.request_id, "can", f"doc:{r.object_id}") for r in list_objects(m, df, who, "can", "doc").collect()}
    assert listed == {k for k, v in want.items() if v and k[1] == "can"}


def test_demand_reads_only_what_is_asked(spark, stored):
    q = spark.createDataFrame([(0, "user:a", "blocked", "doc:2")], "request_id int, user string, relation string, object string")
    out = batch_check(WORK, stored, q).filter(F.col("allowed"))
    assert out.count() == 1


def test_deep_groups_whose_rounds_are_merged(spark, monkeypatch):
    monkeypatch.setattr("aclweave.plans.evaluate.MERGED", 2)
    model = parse_dsl("type user\ntype group\n  relations\n    define member: [user, group#member]\n")
    rows = from_text(spark, [("user:a", "member", "group:0")] + [(f"group:{i}#member", "member", f"group:{i + 1}") for i in range(6)])
    asked = spark.createDataFrame([(i, "user:a", "member", f"group:{i}") for i in range(8)], "request_id bigint, user string, relation string, object string")
    assert {r.request_id for r in batch_check(model, rows, asked).filter("allowed").collect()} == set(range(7))
    found = list_objects(model, rows, asked.filter("request_id = 0"), "member", "group")
    assert {r.object_id for r in found.collect()} == {str(i) for i in range(7)}


def test_a_failing_or_unknown_condition_never_grants(spark):
    model = parse_dsl("""
type user
type doc
  relations
    define owner: [user]
    define blocked: [user with c]
    define can: owner but not blocked
condition c(l: list<int>) {
  request.l.exists(x, 10 / x > 1)
}
""")
    rows = from_text(spark, [("user:a", "owner", "doc:1"), ("user:a", "blocked", "doc:1", "c", None), ("user:a", "owner", "doc:2"), ("user:a", "blocked", "doc:2", "nowhere", None), ("user:a", "owner", "doc:3")])
    ask = lambda l: [(0, "user:a", "can", "doc:1", l), (1, "user:a", "can", "doc:2", l), (2, "user:a", "can", "doc:3", l)]  # noqa: E731, E741
    for context, first in (('{"l":[0]}', (False, "condition failed")), ('{"l":[0,2]}', (False, None)), ('{"l":[10]}', (True, None))):
        q = spark.createDataFrame(ask(context), "request_id int, user string, relation string, object string, context string")
        got = {r.request_id: (r.allowed, r.error) for r in batch_check(model, rows, q).collect()}
        assert got == {0: first, 1: (False, "condition failed"), 2: (True, None)}
    plain = parse_dsl("type user\ntype doc\n relations\n define owner: [user]\n define blocked: [user]\n define can: owner but not blocked")
    q = spark.createDataFrame(ask(None), "request_id int, user string, relation string, object string, context string")
    assert {r.request_id: (r.allowed, r.error) for r in batch_check(plain, rows, q).collect()} == {0: (False, "condition failed"), 1: (False, "condition failed"), 2: (True, None)}


def test_users_of_equal_tuples_are_evaluated_once(spark, monkeypatch):
    from aclweave.operators import listing

    model = parse_dsl("type user\ntype group\n relations\n define member: [user, user:*, group#member]\ntype doc\n relations\n define owner: [user with c]\n define parent: [group]\n define viewer: owner or member from parent\ncondition c(n: int) { n == 1 }")
    rows = from_text(spark, [(f"user:{i}", "member", f"group:{i % 2}") for i in range(40)] + [("group:0#member", "member", "group:1")] + [(f"group:{i % 2}", "parent", f"doc:{i}") for i in range(6)] + [("user:1", "owner", "doc:0", "c"), ("user:*", "member", "group:w"), ("group:w", "parent", "doc:w")])
    q = spark.createDataFrame([(i, f"user:{i}", '{"n":1}' if i == 1 else None) for i in range(40)] + [(40, "user:none", None), (41, "user:*", None), (42, "user:3", None)], "request_id int, user string, context string")
    want = {(i, d) for i in range(42) if i < 40 for d in ("1", "3", "5")} | {(i, d) for i in range(0, 40, 2) for d in ("0", "2", "4")} | {(i, "w") for i in [*range(41), 42]} | {(1, "0")} | {(42, d) for d in ("1", "3", "5")}
    seen, run = [], listing.Evaluator.run
    monkeypatch.setattr(listing.Evaluator, "run", lambda self, *a: (seen.append(self.seeds.count()), run(self, *a))[1])
    got = [tuple(r) for r in list_objects(model, rows, q, "viewer", "doc").collect()]
    assert (len(got), set(got)) == (len(want), want)
    assert seen == [4]  # members of either group, user 1 with its own tuple and context, and users whom no tuple names
    monkeypatch.setattr(listing, "SIDE", 3)
    monkeypatch.setattr(listing, "DEALT", 0)
    monkeypatch.setattr(listing, "NAMED", 1)
    own = from_text(spark, [("user:3", "member", "group:0")]).withColumn("request_id", F.lit(42))
    got = [tuple(r) for r in list_objects(model, rows, q, "viewer", "doc", contextual=own).collect()]
    want |= {(42, d) for d in ("0", "2", "4")}
    assert (len(got), set(got)) == (len(want), want)


def test_large_answers_are_dealt_by_few_cells_and_written_small(spark, monkeypatch, tmp_path):
    from aclweave.operators import listing
    from aclweave.plans.cut import stored as kept

    of = kept(spark.range(3000).selectExpr("id AS request_id", "CAST(0 AS BIGINT) AS seed_id").unionByName(spark.createDataFrame([(None, 0), (7, 0), (7, 0), (9000, 1), (9001, 2)], "request_id bigint, seed_id bigint")))
    found = kept(spark.range(2990).selectExpr("CAST(0 AS BIGINT) AS seed_id", "CAST(id AS STRING) AS object_id").unionByName(spark.createDataFrame([(0, None), (0, ""), (1, "a"), (3, "b")], "seed_id bigint, object_id string")))
    out = listing._dealt(of, found)
    out.write.parquet(str(tmp_path / "answer"))
    got = spark.read.parquet(str(tmp_path / "answer"))
    each = got.groupBy("request_id").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("object_id", F.lit("none"))).alias("d"), F.count("object_id").alias("named"))
    want = {r: (2992, 2992, 2991) for r in [*range(3000), None]} | {7: (3 * 2992, 2992, 3 * 2991), 9000: (1, 1, 1)}
    assert {r.request_id: (r.n, r.d, r.named) for r in each.collect()} == want
    size = sum(f.stat().st_size for f in (tmp_path / "answer").glob("*.parquet"))
    assert size < 0.4 * got.count()  # bytes a pair
    monkeypatch.setattr(listing, "SIDE", 4)
    monkeypatch.setattr(listing, "CELLS", 9, raising=False)
    monkeypatch.setattr(listing, "RUN", 2, raising=False)
    monkeypatch.setattr(listing, "DEALT", 0)
    few, some = kept(of.filter("request_id % 50 = 7 OR request_id IS NULL")), kept(found.filter("object_id LIKE '%53' OR object_id IS NULL OR object_id = ''"))
    out = listing._dealt(few, some)
    assert out.rdd.getNumPartitions() <= 16  # of 4 by 4 pairs the cells would be about 130
    want = few.join(some, "seed_id").select("request_id", "object_id")
    assert (out.count(), out.exceptAll(want).count(), want.exceptAll(out).count()) == (want.count(), 0, 0)


def test_a_batchs_requests_are_computed_once(spark, stored):
    seen = spark.sparkContext.accumulator(0)
    touched = F.udf(lambda x: (seen.add(1), x)[1], "string").asNondeterministic()
    q = spark.createDataFrame([(0, "user:a", "blocked", "doc:2"), (1, "user:b", "blocked", "doc:2")], "request_id int, user string, relation string, object string")
    got = {r.request_id: r.allowed for r in batch_check(WORK, stored, q.withColumn("user", touched("user"))).collect()}
    assert (got, seen.value) == ({0: True, 1: False}, 2)
