import datetime as dt

import pytest
from pyspark.sql import functions as F

from aclweave.model import parse_dsl
from aclweave.queries import change_log
from aclweave.sources import changes, tuples
from aclweave.sources.catalog import Catalog
from aclweave.sources.tuples import ConditionConflict, from_text
from aclweave.streaming.changes import TupleTable, apply_changes

MODEL = parse_dsl("type user\ntype doc\n relations\n define viewer: [user, user with c]\ncondition c(n: int) { n > 1 }")


def test_text_forms(spark):
    df = spark.createDataFrame([("user:a",), ("g:x#m",), ("bad",), ("a:b:c",), ("a:b#",), ("user:*",)], "u string")
    t, i, r = tuples.parse_user(F.col("u"))
    assert [tuple(x) for x in df.select(t, i, r).collect()] == [("user", "a", None), ("g", "x", "m"), (None, None, None), ("a", "b:c", None), (None, None, None), ("user", "*", None)]
    o = spark.createDataFrame([("doc:a:b",), ("doc:",), (":x",), ("doc",)], "o string")
    assert [tuple(x) for x in o.select(*tuples.parse_object(F.col("o"))).collect()] == [("doc", "a:b"), (None, None), (None, None), (None, None)]


def test_filters_and_pages(spark):
    df = from_text(spark, [(f"user:{i:02d}", "viewer", "doc:1") for i in range(25)] + [("g:x#m", "viewer", "doc:2")])
    assert tuples.read_api(df, object_="doc:").count() == 26
    assert tuples.read_api(df, object_="nocolon").count() == 26
    assert tuples.read_api(df, user="g:x#m").count() == 1
    assert tuples.read_api(df, user="g:x").count() == 0
    with pytest.raises(ValueError):
        tuples.filtered(df, user="nouser")
    seen, token = [], None
    while True:
        page, token = tuples.page(df, tuples.KEY, 10, token)
        seen += [r.user_id for r in page.collect()]
        if token is None:
            break
    assert len(seen) == 26 == len(set(seen))


def test_problems(spark):
    rows = [("doc", "1", "viewer", "user", "a", None, None, None), ("", "1", "viewer", "user", "a", None, None, None), ("doc", "1", "no:pe", "user", "a", None, None, None), ("doc", "1", "viewer", "user", "a", None, "zz", None), ("doc", "1", "viewer", "user", "a", None, "c", "[" * 11 + "]" * 11), ("doc", "é" * 200, "viewer", "user", "a", None, None, None)]
    got = [r.problem for r in tuples.problems(spark.createDataFrame(rows, tuples.SCHEMA), MODEL).collect()]
    assert got[0] is None and all(got[1:])


def test_writes(spark):
    stored = from_text(spark, [("user:a", "viewer", "doc:1", "c", {"n": 1}), ("user:b", "viewer", "doc:1")])
    after = tuples.merged(stored, from_text(spark, [("user:b", "viewer", "doc:1"), ("user:c", "viewer", "doc:1"), ("user:c", "viewer", "doc:1")]), from_text(spark, [("user:a", "viewer", "doc:1")]))
    assert sorted(r.user_id for r in after.collect()) == ["b", "c"]
    with pytest.raises(ConditionConflict):
        tuples.merged(stored, from_text(spark, [("user:a", "viewer", "doc:1")]))


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    s = c.create_store("one")
    c.write_model(s, MODEL)
    m = c.write_model(s, parse_dsl("type user\ntype doc\n relations\n define viewer: [user]\n define editor: [user]"))
    assert c.model(s).id == m and c.models(s).count() == 2
    c.write(s, from_text(spark, [("user:a", "viewer", "doc:1"), ("user:b", "editor", "doc:1")]))
    c.write(s, None, from_text(spark, [("user:a", "viewer", "doc:1"), ("user:zz", "viewer", "doc:1")]))
    assert [r.user_id for r in c.tuples(s).collect()] == ["b"]
    assert c.log(s).count() == 4
    with pytest.raises(ValueError, match="not defined"):
        c.write(s, from_text(spark, [("user:a", "nothing", "doc:1")]))
    c.write_assertions(s, m, [{"user": "user:b", "relation": "editor", "object": "doc:1", "expectation": True}])
    assert c.assertions(s, m).count() == 1
    c.delete_store(s)
    with pytest.raises(KeyError):
        c.tuples(s)


def test_changes_and_replays(spark):
    log = change_log(spark, "/root/testdata/sf0.001")
    page, token = changes.read_changes(log, "resource", 30)
    assert page.count() == 30 and token
    whole = changes.state(log)
    half = dt.datetime(2024, 1, 10)
    empty = TupleTable(spark, "unused").version(-1)
    first, second = log.filter(F.col("changed_at") <= F.lit(half)), log.filter(F.col("changed_at") > F.lit(half))
    late = apply_changes(apply_changes(apply_changes(empty, second), first), second)
    key = ["object_id", "user_id", "seq"]
    assert {tuple(r) for r in late.filter("live").select(*key).collect()} == {tuple(r) for r in whole.select(*key).collect()}


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    log = change_log(spark, "/root/testdata/sf0.001").select(*tuples.COLUMNS, "operation", "changed_at", "seq")
    one = log.orderBy("changed_at", "seq").limit(1)
    rest = log.join(one.select("seq"), "seq", "left_anti")
    table = TupleTable(spark, f"file://{tmp_path}/current", buckets=8)
    table.upsert(rest, 0)
    for _ in range(2):  # a replay writes the same again
        table.upsert(one, 1)
        key = ["object_id", "user_id", "seq"]
        assert {tuple(r) for r in table.version(1).filter("live").select(*key).collect()} == {tuple(r) for r in changes.state(log).select(*key).collect()}
    assert [p.name[:6] for p in (tmp_path / "current/data/v1").glob("bucket=*")] == ["bucket"]
    table.upsert(one.limit(0), 2)
    assert table.version(2).count() == table.version(1).count() >= table.version(0).count()


def test_table_layout_prunes(spark, tmp_path):
    df = from_text(spark, [("user:a", "viewer", "doc:1"), ("user:a", "viewer", "folder:1")])
    tuples.write_table(df, str(tmp_path / "t"))
    plan = tuples.read(spark, str(tmp_path / "t")).filter("object_type = 'doc' AND relation = 'viewer'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(object_type" in plan


def test_a_deleted_store_leaves_nothing(spark, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/again")
    cat.create_store("one", "s")
    first = cat.write_model("s", MODEL)
    cat.write("s", from_text(spark, [("user:a", "viewer", "doc:1")]))
    second = cat.write_model("s", MODEL)
    cat.delete_model("s", second)
    assert cat.model("s").id == first and [r.id for r in cat.models("s").collect()] == [first]
    with pytest.raises(KeyError):
        cat.model("s", second)
    with pytest.raises(ValueError, match="empty"):
        cat.write("s", None, from_text(spark, [("user:a", "viewer", "doc:1")]).withColumn("object_id", F.lit("")))
    cat.delete_store("s")
    cat.create_store("two", "s")
    assert cat.tuples("s").count() == 0 and cat.models("s").count() == 0
    with pytest.raises(KeyError):
        cat.model("s")
