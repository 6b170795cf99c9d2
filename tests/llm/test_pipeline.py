import subprocess
import sys

import corpus_pipeline
import numpy as np

from aclweave.llm import secretscan
from aclweave.llm.base import table

from .test_joins import brute_components

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in docs.collect()} if "text" in docs.columns else set()
        docs = stage(spark, docs, DIR).cache()
        if name != "best-fit packing":
            assert docs.columns == columns
            kept[name] = (before, {(r.doc_id, r.text) for r in docs.collect()})
    before, after = kept["language identification"]
    assert after <= before and len(after) >= 0.98 * len(before)
    before, after = kept["near duplicates"]
    rows = sorted(before)
    assert {d for d, _, c in brute_components(rows) if d == c} == {d for d, _ in after} and after <= before
    before, after = kept["benchmark decontamination"]
    items = [r.text for r in table(spark, DIR, "benchmark").collect()]
    assert {x for x in before if not any(i in x[1] for i in items)} == after
    before, after = kept["secret scan"]
    assert {d for d, _ in before} == {d for d, _ in after} and not any(secretscan.base_spans(t) for _, t in after)
    assert {d for d, _ in after} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 2048


def test_odd_and_empty_tables(spark, odd, nothing):
    for frame in (odd, nothing):
        docs = frame.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DIR)
        assert docs.count() >= 0


def test_the_rest_stands_alone(tmp_path):
    """Without this subpackage the registry still has the other queries."""
    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('aclweave.llm') or n == 'corpus_pipeline' else f(n, *a); import __spark_entry__ as e; q = e.queries(); assert 'check_direct' in q and not any(x.startswith('op') for x in q); assert not any(m.startswith('aclweave.llm') for m in sys.modules)"
    root = corpus_pipeline.__file__.rpartition("/")[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
    assert np.isfinite(1.0)


def test_near_duplicates_are_judged_by_row(spark):
    """A row goes for its own text: a doc_id that stays with one text doesn't keep another, and null ids aren't one row."""
    a, b, c = "one two three four five six seven", "other words stand here and nothing else", "third text of quite some other words"
    rows = [(3, a, 1), (7, b, 2), (7, a, 3), (None, a, 4), (None, b, 5), (None, c, 6), (None, c, 7), (9, "", 8), (9, None, 9), (9, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _key int")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()}
    assert got == {(3, a), (7, b), (None, c), (9, ""), (9, None)}
    assert corpus_pipeline.near_duplicates(spark, docs, DIR).count() == len(got)
