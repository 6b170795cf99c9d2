import numpy as np
from pyspark.sql import functions as F

from aclweave.llm import langid, toxicity
from aclweave.llm.base import is_held_out, table

DIR = "/root/testdata/sf0.01"


def test_kneser_ney_is_a_distribution():
    counts = {"x": langid._counts(["abab abba baba abab"] * 3), "y": langid._counts(["cdcd dccd ddcc cdcd"])}
    m = langid.Models(counts)
    letters = langid.letter_table()
    e, n = m.cross_entropy(["abba", "cdcd", "", "123"], letters)
    assert e[0, 0] < e[0, 1] and e[1, 1] < e[1, 0] and list(n) == [4, 4, 0, 0]
    # all characters and one unknown add up to one
    for j in range(2):
        assert abs(np.exp(m.grams[0][1][:, j]).sum() + np.exp(m.contexts[0][1][0, j] + m.floor) - 1) < 1e-3


def test_language_accuracy_and_contract(spark):
    out = langid.op5_language_id(spark, DIR)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.join(table(spark, DIR, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_rejection_and_odd_rows(spark, odd, nothing):
    docs = table(spark, DIR, "documents").select("doc_id", "text", "lang")
    models = langid.fit(docs)
    strange = spark.createDataFrame([(1, "qzxj kvwq zzqx jjkq xvzq wqzx kqjx zvxq " * 5, 1.0), (2, "The and attion to thanedble the anea eriner", 1.0)], "doc_id bigint, text string, score double")
    got = {r.doc_id: r for r in langid.identify(strange, models).collect()}
    assert got[1].rejected and not got[2].rejected and got[2].lang_pred == "en"
    rows = langid.identify(odd, models).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert langid.identify(nothing, models).count() == 0
    none = langid.fit(nothing)
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def test_toxicity_accuracy_and_contract(spark):
    large = "/root/testdata/sf0.1"  # some four hundred toxic labels
    out = toxicity.op1_toxicity(spark, large)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(table(spark, large, "labels"), "doc_id").collect()
    assert out.count() == table(spark, large, "documents").count()
    assert all((r.predicted == 1) == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    hits = [r for r in held if r.toxic]
    assert sum(r.predicted for r in hits) >= 0.65 * len(hits)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.03 * len(held)


def test_negative_risk_is_stepped_back():
    rng = np.random.default_rng(0)
    pos = [np.array([1, *rng.integers(10, 60, 5)]) for _ in range(60)]
    neg = [np.array([2, *rng.integers(10, 60, 5)]) for _ in range(400)]
    w, b = toxicity.train([np.unique(p) for p in pos], [np.unique(x) for x in neg + pos[:40]], 0.1, steps=480)
    assert w[1] > 1 and w[1] > w[2] and np.isfinite(w).all()


def test_toxicity_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(8, 0, 1), (8, 1, 0), (5, 1, 0), (4, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == odd.count()
    assert toxicity.fit(odd, labels.limit(0)) is None and toxicity.fit(nothing, labels) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    model = (np.zeros(toxicity.BUCKETS, np.float32), -1.0)
    assert len({r.score for r in toxicity.score(odd, model).collect()}) == 1
    assert toxicity.score(nothing, model).count() == 0


def test_fold(spark):
    import zlib

    df = spark.range(200).select(F.col("id"), is_held_out(F.col("id")).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in df.collect())
