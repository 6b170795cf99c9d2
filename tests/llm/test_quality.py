import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from aclweave.llm import quality
from aclweave.llm.base import table

from .conftest import words

DIR = "/root/testdata/sf0.001"


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    n, cover = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
    return (*counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


def held(df, texts):
    rows = df.collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    return rows


def test_counts_agree_with_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, DIR, "documents").collect()}
    assert len(held(quality.op9_quality(spark, DIR), texts)) == len(texts)


def test_repeats_by_both_ways(spark):
    rng = random.Random(9)
    few = [words(rng, 1) for _ in range(6)]
    texts = {i: words(rng, n, few) + "\n\n a b \n a b \x0b\x1c" for i, n in enumerate((0, 1, 2, 3, 60, 200, 3000))} | {50: "x x x x", 51: None, 52: " ", 53: "a b c a b c"}
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id bigint, text string, lang string, source string")
    held(quality.judge(docs), texts)


def test_junk_goes_and_clean_texts_stay(spark):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality.op9_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([r.kept for r in bad]) < 0.1


def test_estimates_resist_outliers(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, x)) for x in np.concatenate((rng.normal([5, 5, 0.2, 0.2, 0.3], 0.5, (700, 5)), rng.normal(30, 1, (150, 5))))]
    df = spark.createDataFrame([("en", "s", *r) for r in rows], "lang string, source string, s1 double, s2 double, s3 double, s4 double, s5 double")
    e = quality.robust_estimates(df, ["lang", "source"]).first()
    assert abs(e.m0 - 5) < 0.2 and 0.3 < e.l00 < 0.9


def test_odd_rows_and_plan(spark, odd, nothing):
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(held(quality.judge(odd), texts)) == odd.count()
    assert quality.judge(nothing).count() == 0
    plan = quality.judge(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_group_of_copies_is_no_trap(spark):
    rng = random.Random(1)
    copy = words(rng, 80)
    rows = [(i, copy if i % 3 else words(rng, rng.randint(60, 300)), "en", "hot") for i in range(300)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert out.filter(~F.col("kept")).count() == 0
