import cProfile
import os
import pathlib
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from aclweave.llm import decontaminate, jaccard, urlfilter
from aclweave.llm.base import table

from .conftest import words

DIR = "/root/testdata/sf0.001"


def brute_components(rows, size=5):
    sets = []
    for d, t in rows:
        w = t.encode("utf-8", "replace").lower().split() if t else []
        sets.append((d, frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str)


def test_join_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, DIR, "documents").collect()]
    assert sorted((tuple(r) for r in jaccard.op4_jaccard_join(spark, DIR).collect()), key=str) == brute_components(rows)


def test_join_on_near_copies_and_shared_passages(spark):
    rng = random.Random(6)
    rows, shared = [], words(rng, 30)
    for n in (4, 5, 6, 7, 8, 10, 12, 15, 20, 26, 31, 40, 60, 90, 150):
        base = words(rng, n).split()
        for _ in range(7):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = [[], [words(rng, 1)], [copy[k], words(rng, 1)]][rng.randrange(3)]
            rows.append((len(rows), " ".join(copy) if rng.random() < 0.8 else " ".join(copy).upper()))
        rows += [(len(rows) + i, f"{shared} {words(rng, n)}") for i in range(3)]
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows)


def test_linked_sets_always_share_an_indexed_subset():
    rng, hot = np.random.default_rng(1), np.zeros(jaccard._CELLS, np.uint32)
    hot[rng.integers(0, jaccard._CELLS, 20_000)] = 50
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        drop, add = rng.integers(0, len(a) // 5 + 1), rng.integers(0, len(a) // 5 + 1)
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 62, add).astype(np.uint64))))
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= 80 * (len(a) + len(b) - same):
            x, y = (jaccard.indexed(s, hot, 80) >> np.uint64(8) for s in (a, b))
            assert len(np.intersect1d(x, y)), (len(a), len(b), same)


def test_join_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in jaccard.join_components(odd).collect()), key=str) == brute_components(rows)
    assert jaccard.join_components(nothing).count() == 0


def test_chains_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a bigint, b bigint")
    assert {(r.node, r.comp) for r in jaccard.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


# urls


def brute_verdict(host, path, rules):
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(h + p), len(h)) > best[2:]):
            best = (h + p, verdict, len(h + p), len(h))
    return best[:2] if best else (None, "allow")


@pytest.mark.parametrize("limit", [200_000, 40])
def test_nested_rules(spark, limit):
    rng = random.Random(4)
    label = lambda: rng.choice(["a", "b", "c", "aa", "ab"])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(label() for _ in range(rng.randint(0, 2)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(300))}.values())
    urls = [(i, f"http://{host().upper() if rng.random() < 0.2 else host()}{path()}{rng.choice(['', '?q=/a', '#x'])}") for i in range(2000)]
    pages = spark.createDataFrame(urls + [(5000, None), (5001, "no scheme"), (5002, "x://")], "page_id bigint, url string")
    out = urlfilter.judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), rules_in_task=limit)
    for r in out.collect():
        assert (r.rule, r.verdict) == (brute_verdict(r.host, r.path, rules) if r.host else (None, "allow")), r
    assert out.count() == len(urls) + 3


def test_url_parts(spark):
    rows = [("HTTP://WwW.Ex.com", "www.ex.com", ""), ("a://h?x/y", "h", ""), ("a://h/p/q#f", "h", "/p/q"), ("://x/y", "x", "/y"), ("a://b://c", "b:", "//c"), ("a\n://É.com/\n", "É.com", "/\n"), (None, "", ""), ("nothing", "", "")]
    df = spark.createDataFrame([(r[0],) for r in rows], "url string")
    assert [tuple(r) for r in df.select(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))).collect()] == [r[1:] for r in rows]


def test_url_clashing_columns_and_empty(spark):
    pages = spark.createDataFrame([(1, "a://x.net/es/1", "mine", "k")], "page_id bigint, url string, verdict string, key string")
    rules = spark.createDataFrame(urlfilter.RULES, "verdict string, host string, path string")
    assert urlfilter.judge_urls(pages, rules).first().verdict == "block"
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0
    assert urlfilter.judge_urls(pages, rules.limit(0)).first().verdict == "allow"


# decontamination


def test_planted_items_are_found(spark):
    docs, bench = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    want = {(d.doc_id, b.item_id) for b in bench.collect() for d in docs.filter(F.contains("text", F.lit(b.text))).collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op8_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert want and got == want


def test_paraphrases_and_recall(spark):
    rng = random.Random(12)
    vocabulary = [words(rng, 1) for _ in range(3000)]
    items = [(i, words(rng, rng.choice([16, 24, 40, 56, 130]), vocabulary)) for i in range(60)]
    docs, want = [], set()
    for i in range(400):
        body = words(rng, rng.randint(0, 300), vocabulary).split()
        if i % 2 == 0:
            item = items[i // 2 % 60]
            own = item[1].split()
            for _ in range(len(own) // 8):  # an eighth of the words is replaced
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            k = rng.randint(0, len(body))
            body[k:k] = own
            want.add((i, item[0]))
        docs.append((i, " ".join(body)))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(got & want) >= 0.95 * len(want) and not got - want
    blocks = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_chars=9000)
    assert len({(r.doc_id, r.item_id) for r in blocks.collect()} & want) >= 0.95 * len(want)


def test_paraphrases_of_hot_items(spark):
    rng = random.Random(14)
    vocabulary = [words(rng, 1) for _ in range(3000)]
    item = list(dict.fromkeys(words(rng, 40, vocabulary).split()))[:24]
    docs = [(i, f"{words(rng, 60, vocabulary)} {' '.join(item)} {words(rng, 20, vocabulary)}") for i in range(60)]
    for i in range(10):  # 16 of 24 words stay, the last quarter whole
        own = [rng.choice(vocabulary) if k in {1, 3, 5, 8, 10, 12, 14, 16} else w for k, w in enumerate(item)]
        docs.append((100 + i, f"{words(rng, 40, vocabulary)} {' '.join(own)} {words(rng, 20, vocabulary)}"))
    docs += [(200 + i, words(rng, 100, vocabulary)) for i in range(130)]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))] + [(2 + i, words(rng, 24, vocabulary)) for i in range(30)], "item_id bigint, text string"), cosine=0.1)  # the rule after retrieval
    got = {r.doc_id for r in found.collect() if r.item_id == 1}
    assert got >= set(range(60)) and len(got & set(range(100, 110))) >= 9 and not [i for i in got if i >= 200]


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 30))] for _ in range(2))
        assert decontaminate.lcs(decontaminate._masks(a), len(a), b) == slow(a, b)


def test_decontamination_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "one two three four five six", "six"), (2, None, None), (3, "", None), (3, "...", None)], "item_id bigint, text string, answer string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd, bench).collect()} == {(8, 1), (9, 1)}
    kept = decontaminate.drop_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontaminate.find_leaks(nothing, bench).count() == 0 and decontaminate.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, bench.limit(0)).count() == odd.count()


def test_join_where_a_crowd_stays_apart_from_its_leader(spark):
    """A large group of copies about as far from each other as the limit: by leader, by subset, in tiles, and long sets."""
    rng = random.Random(12)
    rows = []
    for n, copies in ((120, 90), (900, 30)):
        base = words(rng, n).split()
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, n // 22)):
                copy[rng.randrange(n)] = words(rng, 1)
            rows.append((len(rows), " ".join(copy)))
    want = brute_components(rows)
    assert 20 < len({c for _, _, c in want}) < 100
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = jaccard._TILE, jaccard._MEMBERS
    try:
        for tile, members in ((4_000_000, 1024), (50, 7)):
            jaccard._TILE, jaccard._MEMBERS = tile, members
            assert sorted((tuple(r) for r in jaccard.join_components(docs).collect()), key=str) == want
    finally:
        jaccard._TILE, jaccard._MEMBERS = kept


def test_sketches_never_exceed_the_distance():
    rng = np.random.default_rng(3)
    for n in (40, 300, 2000, 9000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[n // 6 :], rng.integers(0, 1 << 62, n // 9).astype(np.uint64))))
        apart = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        for x, y in zip(jaccard.sketches(a), jaccard.sketches(b), strict=True):
            if x is None or y is None:
                continue
            while len(x) > len(y):
                x = [p ^ q for p, q in zip(x[: len(x) // 2], x[len(x) // 2 :], strict=True)]
            while len(y) > len(x):
                y = [p ^ q for p, q in zip(y[: len(y) // 2], y[len(y) // 2 :], strict=True)]
            assert sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y, strict=True)) <= apart


def test_the_join_needs_no_package_on_executors(tmp_path):
    """Functions travel by value: a session in a folder where workers can't import the package."""
    code = (
        "import sys, os; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "from aclweave.llm import jaccard, langid, packing, tokenfile\n"
        "d = s.createDataFrame([(1, 'a b c d e f g'), (2, 'a b c d e f g'), (3, 'x')], 'doc_id bigint, text string')\n"
        "print(sorted(map(tuple, jaccard.join_components(d).collect())))\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    got = subprocess.run([sys.executable, "-c", code, str(pathlib.Path(jaccard.__file__).parents[2])], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip() == "[(1, 3, 1), (2, 3, 1), (3, 1, 3)]", got.stderr[-2000:]


def test_the_latent_basis_reads_every_document(spark, monkeypatch):
    from aclweave.llm import decontaminate

    docs = spark.createDataFrame([(i, f"w{i} x{i % 7} y{i % 5} z") for i in range(20_300)], "doc_id bigint, text string")
    seen, eigh = [], np.linalg.eigh
    words = {b"z": 1, b"w1": 2}
    df = np.ones(len(words) + 1 + decontaminate.CELLS)
    df[1:] = 20_000
    df[2] = 1
    monkeypatch.setattr(decontaminate.np.linalg, "eigh", lambda g: (seen.append(g.copy()), eigh(g))[1])
    ids = [np.array([2, 1], np.int32)]
    decontaminate._basis(docs, ids, words, df, 20_300)
    idf = np.log(20_301 / (df + 0.5)).clip(0.0)
    idf[0] = 0.0
    omega = np.random.default_rng(11).standard_normal((len(idf), decontaminate.RANK + 1 + decontaminate.EXTRA)) * idf[:, None]
    of = decontaminate.Words(words)
    y = np.array([omega[of(f"w{i} x{i % 7} y{i % 5} z")].sum(axis=0) for i in range(20_300)])
    own = omega[ids[0]].sum(axis=0)
    assert np.allclose(seen[0], y.T @ y + 20_300 * np.outer(own, own), rtol=1e-3, atol=1e-3 * np.abs(y.T @ y).max())


def test_word_ids_of_many_texts():
    texts = [None, "", "  a  B\t\n", " !! ? a-b \x1c c\x0bd\x0ce", "x" * 10_000, " . , a", "Ünï ß straße 日本語   y", "\ud800 q", "same-word SAMEWORD other"]
    known = {b"a": 1, b"ab": 2, "straße".encode(): 3, b"q": 4}
    of = decontaminate.Words(known)
    ids, sizes = of.all(texts)
    bare = [w for t in texts for w in decontaminate.bare_words(t)]
    assert sizes.tolist() == [len(decontaminate.bare_words(t)) for t in texts] and len(ids) == len(bare)
    assert all(i == known[w] if w in known else len(known) < i < of.size for i, w in zip(ids.tolist(), bare, strict=True))
    assert ids[-3] == ids[-2] and ids.tolist() == np.concatenate([of(t) for t in texts]).tolist()
    assert [len(x) for x in of.all([None, "", "?"])] == [0, 3]


def test_sketch_against_dense_matrices():
    rng = np.random.default_rng(2)
    sizes = np.array([0, 1, 47, 48, 49, 300, 0, 5000, 96])
    ids = np.minimum(rng.zipf(1.3, sizes.sum()), 400).astype(np.int32)
    omega = rng.standard_normal((401, 9)).astype(np.float32)
    omega[0] = 0
    g, x = np.zeros((9, 9)), np.zeros((401, 9))
    n = decontaminate._sketch(ids, sizes, omega, g, x)
    passages = [part for text in np.split(ids, np.cumsum(sizes)[:-1]) for part in np.split(text, range(48, len(text), 48)) if len(part)]
    a = np.array([np.bincount(part, minlength=401) for part in passages])
    y = a @ omega.astype(np.float64)
    assert n == len(passages) and np.allclose(g, y.T @ y, rtol=1e-4, atol=1e-2) and np.allclose(x, a.T @ y, rtol=1e-4, atol=1e-1)


def test_candidates_against_brute_force(spark):
    def common(a, b):
        row = [0] * (len(b) + 1)
        for w in a:
            new = [0]
            for j, u in enumerate(b):
                new.append(row[j] + 1 if u == w else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(21)
    vocabulary = [words(rng, 1) for _ in range(60)]
    items = [(i, words(rng, rng.choice([16, 20, 24, 40]), vocabulary).split()) for i in range(8)]
    docs, want = [], {}
    for d in range(40):
        text = words(rng, rng.randint(0, 150), vocabulary).split()
        own = [rng.choice(vocabulary) if rng.random() < 0.3 else w for w in items[d % 8][1]]
        at = rng.randint(0, len(text))
        text[at:at] = own
        docs.append((d, " ".join(text)))
        for k, item in items:
            tried = set()
            for start in range(0, len(text), 8):  # every window is a candidate
                begin = max(0, start - 16)
                if begin // 16 in tried or want.get((d, k), (0,))[0] == 1.0:
                    continue
                tried.add(begin // 16)
                region = text[begin : start + len(item) + 32]
                got = common(item, region) / len(item)
                if got >= 0.6:
                    want[d, k] = max(want.get((d, k), (0.0, 0.0)), (got, common(item[-(len(item) // 4) :], region) / (len(item) // 4)))
    found = decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string"), cosine=-1.1, alike=0.6, loose=0.6
    )
    assert len(want) > 30 and {(r.doc_id, r.item_id): (r.common, r.answer) for r in found.collect()} == want


def test_search_makes_no_call_a_word(spark):
    rng = random.Random(3)
    vocabulary = [words(rng, 1) for _ in range(4000)]
    items = [(i, words(rng, rng.choice([16, 24, 40, 56]), vocabulary)) for i in range(200)]
    texts = [words(rng, 400, vocabulary) if i % 2 else words(rng, 400) for i in range(256)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ((pairs, _),) = decontaminate._searches(docs, spark.createDataFrame(items, "item_id bigint, text string"), 0.5, 0.75, 0.6, 4_000_000)
    search, profile = pairs(), cProfile.Profile()
    profile.runcall(search, {"doc_id": list(range(len(texts))), "text": texts})
    assert sum(entry.callcount for entry in profile.getstats()) < 0.2 * 400 * len(texts)
