import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from aclweave.llm import pii, secretscan
from aclweave.llm.base import table

DIR = "/root/testdata/sf0.001"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    found = [[m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]]
    found.append([m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))])
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found.append([m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))])
    found.append([m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15])
    return [len(f) for f in found], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, f in zip(("email", "ip", "card", "phone"), found, strict=True) for s, e in f).encode()).hexdigest()


def brute_secrets(t):
    a = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return [len(a), len(b), len(c)], hashlib.sha256(",".join(f"{secretscan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(a + b + c)).encode()).hexdigest()


def test_base_spans_agree_with_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, DIR, "documents").collect()}
    for r in pii.op3_pii(spark, DIR).collect():
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == brute_pii(texts[r.doc_id])
    for r in secretscan.op10_secrets(spark, DIR).collect():
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == brute_secrets(texts[r.doc_id])


@pytest.mark.parametrize("text", ["a@b.c", "1.2.3.4 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-567", "+1 2", "\u0663@x.y", "Password : 'abcdef'", "API_KEY=abc", "toKen=\"abcdefg.h\"", "\u017fecret=abcdef", "f" * 30, "9" * 5000])
def test_small_texts(text):
    spans = pii.base_spans(text)
    assert [sum(k == i for k, *_ in spans) for i in range(4)] == brute_pii(text)[0] if len(text) < 4000 else spans == []
    assert [sum(k == i for _, k, _ in secretscan.base_spans(text)) for i in range(3)] == brute_secrets(text)[0]


def test_terms_that_disclose(spark):
    rng = random.Random(1)
    common = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "kappa", "lambda", "omega"]
    text = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, f"{text(12)} {rng.choice(common)} Zanzibrook office@zan.example {text(12)}") for i in range(12)] + [(100 + i, text(40)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in pii.scan(docs).collect()}
    for i, t in rows:
        terms = {t[x["start"] : x["end"]] for x in found[i]["all"] if x["kind"] == 4}
        assert terms == ({"Zanzibrook"} if i < 100 else set())
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zanzibrook" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == dict(rows)[100]
    by_join = {r.doc_id: len(r["all"]) for r in pii.scan(docs, terms_in_task=0).collect()}
    assert by_join == {i: len(found[i]["all"]) for i in found}


def test_rare_entities_are_disclosed_too(spark):
    rng = random.Random(4)
    common = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "kappa", "lambda", "omega"]
    text = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, f"{text(12)} Zanzibrook office@zan.example {text(12)}") for i in range(3)]
    rows += [(10 + i, f"{text(12)} Quillmore staff{i}@quill.example {text(12)}") for i in range(6)]  # each address once
    rows += [(100 + i, text(40)) for i in range(300)]
    found = {r.doc_id: r["all"] for r in pii.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        assert {t[x["start"] : x["end"]] for x in found[i] if x["kind"] == 4} == ({"Zanzibrook"} if i < 10 else {"Quillmore"} if i < 100 else set())


def test_telling_terms_go_wherever_they_stand(spark):
    rng = random.Random(6)
    common = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "kappa", "lambda", "omega"]
    text = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, f"{text(12)} Zanzibrook office@zan.example {text(40)} Zanzibrook {text(5)}") for i in range(20)] + [(100 + i, text(40)) for i in range(3000)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not [i for i, t in clean.items() if "Zanzibrook" in t] and clean[100] == dict(rows)[100]
    stray = rows + [(5000, f"{text(6)} Zanzibrook {text(6)}")]
    docs = spark.createDataFrame(stray + [(9000 + i, f"{text(12)} Zanzibrook office@zan.example {text(20)}") for i in range(60)], "doc_id bigint, text string")
    for few in (100_000, 0):
        assert "Zanzibrook" not in {r.doc_id: r.text for r in pii.sanitise(docs, terms_in_task=few).collect()}[5000]


def test_copies_are_one_observation(spark):
    docs = spark.createDataFrame([(i, "the quick Brownfox me@here.example lazy dog") for i in range(50)] + [(100 + i, "other words here") for i in range(50)], "doc_id bigint, text string")
    assert not pii.scan(docs).filter(F.exists("all", lambda x: x["kind"] == 4)).count()


def test_random_strings_stand_out(spark):
    rng = random.Random(3)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    syllables = ["tion", "ing", "er", "re", "an", "the", "ent", "is", "on", "al", "st", "or"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(5, 9)))
    rows = [(i, " ".join(word() for _ in range(40)) + (f" {''.join(rng.choice(base64) for _ in range(44))} " if i < 20 else "") + " my-long-option-name camelCaseIdentifierName") for i in range(120)]
    out = {r.doc_id: r["all"] for r in secretscan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    hits = [i for i, s in out.items() if any(x["kind"] == 3 and x["end"] - x["start"] >= 40 for x in s)]
    assert sum(i < 20 for i in hits) >= 15 and not [i for i in hits if i >= 20]


def test_keys_are_found_among_many_clean_candidates(spark):
    rng = random.Random(8)
    draw = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(a) for _ in range(n))
    syllables = ["tion", "ing", "er", "re", "an", "the", "ent", "is", "on", "al", "st", "or", "com", "de", "fi", "put", "ob", "ly", "ma", "con"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    code = lambda: word(3) + "".join(word(2).capitalize() for _ in range(4)) + str(rng.randint(1, 99))
    rows = [(i, " ".join([word(rng.randint(1, 4)) for _ in range(60)] + [code() for _ in range(10)] + [draw(n) for n in (24, 32, 40, 64) if i < 50])) for i in range(400)]
    out = {r.doc_id: r["all"] for r in secretscan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for n in (24, 32, 40, 64):
        assert sum(any(x["kind"] == 3 and x["end"] - x["start"] == n and x["end"] > len(t) - 165 for x in out[i]) for i, t in rows[:50]) >= 45
    assert not any(x["kind"] == 3 for i, t in rows[50:] for x in out[i])


def test_keys_of_one_encoding_are_candidates(spark):
    rng = random.Random(9)
    draw = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = [draw(40, upper.lower()), draw(40, upper), "-".join(draw(5, upper) for _ in range(6)), "_".join(draw(6, upper.lower()) for _ in range(5))]
    text = " ".join(r.text for r in table(spark, DIR, "documents").limit(100).collect() if r.text)
    rows = [(i, f"{text[i * 2000 : i * 2000 + 2000]} so {keys[i]} ") for i in range(4)] + [(9, "Internationalisierungen INTERNATIONALISIERUNGEN 20240101202402022024 ================ " + text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: [rows[min(r.doc_id, 4)][1][x["start"] : x["end"]] for x in r["all"] if x["kind"] == 3] for r in secretscan.scan(docs).collect()}
    assert all(keys[i] in out[i] for i in range(4)) and not out[9]
    assert not any(k in r.text for k in keys for r in secretscan.redact(docs).collect())


def test_thresholds_control_the_rate():
    null = {b * secretscan.BINS + 100 + i % 50: 200 for b in range(6) for i in range(50)}
    low = secretscan.thresholds(null, {0 * secretscan.BINS + 390: 5, 0 * secretscan.BINS + 120: 5})
    assert 149 < low[0] <= 390
    assert set(secretscan.thresholds({}, {}).values()) == {secretscan.BINS}


def test_odd_rows(spark, odd, nothing):
    for scan in (pii.scan, secretscan.scan):
        assert scan(odd).count() == odd.count() and scan(nothing).count() == 0
    assert sum(len(r.base) for r in pii.scan(odd).filter("doc_id = 7").collect()) == 2
    redacted = {(r.doc_id, r.text) for r in secretscan.redact(odd).collect()}
    assert (1, None) in redacted and (4, "word") in redacted and ("[SECRET]" in dict(redacted)[10]) and "hunter22" not in dict(redacted)[10]
    assert secretscan.redact(nothing).count() == 0 and secretscan.redact(odd).columns == odd.columns
    assert pii.sanitise(odd).count() == odd.count()


def test_long_runs_end_soon():
    """A megabyte of one separator, digit or letter, alone and beside what starts a pattern, takes about as long as reading it."""
    writing = secretscan.Writing(np.full(776, 1000))
    texts = [c * 1_000_000 for c in "xA1-=. @+f_/"] + ["1." * 500_000, "a@" * 500_000, "1.1.1.1 " * 20_000, "token = " * 60_000, "token=abcdefg " * 40_000 + "x" * 40, "a@b.c " + "x" * 500_000 + " " + "1" * 500_000 + ".", "-" * 60 + "Section2", "=" * 40 + "x1"]
    for t in texts:
        began = time.process_time()
        spans = pii.base_spans(t)
        pii.contexts(t, spans)
        secretscan.found_in(t, writing)
        assert time.process_time() - began < 4, t[:20]


def test_scans_are_the_patterns():
    """The linear scans find what the patterns of the contract find."""
    rng = random.Random(3)
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(20_000):
        t = "".join(rng.choice("ab1.@-_ 2+") for _ in range(rng.randint(0, 40)))
        assert list(pii.emails(t)) == [m.span() for m in email.finditer(t)]
        assert [m.span() for m in pii._IP.finditer(t)] == [m.span() for m in ip.finditer(t)]


def test_secrets_planted_in_documents(spark):
    """Random strings of several encodings and lengths among real documents: most are found, few other runs are."""
    rng = random.Random(21)
    alphabets = {"base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "HEX": "0123456789ABCDEF", "lower36": "abcdefghijklmnopqrstuvwxyz0123456789"}
    docs, want = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()], {}
    for k, (name, alphabet) in enumerate(alphabets.items()):
        for n in (24, 32, 48, 64):
            for i in range(12):
                secret = "".join(rng.choice(alphabet) for _ in range(n))
                doc_id, host = 10**6 + 10_000 * k + 100 * n + i, docs[rng.randrange(150)][1]
                want[doc_id] = (name, n, len(host) + 1)
                docs.append((doc_id, f"{host} {secret} end"))
    got = {r.doc_id: [x for x in r.all if x.kind == 3] for r in secretscan.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    hit = {d for d, (_, n, at) in want.items() if any(x.start <= at and x.end >= at + n for x in got[d])}
    assert len(hit) >= 0.9 * len(want)
    for name in alphabets:
        own = [d for d, w in want.items() if w[0] == name]
        assert len([d for d in own if d in hit]) >= 0.8 * len(own), name
    false = sum(len(v) for v in got.values()) - len(hit)
    assert false <= 0.1 * len(hit)
