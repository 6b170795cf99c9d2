import json
import random

import pytest
from pyspark.sql import functions as F

from aclweave.functions.cel import CelError, parse
from aclweave.functions.compiler import compile_condition
from aclweave.functions.pyeval import EvalError, evaluate
from aclweave.model import Condition

PARAMETERS = {"n": "int", "s": "string", "l": "list<string>", "b": "bool", "d": "double", "m": "map", "t": "timestamp"}
EXPRESSIONS = [
    "request.n > 3", "n + 2 * 3 == 9 || b", "s.startsWith('ab') && s.size() == 3", "s in l", "l.size() == 2", "l.exists(x, x == 'q')", "l.all(x, x.size() < 3)", "request.m.a.b == 'z'", "n / 0 == 1 || true",
    "n / 2 == 1", "timestamp(t) < timestamp('2024-01-01T00:00:00Z')", "timestamp(t) + duration('1h30m') > timestamp('2023-06-01T00:00:00Z')", "!b ? s == 'abc' : n < 0", "request.u == 5", "request.u > 1.5",
    "s == 'abc' && request.zz == 1", "s == 'no' && request.zz == 1", "l[0] == 'p'", "has(request.n)", "d * 2.0 >= 3.0", "s.contains('b') || s.endsWith('x')", "n % 2 == 1", "request.u in [1, 5]",
    "l.exists(x, 10 / x.size() > 9)", "l.all(x, 10 / (x.size() - 1) > 3)", "!l.all(x, 10 / (x.size() - 1) > 3)", "l.exists(x, x == 'q' || 1 / (x.size() - 1) == 0)", "l.filter(x, 1 / (x.size() - 1) == 0).size() == 1", "l.map(x, 1 / (x.size() - 1)).size() == 2", "l.exists(x, x.size() / (x.size() - 4) == 1)", "request.v[0] == 1", "request.v[1] > 1.5", "request.v[7] == 1", "has(request.m.a)", "request.m[\"it's\"] == 2", "has(request.zz)",
    "l.filter(x, x != 'p').size() == 1", "s + 'd' == 'abcd'", "-n < 0", "request.q == null", "n == 9223372036854775807", "n + 9223372036854775807 > 0", "s.matches('^a.c$')",
]
CONTEXTS = [{"n": 3, "s": "abc", "l": ["p", "q"], "b": True, "d": 1.5, "m": {"a": {"b": "z"}, "it's": 2}, "v": [1, 2], "t": "2023-05-31T23:00:00Z", "u": 5, "q": None}, {"n": -7, "s": "xyz", "l": ["long"], "b": False, "d": 1, "m": {}, "t": "2025-01-01T00:00:00Z", "u": 1}, {}, {"n": "3", "s": 5, "b": "x"}]


def test_columns_agree_with_plain_evaluation(spark):
    rows = [(i, json.dumps({k: v for k, v in c.items() if k in "ns"}) if i % 2 else None, json.dumps({k: v for k, v in c.items() if not i % 2 or k not in "ns"})) for i, c in enumerate(CONTEXTS)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    cols = [c.alias(f"{x}{k}") for k, e in enumerate(EXPRESSIONS) for x, c in zip("ve", compile_condition(Condition("c", PARAMETERS, e), F.col("a"), F.col("b")), strict=True)]
    for r in df.select("i", *cols).collect():
        for k, e in enumerate(EXPRESSIONS):
            try:
                want = (evaluate(e, CONTEXTS[r.i]), False)
            except (EvalError, OverflowError):
                want = (False, True)
            if "9223372036854775807 >" in e and r.i == 0:
                want = (False, True)  # 64-bit overflow, which plain integers don't have
            assert (r[f"v{k}"], r[f"e{k}"]) == want, (e, CONTEXTS[r.i])


def test_tuple_context_wins(spark):
    df = spark.createDataFrame([('{"n":1}', '{"n":5}')], "a string, b string")
    v, _ = compile_condition(Condition("c", {"n": "int"}, "n == 1"), F.col("a"), F.col("b"))
    assert df.select(v).first()[0]


def test_the_first_key_decides_what_has_reads(spark):
    df = spark.createDataFrame([('{"m":{"z":1}}', '{"m":{"a":1}}')], "a string, b string")
    v, e = compile_condition(Condition("c", {"m": "map"}, "has(request.m.a)"), F.col("a"), F.col("b"))
    assert tuple(df.select(v, e).first()) == (False, False)


def test_random_expressions(spark):
    """Macros with failing bodies, nested logic and arithmetic: columns and the plain evaluator agree."""
    rng = random.Random(31)
    contexts = [{"l": [rng.randrange(-2, 4) for _ in range(rng.randrange(4))], "n": rng.randrange(-2, 5), "b": rng.random() < 0.5} for _ in range(24)] + [{}, {"l": [0], "n": 0}]

    def number(depth, names):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([*names, "n", str(rng.randrange(4))])
        return f"({number(depth - 1, names)} {rng.choice('+-*/%')} {number(depth - 1, names)})"

    def truth(depth, names=()):
        kind = rng.randrange(6 if depth else 2)
        if kind == 0:
            return "b"
        if kind == 1:
            return f"{number(1, names)} {rng.choice(['<', '<=', '==', '!=', '>'])} {number(1, names)}"
        if kind == 2:
            return f"({truth(depth - 1, names)} {rng.choice(['&&', '||'])} {truth(depth - 1, names)})"
        if kind == 3:
            return f"!({truth(depth - 1, names)})"
        x = f"x{len(names)}"
        body = f"{number(2, [*names, x])} {rng.choice(['<', '==', '>='])} {number(1, [*names, x])}"
        return f"l.{rng.choice(['exists', 'all'])}({x}, {body})" if kind == 4 else f"l.filter({x}, {body}).size() > {rng.randrange(3)}"

    texts = [truth(3) for _ in range(60)]
    df = spark.createDataFrame([(i, None, json.dumps(c)) for i, c in enumerate(contexts)], "i int, a string, b string")
    parameters = {"l": "list<int>", "n": "int", "b": "bool"}
    for at in range(0, len(texts), 20):
        cols = [c.alias(f"{x}{k}") for k, e in enumerate(texts[at : at + 20]) for x, c in zip("ve", compile_condition(Condition("c", parameters, e), F.col("a"), F.col("b")), strict=True)]
        for r in df.select("i", *cols).collect():
            for k, e in enumerate(texts[at : at + 20]):
                try:
                    want = (evaluate(e, contexts[r.i]), False)
                except EvalError:
                    want = (False, True)
                assert (r[f"v{k}"], r[f"e{k}"]) == want, (e, contexts[r.i])


def test_syntax_and_types(spark):
    for text in ("", "a +", "(a", "a ? b", "'open", "a.", "[1,", "a b"):
        with pytest.raises(CelError):
            parse(text)
    for text in ("n + 1", "nope == 1", "s && b", "n.foo()"):
        with pytest.raises(CelError):
            compile_condition(Condition("c", PARAMETERS, text), F.lit("{}"), F.lit("{}"))
