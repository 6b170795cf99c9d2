"""A plain evaluator of condition expressions, one context at a time: what the compiler is tested against."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from .cel import parse


class EvalError(Exception):
    """What an expression raises: a missing key, a wrong type, an overflow, a division by zero."""


def duration(text: str) -> dt.timedelta:
    units = {"h": 3600e6, "m": 60e6, "s": 1e6, "ms": 1e3, "us": 1.0}
    if not re.fullmatch(r"-?(\d+(\.\d+)?(h|ms|us|m|s))+", text):
        raise EvalError(f"not a duration: {text}")
    total = sum(float(n) * units[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(h|ms|us|m|s)", text))
    return dt.timedelta(microseconds=-total if text.startswith("-") else total)


def timestamp(text: str) -> dt.datetime:
    try:
        out = dt.datetime.fromisoformat(text)
    except (ValueError, TypeError) as e:
        raise EvalError(f"not a timestamp: {text}") from e
    return out if out.tzinfo else out.replace(tzinfo=dt.UTC)


def _kind(x: Any) -> str:
    return "bool" if isinstance(x, bool) else "number" if isinstance(x, int | float) else type(x).__name__


def evaluate(expression: str, context: dict[str, Any]) -> bool:
    out = _eval(parse(expression), {"request": context} | context)
    if not isinstance(out, bool):
        raise EvalError("the result is not a boolean")
    return out


def _eval(n, env: dict[str, Any]) -> Any:
    kind = n[0]
    if kind == "lit":
        return n[1]
    if kind == "var":
        if n[1] not in env:
            raise EvalError(f"{n[1]} is not declared")
        return env[n[1]]
    if kind == "list":
        return [_eval(x, env) for x in n[1]]
    if kind == "get":
        base = _eval(n[1], env)
        if not isinstance(base, dict) or n[2] not in base:
            raise EvalError(f"no key {n[2]}")
        return base[n[2]]
    if kind == "at":
        base, i = _eval(n[1], env), _eval(n[2], env)
        try:
            if isinstance(base, list) and i < 0:
                raise IndexError
            return base[i]
        except (IndexError, KeyError, TypeError) as e:
            raise EvalError(f"no element {i}") from e
    if kind == "not":
        x = _eval(n[1], env)
        if not isinstance(x, bool):
            raise EvalError("not a boolean")
        return not x
    if kind == "neg":
        x = _eval(n[1], env)
        if _kind(x) != "number":
            raise EvalError("not a number")
        return -x
    if kind == "if":
        return _eval(n[2] if _eval(n[1], env) is True else n[3], env)
    if kind == "bin":
        return _binary(n, env)
    return _call(n, env)


def _binary(n, env):
    op = n[1]
    if op in ("&&", "||"):  # an error on one side gives way to an answer on the other
        absorbing, error = op == "||", None
        for side in n[2:]:
            try:
                x = _eval(side, env)
                if not isinstance(x, bool):
                    raise EvalError("not a boolean")
                if x == absorbing:
                    return absorbing
            except EvalError as e:
                error = e
        if error:
            raise error
        return not absorbing
    a, b = _eval(n[2], env), _eval(n[3], env)
    if op == "in":
        if not isinstance(b, list | dict):
            raise EvalError("in needs a list")
        return any(_kind(x) == _kind(a) and x == a for x in b)
    if op in ("==", "!="):
        if a is not None and b is not None and _kind(a) != _kind(b):
            raise EvalError("types differ")
        return (a == b) == (op == "==")
    if isinstance(a, dt.datetime | dt.timedelta) or isinstance(b, dt.datetime | dt.timedelta):
        try:
            return {"<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b}[op]()
        except (TypeError, KeyError) as e:
            raise EvalError("types differ") from e
    if _kind(a) != _kind(b) or _kind(a) not in ("number", "str", "list") or _kind(a) != "number" and op not in ("+", "<", "<=", ">", ">="):
        raise EvalError("types differ")
    if op in ("/", "%"):
        if b == 0:
            raise EvalError("division by zero")
        if isinstance(a, int) and isinstance(b, int):
            q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return q if op == "/" else a - q * b
        if op == "%":
            raise EvalError("% needs integers")
        return a / b
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


def _call(n, env):
    _, name, target, args = n
    if name == "has" and target is None:
        base = _eval(args[0][1], env)
        return isinstance(base, dict) and args[0][2] in base
    if name in ("exists", "all", "filter", "map") and target is not None:
        items, var = _eval(target, env), args[0][1]
        if not isinstance(items, list):
            raise EvalError("not a list")
        got, error = [], None
        for x in items:
            try:
                y = _eval(args[1], env | {var: x})
                if name != "map" and not isinstance(y, bool):
                    raise EvalError("not a boolean")
                if name in ("exists", "all") and y == (name == "exists"):
                    return y
                got.append(y)
            except EvalError as e:
                error = e
        if error:
            raise error
        if name in ("exists", "all"):
            return name == "all"
        return got if name == "map" else [x for x, keep in zip(items, got, strict=True) if keep]
    values = [_eval(a, env) for a in ([target] if target is not None else []) + args]
    try:
        if name == "size":
            return len(values[0])
        if name in ("contains", "startsWith", "endsWith", "matches"):
            a, b = values
            if not isinstance(a, str) or not isinstance(b, str):
                raise EvalError("not strings")
            return {"contains": lambda: b in a, "startsWith": lambda: a.startswith(b), "endsWith": lambda: a.endswith(b), "matches": lambda: bool(re.search(b, a))}[name]()
        if name in ("timestamp", "duration"):
            return {"timestamp": timestamp, "duration": duration}[name](values[0])
        if name in ("int", "double", "string"):
            return {"int": int, "double": float, "string": str}[name](values[0])
        if name in ("lowerAscii", "upperAscii"):
            return values[0].lower() if name == "lowerAscii" else values[0].upper()
    except (TypeError, ValueError, AttributeError) as e:
        raise EvalError(str(e)) from e
    raise EvalError(f"unknown function {name}")
