"""Condition expressions as columns: each node becomes a value, its type and a column that is true where it has no value.

Contexts are JSON strings. A key is looked up in the tuple's context if it stands there, else in the request's. Types come
from declared parameters, else from what a value is compared with; a missing key, a value of another type, a division by
zero and an overflow are errors. ``&&`` and ``||`` absorb an error where the other side decides, ``exists`` and ``all`` where
another element does; ``filter`` and ``map`` fail if any element does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model.ast import Condition
from .cel import CelError, parse

#: Declared parameter types and what they are here.
_TYPES = {"bool": "bool", "string": "string", "int": "int", "uint": "int", "double": "double", "ipaddress": "string", "timestamp": "string", "duration": "string"}
_SQL = {"bool": "boolean", "string": "string", "int": "bigint", "double": "double"}


def _no() -> Column:
    return F.lit(False)



@dataclass
class Term:
    value: Column | None
    type: str  # bool, string, int, double, timestamp, duration, null, list<...>, map, any
    error: Column
    path: tuple[str | int, ...] = ()  # of an undeclared key or element, whose type is still open
    literal: object = None


class Compiler:
    def __init__(self, condition: Condition, tuple_context: Column, request_context: Column):
        self.parameters, self.a, self.b = condition.parameters, tuple_context, request_context
        self.names: dict[str, Term] = {}

    # keys

    def key(self, path: tuple[str, ...]) -> Term:
        declared = self.parameters.get(path[0], "any") if len(path) == 1 else "any"
        if declared.startswith("list"):
            inner = declared[5:-1].strip().lower().replace("type_name_", "") if "<" in declared else "string"
            return self.read(path, f"list<{_TYPES.get(inner, 'string')}>")
        if declared in _TYPES:
            return self.read(path, _TYPES[declared])
        return Term(None, "any", _no(), path)

    def read(self, path: tuple[str, ...], type_: str) -> Term:
        """The value at a path; the first key decides whether the tuple's or the request's context is read."""
        if type_ == "any":
            type_ = "string"
        sql = f"array<{_SQL[type_[5:-1]]}>" if type_.startswith("list") else _SQL[type_]
        found = self.variant(path)
        kind = F.schema_of_variant(found)
        raw = F.try_variant_get(found, "$", sql)
        fits = {"bool": kind == "BOOLEAN", "string": kind == "STRING", "int": kind == "BIGINT", "double": kind.rlike("^(BIGINT|DOUBLE|DECIMAL)")}.get(type_, kind.startswith("ARRAY"))
        return Term(raw, type_, raw.isNull() | ~F.coalesce(fits, _no()))

    def variant(self, path: tuple[str, ...]) -> Column:
        """The JSON value at a path, null where there is none."""
        in_a = F.array_contains(F.coalesce(F.json_object_keys(self.a), F.array().cast("array<string>")), path[0])
        found = F.try_parse_json(F.when(in_a, self.a).otherwise(self.b))
        for key in path:
            if isinstance(key, int):
                found = F.try_variant_get(found, f"$[{key}]", "variant") if key >= 0 else F.lit(None).cast("variant")
                continue
            # a path can't hold every key; others are looked up among all of the object's keys
            if re.search(r"['?\\]", key):
                found = F.try_element_at(F.try_variant_get(found, "$", "map<string,variant>"), F.lit(key))
            else:
                found = F.try_variant_get(found, f"$['{key}']", "variant")
        return found

    def settle(self, t: Term, type_: str = "string") -> Term:
        return self.read(t.path, type_) if t.type == "any" else t

    # nodes

    def term(self, n) -> Term:
        kind = n[0]
        if kind == "lit":
            return self.literal(n[1])
        if kind == "var":
            if n[1] in self.names:
                return self.names[n[1]]
            if n[1] == "request":
                return Term(None, "map", _no())
            if n[1] in self.parameters:
                return self.key((n[1],))
            raise CelError(f"{n[1]} is not declared")
        if kind == "get":
            base = self.term(n[1])
            if base.type == "map":
                return self.key((*base.path, n[2]))
            if base.type == "any":
                return Term(None, "any", _no(), (*base.path, n[2]))
            raise CelError(f"{n[2]} is no field of a {base.type}")
        if kind == "list":
            items = [self.term(x) for x in n[1]]
            type_ = next((x.type for x in items if x.type != "any"), "string")
            items = [self.settle(x, type_) for x in items]
            if any(x.type == "double" for x in items):
                type_ = "double"
            return Term(F.array(*[x.value for x in items]).cast(f"array<{_SQL[type_]}>"), f"list<{type_}>", self.any_error(*items))
        if kind == "at":
            return self.index(n)
        if kind == "not":
            x = self.want(n[1], "bool")
            return Term(~x.value, "bool", x.error)
        if kind == "neg":
            x = self.settle(self.term(n[1]), "double")
            return Term(-x.value, x.type, x.error, literal=-x.literal if isinstance(x.literal, int | float) else None)
        if kind == "if":
            c, a, b = self.want(n[1], "bool"), self.term(n[2]), self.term(n[3])
            a, b = self.pair(a, b)
            return Term(F.when(c.value, a.value).otherwise(b.value), a.type, c.error | F.when(c.value, a.error).otherwise(b.error))
        if kind == "bin":
            return self.binary(n)
        return self.call(n)

    def literal(self, x) -> Term:
        if x is None:
            return Term(F.lit(None), "null", _no())
        type_ = {bool: "bool", int: "int", float: "double", str: "string"}[type(x)]
        return Term(F.lit(x).cast(_SQL[type_]), type_, _no(), literal=x)

    def want(self, n, type_: str) -> Term:
        x = self.settle(self.term(n), type_)
        if x.type != type_:
            raise CelError(f"expected {type_}, found {x.type}")
        return x

    def any_error(self, *terms: Term) -> Column:
        out = _no()
        for t in terms:
            out = out | t.error
        return out

    def pair(self, a: Term, b: Term) -> tuple[Term, Term]:
        """Both with one type: open keys take the other's, numbers meet as doubles."""
        if a.type == b.type == "any":
            return self.settle(a), self.settle(b)
        a = self.settle(a, "double" if b.type == "int" else b.type if b.type in _SQL or b.type.startswith("list") else "string")
        b = self.settle(b, "double" if a.type == "int" and b.type == "any" else a.type if a.type in _SQL or a.type.startswith("list") else "string")
        if {a.type, b.type} == {"int", "double"}:
            a, b = (Term(x.value.cast("double"), "double", x.error) for x in (a, b))
        return a, b

    def binary(self, n) -> Term:
        op = n[1]
        if op in ("&&", "||"):
            a, b = self.want(n[2], "bool"), self.want(n[3], "bool")
            va, vb = F.coalesce(a.value, _no()), F.coalesce(b.value, _no())
            decided = ((va if op == "||" else ~va) & ~a.error) | ((vb if op == "||" else ~vb) & ~b.error)
            value = F.when(decided, F.lit(op == "||")).otherwise(va | vb if op == "||" else va & vb)
            return Term(value, "bool", ~decided & (a.error | b.error))
        if op == "in":
            b = self.term(n[3])
            a = self.term(n[2])
            b = self.settle(b, f"list<{a.type if a.type in _SQL else 'string'}>")
            if not b.type.startswith("list"):
                raise CelError("in needs a list")
            a = self.settle(a, b.type[5:-1])
            kinds = {a.type, b.type[5:-1]}
            if len(kinds) > 1 and kinds != {"int", "double"}:
                return Term(F.lit(False), "bool", a.error | b.error)
            items = F.transform(b.value, lambda x: x.cast(_SQL["double"])) if len(kinds) > 1 else b.value
            return Term(F.coalesce(F.array_contains(items, a.value.cast("double") if len(kinds) > 1 else a.value), _no()), "bool", a.error | b.error)
        a, b = self.term(n[2]), self.term(n[3])
        if "null" in (a.type, b.type):
            return self.null_test(op, a, b)
        a, b = self.pair(a, b)
        error = a.error | b.error
        times = {"timestamp", "duration"}
        if op in ("==", "!=", "<", "<=", ">", ">="):
            if a.type != b.type:
                return Term(F.lit(False), "bool", F.lit(True))
            if a.type == "bool" and op not in ("==", "!="):
                raise CelError("booleans have no order")
            value = {"==": a.value == b.value, "!=": a.value != b.value, "<": a.value < b.value, "<=": a.value <= b.value, ">": a.value > b.value, ">=": a.value >= b.value}[op]
            return Term(value, "bool", error)
        if a.type in times or b.type in times:
            if op not in ("+", "-"):
                raise CelError(f"{op} doesn't go with {a.type}")
            out = "duration" if a.type == b.type else "timestamp"
            return Term(a.value + b.value if op == "+" else a.value - b.value, out, error)  # both are microseconds
        if op == "+" and a.type == b.type == "string":
            return Term(F.concat(a.value, b.value), "string", error)
        if op == "+" and a.type == b.type and a.type.startswith("list"):
            return Term(F.concat(a.value, b.value), a.type, error)
        if a.type != b.type or a.type not in ("int", "double"):
            return Term(F.lit(None).cast("bigint"), "int", F.lit(True))
        if op in ("/", "%"):
            divisor = F.nullif(b.value, F.lit(0).cast(_SQL[b.type]))
            if op == "%" and a.type == "double":
                return Term(F.lit(None).cast("bigint"), "int", F.lit(True))
            value = F.try_mod(a.value, divisor) if op == "%" else (F.try_divide(a.value, divisor) if a.type == "double" else self.div(a.value, divisor))
            return Term(value, a.type, error | value.isNull())
        value = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.value, b.value)
        return Term(value, a.type, error | value.isNull())

    @staticmethod
    def div(a: Column, b: Column) -> Column:
        """Whole quotient towards zero, without going through doubles."""
        return F.try_divide(F.try_subtract(a, F.try_mod(a, b)).cast("decimal(20,0)"), b.cast("decimal(20,0)")).cast("bigint")

    def null_test(self, op: str, a: Term, b: Term) -> Term:
        if op not in ("==", "!="):
            raise CelError("null has no order")
        x = b if a.type == "null" else a
        if x.type != "any":
            return Term(F.lit((x.type == "null") == (op == "==")), "bool", x.error)
        v = self.variant(x.path)
        missing = F.schema_of_variant(v).isNull()
        null = F.schema_of_variant(v) == "VOID"
        return Term(F.coalesce(null if op == "==" else ~null, _no()), "bool", missing)

    def index(self, n) -> Term:
        base = self.term(n[1])
        if base.type == "any" and n[2][0] == "lit" and isinstance(n[2][1], int) and not isinstance(n[2][1], bool):
            return Term(None, "any", _no(), (*base.path, n[2][1]))
        if base.type in ("map", "any") and n[2][0] == "lit" and isinstance(n[2][1], str):
            return self.key((*base.path, n[2][1])) if base.type == "map" else Term(None, "any", _no(), (*base.path, n[2][1]))
        if not base.type.startswith("list"):
            raise CelError("only lists and maps have elements")
        i = self.want(n[2], "int")
        value = F.get(base.value, i.value.cast("int"))
        return Term(value, base.type[5:-1], base.error | i.error | value.isNull())

    def call(self, n) -> Term:
        _, name, target, args = n
        if name == "has" and target is None and len(args) == 1 and args[0][0] == "get":
            base = self.term(args[0][1])
            path = (*base.path, args[0][2])
            lost = F.schema_of_variant(self.variant(path[:-1])).isNull() if len(path) > 1 else _no()
            return Term(F.coalesce(F.schema_of_variant(self.variant(path)).isNotNull(), _no()), "bool", lost)
        if name in ("exists", "all", "filter", "map") and target is not None:
            return self.macro(name, target, args)
        terms = [self.term(x) for x in ([target] if target is not None else []) + args]
        if name == "size" and len(terms) == 1:
            x = self.settle(terms[0], "string")
            return Term((F.char_length(x.value) if x.type == "string" else F.size(x.value)).cast("bigint"), "int", x.error)
        if name in ("contains", "startsWith", "endsWith", "matches") and len(terms) == 2:
            a, b = (self.settle(x) for x in terms)
            if a.type != "string" or b.type != "string":
                raise CelError(f"{name} needs strings")
            fn = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith, "matches": F.regexp_like}[name]
            return Term(fn(a.value, b.value), "bool", a.error | b.error)
        if name in ("timestamp", "duration") and len(terms) == 1:
            x = self.settle(terms[0])
            value = F.unix_micros(F.try_to_timestamp(x.value)) if name == "timestamp" else self.micros(x.value)
            return Term(value, name, x.error | value.isNull())
        if name in ("int", "double", "string") and len(terms) == 1:
            x = self.settle(terms[0])
            value = x.value.try_cast(_SQL[name])
            return Term(value, name, x.error | value.isNull())
        if name in ("lowerAscii", "upperAscii") and len(terms) == 1:
            x = self.settle(terms[0])
            return Term(F.lower(x.value) if name == "lowerAscii" else F.upper(x.value), "string", x.error)
        raise CelError(f"unknown function {name}")

    @staticmethod
    def micros(text: Column) -> Column:
        total = F.lit(0.0)
        for unit, n in (("h", 3600e6), ("m(?!s)", 60e6), ("(?<![mu])s", 1e6), ("ms", 1e3), ("us", 1.0)):
            total = total + F.coalesce(F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0)) * n
        sign = F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)
        return F.when(text.rlike(r"^-?(\d+(\.\d+)?(h|ms|us|m|s))+$"), (total * sign).cast("bigint"))

    def macro(self, name: str, target, args) -> Term:
        if len(args) != 2 or args[0][0] != "var":
            raise CelError(f"{name} needs a name and an expression")
        items = self.settle(self.term(target), "list<string>")
        if not items.type.startswith("list"):
            raise CelError(f"{name} needs a list")
        outer, got = dict(self.names), {}

        def body(x: Column) -> Column:
            self.names = outer | {args[0][1]: Term(x, items.type[5:-1], _no())}
            t = got["t"] = self.settle(self.term(args[1]), "string" if name == "map" else "bool")
            self.names = outer
            if name != "map" and t.type != "bool":
                raise CelError(f"{name} needs a condition")
            return F.struct(t.value.alias("v"), (F.coalesce(t.error, F.lit(True)) | t.value.isNull()).alias("e"))

        def some(test) -> Column:
            return F.coalesce(F.exists(F.transform(items.value, body), test), _no())

        failed = some(lambda p: p["e"])
        if name in ("exists", "all"):  # an element that decides outweighs errors of others
            decided = some(lambda p: ~p["e"] & F.coalesce(p["v"] if name == "exists" else ~p["v"], _no()))
            return Term(decided if name == "exists" else ~decided, "bool", items.error | (~decided & failed))
        if name == "map":
            return Term(F.transform(items.value, lambda x: body(x)["v"]), f"list<{got['t'].type}>", items.error | failed)
        return Term(F.filter(items.value, lambda x: F.coalesce(body(x)["v"], _no())), items.type, items.error | failed)


def compile_condition(condition: Condition, tuple_context: Column, request_context: Column) -> tuple[Column, Column]:
    """(holds, failed) of a condition over two JSON contexts; neither is ever null."""
    out = Compiler(condition, tuple_context, request_context).term(parse(condition.expression))
    if out.type == "any":
        raise CelError("the result's type is open")
    if out.type != "bool":
        raise CelError("the result is not a boolean")
    failed = F.coalesce(out.error, F.lit(True)) | out.value.isNull()
    return F.coalesce(out.value, _no()) & ~failed, failed
