"""The model language: a recursive-descent parser, and its inverse.

    model
      schema 1.1
    type document
      relations
        define parent: [folder]
        define viewer: [user, user:*, group#member, user with c] or (editor and member from parent) but not blocked
    condition c(x: int) { x < 10 }

``but not`` binds tighter than ``and``, which binds tighter than ``or``; parentheses group. Headers are optional.
"""

from __future__ import annotations

import re

from .ast import Computed, Condition, Difference, FromParent, Intersection, Model, Relation, Rewrite, This, TypeRef, Union

_TOKEN = re.compile(r"[\[\](),:#*{]|but\s+not\b|[A-Za-z_][A-Za-z0-9_.-]*|\d+(?:\.\d+)*")


class DslError(ValueError):
    """Text that isn't a model, with the line where it stops being one."""


def _strip_comments(text: str) -> str:
    """Comments go: from a # at the start of a line or after white space, outside conditions and quotes."""
    return "\n".join(re.sub(r"(^|\s)#.*$", r"\1", line) for line in text.split("\n"))


class _Parser:
    def __init__(self, text: str):
        self.text = text
        self.at = 0

    def fail(self, what: str):
        raise DslError(f"line {self.text.count(chr(10), 0, self.at) + 1}: {what}")

    def space(self) -> None:
        while True:
            m = re.compile(r"\s+|(?:(?<=\s)|(?<=^)|(?<![\w\]]))#[^\n]*").match(self.text, self.at)
            if not m:
                return
            self.at = m.end()

    def peek(self) -> str | None:
        self.space()
        m = _TOKEN.match(self.text, self.at)
        if not m:
            if self.at < len(self.text):
                self.fail(f"unexpected {self.text[self.at]!r}")
            return None
        return re.sub(r"\s+", " ", m.group())

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if got is None or want is not None and got != want:
            self.fail(f"expected {want or 'a name'}, found {got or 'the end'}")
        self.at = _TOKEN.match(self.text, self.at).end()
        return got

    def name(self) -> str:
        got = self.take()
        if not re.match(r"[A-Za-z_]", got) or got == "but not":
            self.fail(f"expected a name, found {got}")
        return got

    def model(self) -> Model:
        model = Model({}, {})
        if self.peek() == "model":
            self.take()
        if self.peek() == "schema":
            self.take()
            model.schema_version = self.take()
        while (word := self.peek()) is not None:
            if word == "type":
                self.take()
                name = self.name()
                if name in model.types:
                    self.fail(f"type {name} is defined twice")
                model.types[name] = self.relations(name)
            elif word == "condition":
                condition = self.condition()
                if condition.name in model.conditions:
                    self.fail(f"condition {condition.name} is defined twice")
                model.conditions[condition.name] = condition
            else:
                self.fail(f"expected type or condition, found {word}")
        return model

    def relations(self, type_: str) -> dict[str, Relation]:
        out: dict[str, Relation] = {}
        if self.peek() == "relations":
            self.take()
        while self.peek() == "define":
            self.take()
            name = self.name()
            if name in out:
                self.fail(f"relation {type_}#{name} is defined twice")
            self.take(":")
            self.types: list[TypeRef] = []
            out[name] = Relation(self.union(), self.types)
        return out

    def union(self) -> Rewrite:
        return self.chain("or", Union, self.intersection)

    def intersection(self) -> Rewrite:
        return self.chain("and", Intersection, self.difference)

    def chain(self, word: str, kind, part) -> Rewrite:
        parts = [part()]
        while self.peek() == word:
            self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else kind(tuple(parts))

    def difference(self) -> Rewrite:
        out = self.operand()
        while self.peek() == "but not":
            self.take()
            out = Difference(out, self.operand())
        return out

    def operand(self) -> Rewrite:
        word = self.peek()
        if word == "(":
            self.take()
            out = self.union()
            self.take(")")
            return out
        if word == "[":
            self.take()
            while True:
                self.types.append(self.type_ref())
                if self.take() == "]":
                    return This()
        name = self.name()
        if self.peek() == "from":
            self.take()
            return FromParent(self.name(), name)
        return Computed(name)

    def type_ref(self) -> TypeRef:
        type_, relation, wildcard, condition = self.name(), None, False, None
        if self.text[self.at : self.at + 1] == "#":
            self.at += 1
            relation = self.name()
        elif self.peek() == ":":
            self.take()
            self.take("*")
            wildcard = True
        if self.peek() == "with":
            self.take()
            condition = self.name()
        if self.peek() not in (",", "]"):
            self.fail("expected , or ]")
        return TypeRef(type_, relation, wildcard, condition)

    def condition(self) -> Condition:
        self.take("condition")
        name = self.name()
        self.take("(")
        parameters: dict[str, str] = {}
        while self.peek() != ")":
            key = self.name()
            self.take(":")
            start = self.at
            while self.peek() not in (",", ")"):
                if self.text[self.at] == "<":
                    break
                self.take()
                if self.text[self.at : self.at + 1] == "<":
                    self.at = self.text.index(">", self.at) + 1
            parameters[key] = self.text[start : self.at].strip().lower()
            if self.peek() == ",":
                self.take()
        self.take(")")
        self.take("{")
        start, depth, quote = self.at, 1, ""
        while depth:
            if self.at >= len(self.text):
                self.fail(f"condition {name} has no end")
            c = self.text[self.at]
            if quote:
                self.at += c == "\\"
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            else:
                depth += (c == "{") - (c == "}")
            self.at += 1
        return Condition(name, parameters, self.text[start : self.at - 1].strip())


def parse_dsl(text: str) -> Model:
    if not text.strip():
        raise DslError("line 1: the model is empty")
    return _Parser(text).model()


def _text(r: Rewrite, types: list[TypeRef], inside: bool = False) -> str:
    if isinstance(r, This):
        return "[" + ", ".join(t.type + (f"#{t.relation}" if t.relation else ":*" if t.wildcard else "") + (f" with {t.condition}" if t.condition else "") for t in types) + "]"
    if isinstance(r, Computed):
        return r.relation
    if isinstance(r, FromParent):
        return f"{r.relation} from {r.tupleset}"
    word = {Union: " or ", Intersection: " and ", Difference: " but not "}[type(r)]
    out = word.join(_text(c, types, True) for c in r.children())
    return f"({out})" if inside else out


def to_dsl(model: Model) -> str:
    lines = ["model", f"  schema {model.schema_version}"]
    for name, relations in model.types.items():
        lines.append(f"type {name}")
        if relations:
            lines.append("  relations")
        lines += [f"    define {r}: {_text(d.rewrite, d.types)}" for r, d in relations.items()]
    for c in model.conditions.values():
        lines.append(f"condition {c.name}({', '.join(f'{k}: {v}' for k, v in c.parameters.items())}) {{\n  {c.expression}\n}}")
    return "\n".join(lines) + "\n"
