"""All that is wrong with a model, collected."""

from __future__ import annotations

import re

from .ast import Computed, Difference, FromParent, Intersection, Model, Rewrite, Union

MAX_EXPRESSION = 4096
#: The names that parameter types may have.
PARAMETER_TYPES = {"unspecified", "any", "bool", "string", "int", "uint", "double", "duration", "timestamp", "map", "list", "ipaddress"}


class ModelError(ValueError):
    """A model with errors; ``errors`` lists them."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


def walk(r: Rewrite):
    yield r
    for c in r.children():
        yield from walk(c)


def validate(model: Model) -> list[str]:
    from ..functions.cel import CelError, parse

    errors = []
    if model.schema_version not in ("1.1", "1.2"):
        errors.append(f"schema version {model.schema_version} is not supported")
    for t, relations in model.types.items():
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,254}", t):
            errors.append(f"type name {t!r} is not valid")
        for name, d in relations.items():
            at = f"{t}#{name}"
            if not re.fullmatch(r"[^:#@\s]{1,50}", name):
                errors.append(f"relation name {at!r} is not valid")
            for ref in d.types:
                if ref.type not in model.types:
                    errors.append(f"{at}: type {ref.type} is not defined")
                elif ref.relation and ref.relation not in model.types[ref.type]:
                    errors.append(f"{at}: relation {ref.type}#{ref.relation} is not defined")
                if ref.condition and ref.condition not in model.conditions:
                    errors.append(f"{at}: condition {ref.condition} is not defined")
            for r in walk(d.rewrite):
                if isinstance(r, Computed) and r.relation not in relations:
                    errors.append(f"{at}: relation {r.relation} is not defined on {t}")
                if isinstance(r, FromParent):
                    if r.tupleset not in relations:
                        errors.append(f"{at}: tupleset {r.tupleset} is not defined on {t}")
                    elif relations[r.tupleset].types and not any(r.relation in model.types.get(x.type, {}) for x in relations[r.tupleset].types):
                        errors.append(f"{at}: no type of {t}#{r.tupleset} has relation {r.relation}")
                if isinstance(r, Union | Intersection) and not r.parts:
                    errors.append(f"{at}: an operator has no operands")
        errors += [f"{t}#{r}: computed relations go in a circle" for r in _circles(relations)]
    for c in model.conditions.values():
        if len(c.expression) > MAX_EXPRESSION:
            errors.append(f"condition {c.name}: longer than {MAX_EXPRESSION} characters")
            continue
        for key, kind in c.parameters.items():
            if re.sub("<.*", "", kind) not in PARAMETER_TYPES:
                errors.append(f"condition {c.name}: parameter {key} has unknown type {kind}")
        try:
            parse(c.expression)
        except CelError as e:
            errors.append(f"condition {c.name}: {e}")
    return errors


def _circles(relations: dict) -> list[str]:
    """Relations that reach themselves through computed relations of the same type alone."""
    near = {name: {r.relation for r in walk(d.rewrite) if isinstance(r, Computed)} for name, d in relations.items()}

    def reaches(start: str) -> bool:
        seen, todo = set(), list(near[start])
        while todo:
            x = todo.pop()
            if x == start:
                return True
            if x not in seen:
                seen.add(x)
                todo += near.get(x, ())
        return False

    return [r for r in near if reaches(r)]


def check_model(model: Model) -> Model:
    if errors := validate(model):
        raise ModelError(errors)
    return model


__all__ = ["Difference", "ModelError", "check_model", "validate", "walk"]
