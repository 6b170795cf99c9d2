"""Models as JSON, with keys in camel or snake case."""

from __future__ import annotations

import json
import re

from .ast import Computed, Condition, Difference, FromParent, Intersection, Model, Relation, Rewrite, This, TypeRef, Union

MAX_DEPTH = 25


def _get(d: dict, name: str, default=None):
    camel = re.sub(r"_([a-z])", lambda m: m[1].upper(), name)
    return d.get(name, d.get(camel, default))


def _rewrite(d: dict, depth: int = 0) -> Rewrite:
    if depth > MAX_DEPTH:
        raise ValueError(f"rewrites are nested more than {MAX_DEPTH} deep")
    if not isinstance(d, dict):
        raise ValueError("a rewrite must be an object")
    if "this" in d:
        return This()
    if (c := _get(d, "computed_userset")) is not None:
        return Computed(c["relation"])
    if (c := _get(d, "tuple_to_userset")) is not None:
        return FromParent(_get(c, "tupleset")["relation"], _get(c, "computed_userset")["relation"])
    for key, kind in (("union", Union), ("intersection", Intersection)):
        if key in d:
            parts = d[key].get("child") or []
            if not parts:
                raise ValueError(f"{key} has no children")
            return kind(tuple(_rewrite(p, depth + 1) for p in parts))
    if (c := d.get("difference", d.get("exclusion"))) is not None:
        return Difference(_rewrite(c["base"], depth + 1), _rewrite(c["subtract"], depth + 1))
    raise ValueError(f"unknown rewrite: {sorted(d)}")


def from_json(data: str | dict) -> Model:
    """A model from its JSON text or the object in it."""
    d = json.loads(data) if isinstance(data, str) else data
    types: dict[str, dict[str, Relation]] = {}
    for t in _get(d, "type_definitions", []):
        metadata = (_get(t, "metadata") or {}).get("relations") or {}
        if t["type"] in types:
            raise ValueError(f"type {t['type']} is defined twice")
        types[t["type"]] = {
            name: Relation(_rewrite(r), [TypeRef(x["type"], x.get("relation") or None, x.get("wildcard") is not None, x.get("condition") or None) for x in _get(metadata.get(name) or {}, "directly_related_user_types", [])])
            for name, r in (t.get("relations") or {}).items()
        }
    conditions = {}
    for name, c in (d.get("conditions") or {}).items():
        parameters = {k: re.sub("^type_name_", "", str(_get(v, "type_name", "any")).lower()) for k, v in (c.get("parameters") or {}).items()}
        conditions[name] = Condition(c.get("name") or name, parameters, c["expression"])
    return Model(types, conditions, _get(d, "schema_version", "1.1"), d.get("id"))


def _out(r: Rewrite) -> dict:
    if isinstance(r, This):
        return {"this": {}}
    if isinstance(r, Computed):
        return {"computedUserset": {"relation": r.relation}}
    if isinstance(r, FromParent):
        return {"tupleToUserset": {"tupleset": {"relation": r.tupleset}, "computedUserset": {"relation": r.relation}}}
    if isinstance(r, Difference):
        return {"difference": {"base": _out(r.base), "subtract": _out(r.subtract)}}
    return {("union" if isinstance(r, Union) else "intersection"): {"child": [_out(c) for c in r.children()]}}


def to_json(model: Model) -> str:
    definitions = []
    for name, relations in model.types.items():
        t: dict = {"type": name, "relations": {r: _out(d.rewrite) for r, d in relations.items()}}
        restricted = {r: d.types for r, d in relations.items() if d.types}
        if restricted:
            refs = lambda x: {"type": x.type} | ({"relation": x.relation} if x.relation else {}) | ({"wildcard": {}} if x.wildcard else {}) | ({"condition": x.condition} if x.condition else {})
            t["metadata"] = {"relations": {r: {"directly_related_user_types": [refs(x) for x in v]} for r, v in restricted.items()}}
        definitions.append(t)
    conditions = {c.name: {"name": c.name, "expression": c.expression, "parameters": {k: {"type_name": f"TYPE_NAME_{v.upper()}"} for k, v in c.parameters.items()}} for c in model.conditions.values()}
    return json.dumps({"schema_version": model.schema_version, "type_definitions": definitions} | ({"conditions": conditions} if conditions else {}))
