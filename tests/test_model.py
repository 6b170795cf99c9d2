import pytest

from aclweave.model import Computed, Difference, FromParent, Intersection, ModelError, This, TypeRef, Union, check_model, from_json, parse_dsl, to_dsl, to_json, validate
from aclweave.model.dsl import DslError
from aclweave.queries import MODEL_TEXT


def test_precedence_and_groups():
    m = parse_dsl("type user\ntype d\n relations\n define a: [user]\n define b: a or a and a but not a\n define c: (a or b) and a\n define p: [d]\n define e: [user] but not a from p")
    assert m.relation("d", "b").rewrite == Union((Computed("a"), Intersection((Computed("a"), Difference(Computed("a"), Computed("a"))))))
    assert m.relation("d", "c").rewrite == Intersection((Union((Computed("a"), Computed("b"))), Computed("a")))
    assert m.relation("d", "e").rewrite == Difference(This(), FromParent("p", "a"))


def test_type_restrictions_comments_conditions():
    m = parse_dsl('# head\nmodel\n  schema 1.1\ntype user # people\ntype g\n  relations\n    define m: [user, user:*, g#m, user with c]\ncondition c(x: int, l: list<string>) {\n  x > 1 && "}" in l\n}')
    assert m.relation("g", "m").types == [TypeRef("user"), TypeRef("user", None, True), TypeRef("g", "m"), TypeRef("user", None, False, "c")]
    assert m.conditions["c"].parameters == {"x": "int", "l": "list<string>"}
    assert m.conditions["c"].expression == 'x > 1 && "}" in l'


def test_round_trips():
    m = parse_dsl(MODEL_TEXT)
    assert parse_dsl(to_dsl(m)) == m
    assert from_json(to_json(m)).types == m.types


@pytest.mark.parametrize("key", ["difference", "exclusion"])
def test_json_key_styles(key):
    relations = {"a": {"this": {}}, "b": {key: {"base": {"computed_userset": {"relation": "a"}}, "subtract": {"computedUserset": {"relation": "a"}}}}}
    m = from_json({"schemaVersion": "1.1", "typeDefinitions": [{"type": "d", "relations": relations}]})
    assert m.relation("d", "b").rewrite == Difference(Computed("a"), Computed("a"))


def test_bad_texts():
    for text in ("", "type", "type d relations define a", "type d relations define a: [user", "type d\ntype d", "condition c(x: int) { x"):
        with pytest.raises(DslError):
            parse_dsl(text)
    with pytest.raises(ValueError, match="no children"):
        from_json({"type_definitions": [{"type": "d", "relations": {"a": {"union": {"child": []}}}}]})
    deep = {"this": {}}
    for _ in range(30):
        deep = {"union": {"child": [deep]}}
    with pytest.raises(ValueError, match="deep"):
        from_json({"type_definitions": [{"type": "d", "relations": {"a": deep}}]})


def test_all_errors_are_collected():
    m = parse_dsl("type user\ntype d\n relations\n define a: [nobody, user with no] or gone\n define b: c\n define c: b\n define e: x from nowhere\ncondition k(x: colour) { x > }")
    found = validate(m)
    for part in ("nobody", "condition no", "gone", "circle", "nowhere", "colour", "condition k"):
        assert any(part in e for e in found), part
    with pytest.raises(ModelError):
        check_model(m)
    assert validate(parse_dsl(MODEL_TEXT)) == []
