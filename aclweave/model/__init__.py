"""Authorization models: types, text and JSON forms, validation."""

from .ast import Computed, Condition, Difference, FromParent, Intersection, Model, Relation, This, TypeRef, Union
from .dsl import parse_dsl, to_dsl
from .jsonform import from_json, to_json
from .validate import ModelError, check_model, validate

__all__ = ["Computed", "Condition", "Difference", "FromParent", "Intersection", "Model", "ModelError", "Relation", "This", "TypeRef", "Union", "check_model", "from_json", "parse_dsl", "to_dsl", "to_json", "validate"]
