"""The model's parts. A rewrite says how a relation's members are derived."""

from __future__ import annotations

from dataclasses import dataclass, field


class Rewrite:
    """Base of all rewrites."""

    def children(self) -> tuple[Rewrite, ...]:
        return ()


@dataclass(frozen=True)
class This(Rewrite):
    """Users named by tuples of the relation itself, directly or through usersets."""


@dataclass(frozen=True)
class Computed(Rewrite):
    relation: str


@dataclass(frozen=True)
class FromParent(Rewrite):
    """``relation from tupleset``: the relation on each object that the tupleset names."""

    tupleset: str
    relation: str


@dataclass(frozen=True)
class Union(Rewrite):
    parts: tuple[Rewrite, ...]

    def children(self) -> tuple[Rewrite, ...]:
        return self.parts


@dataclass(frozen=True)
class Intersection(Rewrite):
    parts: tuple[Rewrite, ...]

    def children(self) -> tuple[Rewrite, ...]:
        return self.parts


@dataclass(frozen=True)
class Difference(Rewrite):
    base: Rewrite
    subtract: Rewrite

    def children(self) -> tuple[Rewrite, ...]:
        return (self.base, self.subtract)


@dataclass(frozen=True)
class TypeRef:
    """What may stand as user: a type, a userset of it, or everyone of it; perhaps under a condition."""

    type: str
    relation: str | None = None
    wildcard: bool = False
    condition: str | None = None


@dataclass
class Relation:
    rewrite: Rewrite
    types: list[TypeRef] = field(default_factory=list)


@dataclass
class Condition:
    name: str
    parameters: dict[str, str]
    expression: str


@dataclass
class Model:
    types: dict[str, dict[str, Relation]]
    conditions: dict[str, Condition] = field(default_factory=dict)
    schema_version: str = "1.1"
    id: str | None = None

    def relation(self, type_: str, relation: str) -> Relation | None:
        return self.types.get(type_, {}).get(relation)
