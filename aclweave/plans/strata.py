"""Which relations depend on which, and the order in which they can be computed."""

from __future__ import annotations

from ..model.ast import Computed, Difference, FromParent, Model, Rewrite, This

Node = tuple[str, str]


class NotStratified(ValueError):
    """A relation is defined by excluding what depends on itself."""


def parent_types(model: Model, type_: str, tupleset: str) -> list[str]:
    """Types that a tupleset's tuples may name: by its restriction, or any if it has none."""
    d = model.relation(type_, tupleset)
    if d is None:
        return []
    return list(dict.fromkeys(t.type for t in d.types)) if d.types else list(model.types)


def uses(model: Model, node: Node) -> list[tuple[Node, bool]]:
    """The relations that a relation reads, and whether under the excluded side of a difference."""
    type_, relation = node
    d = model.relation(type_, relation)
    out: list[tuple[Node, bool]] = []

    def visit(r: Rewrite, negative: bool) -> None:
        if isinstance(r, This):
            refs = [(t.type, t.relation) for t in d.types if t.relation] if d.types else [(t, x) for t, rs in model.types.items() for x in rs]
            out.extend((n, negative) for n in refs if model.relation(*n))
        elif isinstance(r, Computed):
            out.append(((type_, r.relation), negative))
        elif isinstance(r, FromParent):
            out.extend(((t, r.relation), negative) for t in parent_types(model, type_, r.tupleset) if model.relation(t, r.relation))
        elif isinstance(r, Difference):
            visit(r.base, negative)
            visit(r.subtract, True)
        else:
            for c in r.children():
                visit(c, negative)

    if d is not None:
        visit(d.rewrite, False)
    return out


def strata(model: Model, roots: list[Node]) -> list[list[Node]]:
    """What roots depend on, as groups of mutually dependent relations (Tarjan), dependencies first."""
    index: dict[Node, int] = {}
    low: dict[Node, int] = {}
    stack: list[Node] = []
    out: list[list[Node]] = []
    for root in roots:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        work = [(root, iter(dict.fromkeys(n for n, _ in uses(model, root))))]
        while work:
            node, rest = work[-1]
            step = next((n for n in rest), None)
            if step is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                    out.append(group[::-1])
            elif step not in index:
                index[step] = low[step] = len(index)
                stack.append(step)
                work.append((step, iter(dict.fromkeys(n for n, _ in uses(model, step)))))
            elif step in stack:
                low[node] = min(low[node], index[step])
    for group in out:
        for node in group:
            if bad := [n for n, negative in uses(model, node) if negative and n in group]:
                raise NotStratified(f"{node[0]}#{node[1]} excludes {bad[0][0]}#{bad[0][1]}, which depends on it")
    return out


def recursive(model: Model, group: list[Node]) -> bool:
    return len(group) > 1 or any(n == group[0] for n, _ in uses(model, group[0]))
