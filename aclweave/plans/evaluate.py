"""Evaluation of relations for many users at once.

A seed is one distinct (user, context) of a batch, with its contextual tuples. A relation's answer is the set of rows
(seed_id, object_id). Two ways lead there:

* with demand (Check): which (seed, object) pairs matter is found first, from the requested pairs down through computed
  relations, parents and usersets; every leaf is then an equi-join on object and user of just those pairs.
* without (ListObjects): leaves start from the seeds' own tuples, and answers grow upwards.

Users are bound at the leaves, where a wildcard matches every seed of its type, so intersection and exclusion are plain set
operations. A condition that fails (a missing key, say) is neither true nor false, so with conditions every relation has a
lower answer, where such a leaf is absent, and an upper one, where it is present; what is only in the upper one is an error.
So is a tuple's condition that the model doesn't know. Relations below which no tuple has a condition have one answer.
The excluded side of a difference is read from the other answer. Mutually dependent relations are least fixpoints: where all of a group's rules are linear, each round joins only
what the last one found.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cel import CelError
from ..functions.compiler import compile_condition
from ..model.ast import Computed, Difference, FromParent, Intersection, Model, Rewrite, This, TypeRef
from ..model.validate import walk
from ..sources.tuples import Relations, with_columns
from .cut import stored
from .strata import Node, recursive, strata, uses

PAIR = "seed_id bigint, object_id string"
#: Rounds of a fixpoint whose tables are read one by one before they become one.
MERGED = 8


class Evaluator:
    """One model over one set of tuples for one batch of seeds.

    tuples: the tuple columns. seeds: seed_id, user_type, user_id, user_relation, context (JSON). contextual: tuple columns
    with the seed_id that alone sees them. link_conditions: whether tuplesets' tuples must meet their conditions.
    """

    rounds = True

    def __init__(self, model: Model, tuples: DataFrame | Relations, seeds: DataFrame, contextual: DataFrame | None = None, link_conditions: bool = False):
        self.model, self.seeds, self.link_conditions = model, seeds, link_conditions
        self.spark = seeds.sparkSession
        self.tuples, self.contextual = tuples if isinstance(tuples, Relations) else with_columns(tuples), contextual
        self.answers: tuple[dict[Node, DataFrame], dict[Node, DataFrame]] = ({}, {})
        self.demand: dict[Node, DataFrame] | None = None
        self._conditional: dict[Node, bool] = {}
        self._everyone: dict[Node, bool] = {}
        self._named: set[Node] | None = None

    # leaves

    def rows(self, type_: str, relation: str) -> list[DataFrame]:
        """Stored tuples of a relation, and contextual ones (which have a seed_id)."""
        own = (F.col("object_type") == type_) & (F.col("relation") == relation)
        out = [self.tuples.rows(type_, relation) if isinstance(self.tuples, Relations) else self.tuples.filter(own)]
        if self.contextual is not None:
            out.append(self.contextual.filter(own))
        return out

    def conditional(self, type_: str, relation: str) -> bool:
        """Whether any tuple of a relation names a condition."""
        named = F.col("condition_name").isNotNull()
        if isinstance(self.tuples, Relations) and self.contextual is None:
            if (type_, relation) not in self._conditional:
                self._conditional[type_, relation] = not self.tuples.rows(type_, relation).filter(named).isEmpty()
            return self._conditional[type_, relation]
        if self._named is None:
            frames = [self.tuples.all() if isinstance(self.tuples, Relations) else self.tuples] + ([] if self.contextual is None else [self.contextual])
            own = [df.filter(named).select("object_type", "relation") for df in frames]
            known = [f"{t}#{r}" for t, rs in self.model.types.items() for r in rs]  # at most the model's relations
            self._named = {(r[0], r[1]) for r in functools.reduce(DataFrame.unionByName, own).filter(F.concat_ws("#", "object_type", "relation").isin(known)).distinct().collect()}
        return (type_, relation) in self._named

    def everyone(self, type_: str, relation: str) -> bool:
        """Whether a stored tuple of a relation may name everyone."""
        if not isinstance(self.tuples, Relations):
            return True
        if (type_, relation) not in self._everyone:
            self._everyone[type_, relation] = not self.tuples.rows(type_, relation).filter((F.col("user_id") == "*") & F.col("user_relation").isNull()).isEmpty()
        return self._everyone[type_, relation]

    def mixed(self, groups: list[list[Node]]) -> set[Node]:
        """The relations whose lower and upper answers may differ: a tuple that they read, or one below, has a condition."""
        out: set[Node] = set()
        for group in groups:
            for n in group:
                rules = list(walk(self.model.relation(*n).rewrite))
                own = any(isinstance(r, This) for r in rules) and self.conditional(*n)
                own = own or self.link_conditions and any(isinstance(r, FromParent) and self.conditional(n[0], r.tupleset) for r in rules)
                if own or any(m in out for m, _ in uses(self.model, n)):
                    out.update(group)
        return out

    def allowed(self, types: list[TypeRef], rows: DataFrame) -> DataFrame:
        """Tuples whose user the relation's restrictions admit; no restrictions admit all."""
        if not types:
            return rows
        plain = sorted({t.type for t in types if not t.relation})
        sets = sorted({f"{t.type}#{t.relation}" for t in types if t.relation})
        ok = F.lit(False)
        if plain:
            ok = ok | (F.col("user_relation").isNull() & F.col("user_type").isin(plain))
        if sets:
            ok = ok | F.concat_ws("#", "user_type", "user_relation").isin(sets) & F.col("user_relation").isNotNull()
        return rows.filter(ok)

    def holding(self, rows: DataFrame, keep: list[str], upper: int, conditional: bool = True) -> DataFrame:
        """Rows (with seed_id) whose condition holds in the seed's context, or in the upper answer may hold.

        A condition that the model doesn't know is one that fails.
        """
        if not conditional:
            return rows.filter(F.col("condition_name").isNull()).select(*keep)
        rows = rows.join(self.seeds.select("seed_id", "context"), "seed_id")
        true, false = F.lit(True), F.lit(False)
        holds: Column = F.when(F.col("condition_name").isNull(), true)
        for c in self.model.conditions.values():
            try:
                ok, bad = compile_condition(c, F.col("condition_context"), F.col("context"))
            except CelError:
                ok, bad = false, true  # such an expression fails whenever it is evaluated
            holds = holds.when(F.col("condition_name") == c.name, ok | bad if upper else ok)
        return rows.filter(holds.otherwise(true if upper else false)).select(*keep)

    def users(self) -> DataFrame:
        return self.seeds.filter(F.col("user_id") != "*")  # a request for everyone matches nothing

    def direct(self, node: Node, types: list[TypeRef], upper: int) -> DataFrame:
        """Pairs by a tuple that names the seed, or everyone of its type."""
        users = self.users().select("seed_id", F.col("user_type").alias("_t"), F.col("user_id").alias("_u"), F.col("user_relation").alias("_r"))
        exact = lambda r: (r["user_type"] == users["_t"]) & (r["user_id"] == users["_u"]) & r["user_relation"].eqNullSafe(users["_r"])
        everyone = lambda r: (r["user_type"] == users["_t"])
        stored_rows, *ctx = self.rows(*node)
        found = []
        for k, rows in enumerate([stored_rows, *ctx]):
            rows = self.allowed(types, rows).select("object_id", "user_type", "user_id", "user_relation", "condition_name", "condition_context", *(["seed_id"] if k else []))
            wild = rows.filter((F.col("user_id") == "*") & F.col("user_relation").isNull())
            keep = ["seed_id", "object_id", "condition_name", "condition_context"]
            if k:  # a contextual tuple meets its own seed
                own = users.withColumnRenamed("seed_id", "_s")
                match = lambda r: (r["user_type"] == own["_t"]) & (r["user_id"] == own["_u"]) & r["user_relation"].eqNullSafe(own["_r"])  # noqa: B023, E731
                found.append(rows.join(own, (rows["seed_id"] == own["_s"]) & match(rows)).select(*keep))
                found.append(wild.join(own, (wild["seed_id"] == own["_s"]) & (wild["user_type"] == own["_t"])).filter(F.col("_r").isNull()).select(*keep))
            elif self.demand is not None:
                wanted = self.demand[node].join(users, "seed_id")
                found.append(rows.join(wanted.withColumnRenamed("object_id", "_o"), (rows["object_id"] == F.col("_o")) & (rows["user_type"] == F.col("_t")) & (rows["user_id"] == F.col("_u")) & rows["user_relation"].eqNullSafe(F.col("_r"))).select(*keep))
                if self.everyone(*node):
                    found.append(wild.join(wanted.withColumnRenamed("object_id", "_o"), (wild["object_id"] == F.col("_o")) & (wild["user_type"] == F.col("_t"))).filter(F.col("_r").isNull()).select(*keep))
            else:
                found.append(rows.join(users, exact(rows)).select(*keep))
                found.append(wild.join(users, everyone(wild)).filter(F.col("_r").isNull()).select(*keep))
        both = functools.reduce(DataFrame.unionByName, found)
        return self.holding(both, ["seed_id", "object_id"], upper, self.conditional(*node))

    def usersets(self, node: Node, types: list[TypeRef], answers: dict[Node, DataFrame], upper: int) -> DataFrame | None:
        """Pairs by a tuple that names a userset in ``answers`` which the seed belongs to."""
        found = []
        for k, rows in enumerate(self.rows(*node)):
            rows = self.allowed(types, rows.filter(F.col("user_relation").isNotNull()))
            for (t, r), members in answers.items():
                own = rows.filter((F.col("user_type") == t) & (F.col("user_relation") == r)).select("object_id", F.col("user_id").alias("_set"), "condition_name", "condition_context", *(["seed_id"] if k else []))
                members = members.select("seed_id", F.col("object_id").alias("_set"))
                if self.demand is not None and not k:
                    own = own.join(self.demand[node], "object_id")
                joined = own.join(members, ["seed_id", "_set"]) if "seed_id" in own.columns else own.join(members, "_set")
                found.append(joined.select("seed_id", "object_id", "condition_name", "condition_context"))
        if not found:
            return None
        return self.holding(functools.reduce(DataFrame.unionByName, found), ["seed_id", "object_id"], upper, self.conditional(*node))

    def from_parent(self, node: Node, r: FromParent, answers: dict[Node, DataFrame], upper: int) -> DataFrame | None:
        """Pairs by a tupleset's tuple that names an object in ``answers``."""
        found = []
        stored_rows, *ctx = self.rows(node[0], r.tupleset)
        for k, rows in enumerate([stored_rows, *(ctx if self.link_conditions else [])]):
            links = rows.filter(F.col("user_relation").isNull() & (F.col("user_id") != "*"))
            for (t, _), members in answers.items():
                own = links.filter(F.col("user_type") == t).select("object_id", F.col("user_id").alias("_parent"), "condition_name", "condition_context", *(["seed_id"] if k else []))
                members = members.select("seed_id", F.col("object_id").alias("_parent"))
                if self.demand is not None and not k:
                    own = own.join(self.demand[node], "object_id")
                joined = own.join(members, ["seed_id", "_parent"]) if "seed_id" in own.columns else own.join(members, "_parent")
                found.append(joined.select("seed_id", "object_id", "condition_name", "condition_context"))
        if not found:
            return None
        out = functools.reduce(DataFrame.unionByName, found)
        return self.holding(out, ["seed_id", "object_id"], upper, self.conditional(node[0], r.tupleset)) if self.link_conditions else out.select("seed_id", "object_id")

    # rules

    def none(self) -> DataFrame:
        return self.spark.createDataFrame([], PAIR)

    def rule(self, node: Node, r: Rewrite, answers: dict[Node, DataFrame], upper: int, base: bool = True) -> DataFrame | None:
        """A rewrite over ``answers``; with base=False only what these contribute (None: nothing)."""
        d = self.model.relation(*node)
        if isinstance(r, This):
            reads = {n: answers[n] for n, _ in uses(self.model, node) if n in answers and (not d.types or any((t.type, t.relation) == n for t in d.types))}
            parts = [self.direct(node, d.types, upper)] if base else []
            if reads and (found := self.usersets(node, d.types, reads, upper)) is not None:
                parts.append(found)
            return functools.reduce(DataFrame.unionByName, parts) if parts else None
        if isinstance(r, Computed):
            return answers.get((node[0], r.relation), self.none() if base else None)
        if isinstance(r, FromParent):
            reads = {(t, x): a for (t, x), a in answers.items() if x == r.relation and self._links(node, r, t)}
            found = self.from_parent(node, r, reads, upper) if reads else None
            return self.none() if found is None and base else found
        if isinstance(r, Difference):
            left = self.rule(node, r.base, answers, upper)
            right = self.rule(node, r.subtract, self.answers[1 - upper], 1 - upper)
            return left.distinct().join(right, ["seed_id", "object_id"], "left_anti")
        parts = [p for p in (self.rule(node, c, answers, upper, base) for c in r.children()) if p is not None]
        if isinstance(r, Intersection):
            return functools.reduce(lambda a, b: a.join(b, ["seed_id", "object_id"], "left_semi"), [parts[0].distinct(), *parts[1:]])
        return functools.reduce(DataFrame.unionByName, parts) if parts else None

    def _links(self, node: Node, r: FromParent, type_: str) -> bool:
        d = self.model.relation(node[0], r.tupleset)
        return d is None or not d.types or any(t.type == type_ for t in d.types)

    def linear(self, node: Node) -> bool:
        """Whether a relation is a union of leaves, so that new answers follow from the last ones alone."""
        return not any(isinstance(r, Intersection | Difference) for r in walk(self.model.relation(*node).rewrite))

    def fixpoint(self, group: list[Node], upper: int) -> None:
        outer = {n: a for n, a in self.answers[upper].items() if n not in group}
        linear = all(self.linear(n) for n in group)
        rewrites = {n: self.model.relation(*n).rewrite for n in group}
        known = {n: stored(self.rule(n, rewrites[n], outer, upper).distinct()) for n in group}
        fresh, n_rounds = dict(known), 0
        while self.rounds:
            after = {}
            for n in group:
                got = self.rule(n, rewrites[n], fresh, upper, base=False) if linear else self.rule(n, rewrites[n], outer | known, upper)
                if got is not None:
                    after[n] = stored(got.distinct().join(known[n], ["seed_id", "object_id"], "left_anti"))
            fresh = {n: a for n, a in after.items() if not a.isEmpty()}
            if not fresh:
                break
            n_rounds += 1
            known = self.grown(known, fresh, n_rounds)
        self.answers[upper].update(known)

    @staticmethod
    def grown(known: dict[Node, DataFrame], fresh: dict[Node, DataFrame], n_rounds: int) -> dict[Node, DataFrame]:
        """``known`` with a round's new pairs; every MERGED rounds written as one table, so that deep graphs keep short plans."""
        out = known | {n: known[n].unionByName(a) for n, a in fresh.items()}
        return out if n_rounds % MERGED else {n: stored(a) for n, a in out.items()}

    # demand

    def find_demand(self, requested: dict[Node, DataFrame]) -> None:
        """For each relation the (seed, object) pairs whose answers the requested pairs depend on."""
        groups = strata(self.model, list(requested))[::-1]
        wanted: dict[Node, list[DataFrame]] = {n: [d] for n, d in requested.items()}
        self.demand = {}
        for group in groups:
            own = {n: functools.reduce(DataFrame.unionByName, wanted[n]).distinct() if n in wanted else None for n in group}
            known: dict[Node, DataFrame] = {}
            if recursive(self.model, group):
                known = {n: stored(d if d is not None else self.none()) for n, d in own.items()}
                fresh, n_rounds = dict(known), 0
                while fresh:
                    asked: dict[Node, list[DataFrame]] = {}
                    for n, d in fresh.items():
                        for m, pairs in self.below(n, d, set(group)):
                            asked.setdefault(m, []).append(pairs)
                    after = {m: stored(functools.reduce(DataFrame.unionByName, p).distinct().join(known[m], ["seed_id", "object_id"], "left_anti")) for m, p in asked.items()}
                    fresh = {m: d for m, d in after.items() if not d.isEmpty()}
                    n_rounds += 1
                    known = self.grown(known, fresh, n_rounds)
                own = known
            for n in group:
                # read more than once, by what is below and by the answers: distinct pairs are kept, but for requested pairs of
                # seeds with contextual tuples, which are about as many as the requests and are kept with these
                asked_for = own[n] is not None and n not in known and (self.contextual is None or n not in requested or len(wanted[n]) > 1)
                self.demand[n] = self.none() if own[n] is None else stored(own[n]) if asked_for else own[n]
                targets = {m for m, _ in uses(self.model, n)} - set(group)
                for m, pairs in self.below(n, self.demand[n], targets) if targets else ():
                    wanted.setdefault(m, []).append(pairs)

    def below(self, node: Node, pairs: DataFrame, targets: set[Node]) -> list[tuple[Node, DataFrame]]:
        """The pairs that a relation's answers for ``pairs`` ask of each target."""
        out: list[tuple[Node, DataFrame]] = []
        d = self.model.relation(*node)
        for r in dict.fromkeys(walk(d.rewrite)):
            if isinstance(r, Computed) and (node[0], r.relation) in targets:
                out.append(((node[0], r.relation), pairs))
            if isinstance(r, FromParent | This):
                for k, rows in enumerate(self.rows(node[0], r.tupleset if isinstance(r, FromParent) else node[1])):
                    if isinstance(r, FromParent):
                        if k and not self.link_conditions:
                            continue
                        refs = [(t, x) for t, x in targets if x == r.relation and self._links(node, r, t)]
                        near = rows.filter(F.col("user_relation").isNull() & (F.col("user_id") != "*"))
                    else:
                        refs = [(t, x) for t, x in targets if not d.types or any((y.type, y.relation) == (t, x) for y in d.types)]
                        near = rows.filter(F.col("user_relation").isNotNull())
                    for t, x in refs:
                        own = near.filter(F.col("user_type") == t)
                        own = own if isinstance(r, FromParent) else own.filter(F.col("user_relation") == x)
                        own = own.select("object_id", "user_id", *(["seed_id"] if k else []))
                        out.append(((t, x), own.join(pairs, ["seed_id", "object_id"] if k else "object_id").select("seed_id", F.col("user_id").alias("object_id"))))
        return out

    # all

    def run(self, roots: list[Node], requested: dict[Node, DataFrame] | None = None) -> dict[Node, tuple[DataFrame, DataFrame]]:
        """Lower and upper answers of the roots; with ``requested`` pairs only as far as these need them."""
        if requested is not None:
            self.find_demand(requested)
        groups = strata(self.model, roots)
        mixed = self.mixed(groups)
        for group in groups:
            for upper in (0, 1) if group[0] in mixed else (0,):
                if recursive(self.model, group):
                    self.fixpoint(group, upper)
                else:
                    found = self.rule(group[0], self.model.relation(*group[0]).rewrite, self.answers[upper], upper)
                    self.answers[upper][group[0]] = found.distinct()
            if group[0] not in mixed:
                self.answers[1].update({n: self.answers[0][n] for n in group})
        return {n: (self.answers[0][n], self.answers[1][n]) for n in roots}


class DirectEvaluator(Evaluator):
    """ListObjects as the compared engine answers it: usersets aren't followed and type restrictions don't filter, parents
    come from declared types under their tuples' conditions, and no relation is followed into itself."""

    rounds = False

    def __init__(self, model: Model, tuples: DataFrame | Relations, seeds: DataFrame):
        super().__init__(model, tuples, seeds, None, True)

    def allowed(self, types: list[TypeRef], rows: DataFrame) -> DataFrame:
        return rows

    def usersets(self, *_) -> None:
        return None

    def _links(self, node: Node, r: FromParent, type_: str) -> bool:
        d = self.model.relation(node[0], r.tupleset)
        return d is not None and any(t.type == type_ for t in d.types)
