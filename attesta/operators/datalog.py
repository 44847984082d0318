"""Recursive rules over atoms: closure by semi-naive rounds, three-valued derivation, proof search and an independent proof check.

Atoms are rows (pred, args array<string>). A rule's body becomes equi-joins on shared variables, constants become filters, negated literals left-anti joins
and comparisons filters. Rules are stratified first, so a negation only sees finished predicates. In a round only joins with at least one new atom run;
new atoms are those no earlier round had. Rounds are written to the checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.expressions import guard_holds
from attesta.sources.shared import checkpointed

MOST_DEPTH = 32
ATOM = "pred string, args array<string>"


@dataclass(frozen=True)
class Literal:
    pred: str
    args: tuple[str, ...]
    negated: bool = False


@dataclass(frozen=True)
class Rule:
    """head if all of body hold; guards are (variable, operator, constant). Variables begin with a question mark."""

    name: str
    head: Literal
    body: tuple[Literal, ...]
    guards: tuple[tuple[str, str, str], ...] = ()


def variable(term: str) -> bool:
    return term.startswith("?")


def literal(obj: dict) -> Literal:
    return Literal(obj["pred"], tuple(map(str, obj.get("args", ()))), bool(obj.get("negated", False)))


def parse_rule(name: str, head: dict, body: dict) -> Rule:
    return Rule(name, literal(head), tuple(map(literal, body.get("literals", ()))), tuple((g["var"], g["op"], str(g["value"])) for g in body.get("guards", ())))


def strata(rules: list[Rule]) -> list[list[Rule]]:
    """Rules in groups, each of which negates only what earlier groups derive; an error if a predicate depends on its own negation."""
    level = {r.head.pred: 0 for r in rules}
    for _ in range(len(level) + 1):
        changed = False
        for r in rules:
            need = max((level[b.pred] + b.negated for b in r.body if b.pred in level), default=0)
            if need > level[r.head.pred]:
                level[r.head.pred], changed = need, True
        if not changed:
            return [[r for r in rules if level[r.head.pred] == k] for k in sorted(set(level.values()))]
    raise ValueError("a predicate depends on its own negation")


def _matches(atoms: DataFrame, lit: Literal, carry: tuple[str, str] | None = None) -> DataFrame:
    """Bindings of a literal: one column a variable; carry names a column of atoms and what it is called here."""
    df = atoms.where((F.col("pred") == lit.pred) & (F.size("args") == len(lit.args)))
    seen: dict[str, int] = {}
    for i, t in enumerate(lit.args):
        if not variable(t):
            df = df.where(F.col("args")[i] == t)
        elif t in seen:
            df = df.where(F.col("args")[i] == F.col("args")[seen[t]])
        else:
            seen[t] = i
    more = [F.col(carry[0]).alias(carry[1])] if carry else []
    return df.select(*[F.col("args")[i].alias(t) for t, i in seen.items()], F.lit(1).alias("_one"), *more)


def bodies(rule: Rule, atoms: DataFrame, new: DataFrame | None, carry: str | None = None):
    """Bindings under which a rule's body holds, if they bind its head; with new, those that use at least one new atom (one table for each literal that takes it).

    Literals meet on the variables they share. One that shares none with those before it multiplies only what is needed of it: the variables that occur elsewhere, and
    nothing but its existence where there are none, so a product is made only where the head itself is one."""
    positive = [b for b in rule.body if not b.negated]
    for turn in range(len(positive)) if new is not None else [-1]:
        bound = None
        for i, lit in enumerate(positive):
            m = _matches(new if i == turn else atoms, lit, (carry, f"_{carry}{i}") if carry else None)
            if bound is None:
                bound = m
                continue
            shared = [c for c in m.columns if c in bound.columns and c != "_one"]
            m = m.drop("_one")
            if shared:
                bound = bound.join(m, shared)
                continue
            elsewhere = {*rule.head.args, *(v for v, _, _ in rule.guards), *(t for j, x in enumerate(rule.body) if x is not lit for t in x.args)}
            m = m.select(*[f"`{c}`" for c in m.columns if c in elsewhere or c.startswith("_")]).distinct()
            bound = bound.crossJoin(m) if m.columns else bound.join(m.withColumn("_two", F.lit(1)).limit(1), F.lit(True), "left_semi")
        if bound is None:
            return
        for lit in (b for b in rule.body if b.negated):
            if any(variable(t) and t not in bound.columns for t in lit.args):
                bound = bound.limit(0)
                continue
            absent = _matches(atoms, lit)
            shared = [c for c in absent.columns if c != "_one"]
            bound = bound.join(absent, shared, "left_anti") if shared else bound.join(absent.limit(1).withColumnRenamed("_one", "_two"), F.lit(True), "left_anti")
        for var, op, value in rule.guards:
            bound = bound.where(guard_holds(F.col(f"`{var}`"), op, value)) if var in bound.columns else bound.limit(0)
        if any(variable(t) and t not in bound.columns for t in rule.head.args):
            return
        yield bound


def _fire(rule: Rule, atoms: DataFrame, new: DataFrame | None) -> DataFrame | None:
    """Head atoms of a rule."""
    out = None
    for bound in bodies(rule, atoms, new):
        head = bound.select(F.lit(rule.head.pred).alias("pred"), F.array(*[F.col(f"`{t}`") if variable(t) else F.lit(t) for t in rule.head.args]).cast("array<string>").alias("args"))
        out = head if out is None else out.unionByName(head)
    return out


def closure_within(atoms: DataFrame, rules: list[Rule], blocked: DataFrame | None = None, rounds: int | None = None) -> tuple[DataFrame, bool]:
    """(derivable atoms, whether they are all): at most so many rounds a stratum, without a limit until one makes nothing new, which comes, as rules make no new terms.

    blocked atoms (those pinned as false) hold neither as given nor as derived."""
    known = atoms.select("pred", "args").distinct()
    if blocked is not None:
        known = known.join(blocked.select("pred", "args"), ["pred", "args"], "left_anti")
    known = checkpointed(known)
    for group in strata(rules):
        new, left = None, rounds
        while left is None or left > 0:
            made = [d for r in group if (d := _fire(r, known, new)) is not None]
            if not made:
                break
            every = made[0]
            for d in made[1:]:
                every = every.unionByName(d)
            every = every.distinct().join(known, ["pred", "args"], "left_anti")
            if blocked is not None:
                every = every.join(blocked.select("pred", "args"), ["pred", "args"], "left_anti")
            new = checkpointed(every)
            if not new.head(1):
                break
            known = checkpointed(known.unionByName(new))
            left = None if left is None else left - 1
        else:
            return known, False  # a later stratum's negations would see an unfinished one
    return known, True


def closure(atoms: DataFrame, rules: list[Rule], blocked: DataFrame | None = None) -> DataFrame:
    """All derivable atoms, see closure_within()."""
    return closure_within(atoms, rules, blocked)[0]


def derive(goals: DataFrame, closed: DataFrame, complete: bool = True) -> DataFrame:
    """goals (pred, args) with status: proved if closed has them; else refuted where closed is complete, and truncated where its rounds were cut short."""
    hit = closed.select("pred", "args", F.lit("proved").alias("status"))
    return goals.join(hit, ["pred", "args"], "left").withColumn("status", F.coalesce("status", F.lit("refuted" if complete else "truncated")))


@dataclass
class Search:
    """What prove() found: proved, or exhausted without a proof, or truncated by its budget."""

    proved: bool
    exhausted: bool
    steps: int
    proof: dict | None = field(default=None)

    @property
    def status(self) -> str:
        return "proved" if self.proved else "exhausted" if self.exhausted else "truncated"


def _bind(pattern: tuple[str, ...], ground: tuple[str, ...], binding: dict[str, str]) -> dict[str, str] | None:
    if len(pattern) != len(ground):
        return None
    out = dict(binding)
    for t, g in zip(pattern, ground, strict=True):
        if (out.setdefault(t, g) if variable(t) else t) != g:
            return None
    return out


def _true(binding: dict[str, str], guard: tuple[str, str, str]) -> bool:
    var, op, value = guard
    left = binding.get(var)
    if left is None:
        return False
    if op in ("==", "!="):
        return (left == value) == (op == "==")
    try:
        a, b = float(left), float(value)
    except ValueError:
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def prove(goal: tuple[str, tuple[str, ...]], base: set[tuple[str, tuple[str, ...]]], closed: set[tuple[str, tuple[str, ...]]], rules: list[Rule], budget: int = 10_000) -> Search:
    """Backward search for a proof over the atoms that matter for one goal, on the driver: a search is sequential, and proofs are for reading."""
    index: dict[str, list[tuple[str, ...]]] = {}
    for p, a in sorted(closed):
        index.setdefault(p, []).append(a)
    steps, truncated, open_ = 0, False, set()

    def atom(pred: str, args: tuple[str, ...], depth: int) -> dict | None:
        nonlocal steps, truncated
        if steps >= budget:
            truncated = True
            return None
        steps += 1
        if (pred, args) in base:
            return {"atom": [pred, list(args)], "given": True}
        if (pred, args) in open_:
            return None
        if depth > MOST_DEPTH:
            truncated = True
            return None
        open_.add((pred, args))
        try:
            for r in rules:
                if r.head.pred == pred and (b := _bind(r.head.args, args, {})) is not None:
                    got = body(r, 0, b, depth)
                    if got is not None:
                        return {"atom": [pred, list(args)], "rule": r.name, "premises": got}
        finally:
            open_.discard((pred, args))
        return None

    def body(rule: Rule, i: int, binding: dict[str, str], depth: int) -> list | None:
        if i == len(rule.body):
            return [] if all(_true(binding, g) for g in rule.guards) else None
        lit = rule.body[i]
        probe = tuple(binding.get(t, t) for t in lit.args)
        if lit.negated:
            if any(map(variable, probe)) or (lit.pred, probe) in closed:
                return None
            rest = body(rule, i + 1, binding, depth)
            return None if rest is None else [{"absent": [lit.pred, list(probe)]}, *rest]
        for ground in index.get(lit.pred, ()) if any(map(variable, probe)) else [probe]:
            merged = _bind(lit.args, ground, binding)
            if merged is None or (sub := atom(lit.pred, ground, depth + 1)) is None:
                continue
            if (rest := body(rule, i + 1, merged, depth)) is not None:
                return [sub, *rest]
        return None

    found = atom(*goal, 0)
    return Search(found is not None, found is None and not truncated, steps, found)


def check_proof(proof: dict, base: set, closed: set, rules: list[Rule]) -> bool:
    """Whether a proof holds, by the rules alone and without searching."""
    if proof.get("given"):
        return (proof["atom"][0], tuple(proof["atom"][1])) in base
    rule = next((r for r in rules if r.name == proof.get("rule")), None)
    if rule is None or len(rule.body) != len(proof["premises"]):
        return False
    binding = _bind(rule.head.args, tuple(proof["atom"][1]), {}) if rule.head.pred == proof["atom"][0] else None
    for lit, p in zip(rule.body, proof["premises"], strict=True):
        if binding is None:
            return False
        pred, args = p["absent"] if lit.negated and "absent" in p else p.get("atom", (None, ()))
        binding = _bind(lit.args, tuple(args), binding) if pred == lit.pred else None
        if lit.negated and ("absent" not in p or (pred, tuple(args)) in closed) or not lit.negated and not check_proof(p, base, closed, rules):
            return False
    return binding is not None and all(_true(binding, g) for g in rule.guards)


def proof_quality(premises: DataFrame, facts: DataFrame) -> DataFrame:
    """premises (goal, fact), facts (fact, flagged, breadth_class): proof, or one that rests on a fact whose context isn't understood."""
    doubt = F.coalesce(F.col("flagged"), F.lit(False)) | F.coalesce(F.col("breadth_class") == "narrow", F.lit(False))
    return premises.join(facts, "fact", "left").groupBy("goal").agg(F.when(F.bool_or(doubt), "proof-modulo-unknown-context").otherwise("proof").alias("quality"))


def atoms_of(spark: SparkSession, rows: list[tuple[str, list[str]]]) -> DataFrame:
    return spark.createDataFrame(rows, ATOM)
