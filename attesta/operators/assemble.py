"""From goals to predictions: the supports of derived atoms, the problem that each goal poses, its calibrated answer, and the same at an earlier state of the log.

A support of an atom is the set of facts and rules that one derivation rests on. A given atom is supported by its own fact; a derived atom has one support for each
way in which a rule yields it, made of the rule and the *first* support of each atom in the body. The first support of a derived atom is the smallest, as a sorted
array, among those of the round that first made it.
"""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.canon import canon_json
from attesta.operators import calibration, constraints, predict, tallies
from attesta.operators.components import connected_components
from attesta.operators.datalog import Rule, bodies, strata
from attesta.sources import ledger
from attesta.sources.shared import checkpointed

ENGINE = "attesta/1"
PREDICTOR, CONJECTURE = "worlds/v1", "conjecture/v1"


def _heads(rules: list[Rule], atoms: DataFrame, new: DataFrame | None) -> DataFrame | None:
    """(pred, args, support) that rules make of atoms (pred, args, first)."""
    out = None
    for rule in rules:
        for bound in bodies(rule, atoms, new, carry="first"):
            support = F.array_sort(F.array_distinct(F.flatten(F.array(F.array(F.lit(rule.name)), *[F.col(c) for c in bound.columns if c.startswith("_first")]))))
            head = bound.select(F.lit(rule.head.pred).alias("pred"), F.array(*[F.col(f"`{t}`") if t.startswith("?") else F.lit(t) for t in rule.head.args]).cast("array<string>").alias("args"), support.alias("support"))
            out = head if out is None else out.unionByName(head)
    return out


def supports(base: DataFrame, rules: list[Rule]) -> DataFrame:
    """(pred, args, supports array<array<string>>) of everything that follows from base (pred, args, fact). Supports are sorted; a given atom's own come with the others.

    Rounds carry first supports only, which don't change once an atom is known; one pass over the finished closure then finds all supports."""
    own = checkpointed(base.select("pred", "args", F.array("fact").alias("support")).distinct())
    known = checkpointed(own.groupBy("pred", "args").agg(F.min("support").alias("first")))
    for group in strata(rules):
        new = None
        while (made := _heads(group, known, new)) is not None:
            new = checkpointed(made.join(known, ["pred", "args"], "left_anti").groupBy("pred", "args").agg(F.min("support").alias("first")))
            if not new.head(1):
                break
            known = checkpointed(known.unionByName(new))
    every = _heads(rules, known, None) if rules else None
    every = own if every is None else own.unionByName(every)
    return every.distinct().groupBy("pred", "args").agg(F.array_sort(F.collect_list("support")).alias("supports"))


def problems(goals: DataFrame, supported: DataFrame, facts: DataFrame, rules_of: list[constraints.Constraint] | None = None) -> DataFrame:
    """What predict.predict_goals() takes, one row a goal: goals (goal, pred, args), supported as supports() gives it, facts (fact, pred, args, stmt_type, epi_a, epi_b, alea_a,
    alea_b, pinned[, votes]).

    A goal's conjuncts are its supports without what is no fact; a goal without any rests on the fact of its own name. Facts that share a constraint's group with
    a needed one are needed too, and so on."""
    names = facts.select("fact").distinct()
    one = goals.join(supported, ["pred", "args"], "left").select("goal", F.posexplode_outer("supports").alias("i", "s"))
    part = one.select("goal", "i", F.explode("s").alias("fact")).join(names, "fact", "left_semi").groupBy("goal", "i").agg(F.array_sort(F.collect_set("fact")).alias("conjunct"))
    dnf = part.groupBy("goal").agg(F.array_sort(F.collect_set("conjunct")).alias("dnf"))
    dnf = goals.select("goal").join(dnf, "goal", "left").withColumn("dnf", F.coalesce("dnf", F.array(F.array("goal"))))
    needed = dnf.select("goal", F.explode(F.flatten("dnf")).alias("fact")).distinct()
    exclusive = needed.limit(0).select("goal", F.array("fact").alias("members"))
    if rules_of:
        member = checkpointed(constraints.groups(facts.select("fact", "pred", "args"), rules_of).select(F.concat_ws("\u0001", "constraint", "group_key").alias("group"), "fact").distinct())
        of = connected_components(member.select(F.concat(F.lit("g"), "group").alias("a"), F.concat(F.lit("f"), "fact").alias("b")))
        fact_of = of.where(F.col("node").startswith("f")).select(F.expr("substring(node, 2)").alias("fact"), "component")
        meets = needed.join(fact_of, "fact").select("goal", "component").distinct()
        needed = needed.unionByName(meets.join(fact_of, "component").select("goal", "fact")).distinct()
        grouped = member.groupBy("group").agg(F.array_sort(F.collect_set("fact")).alias("members"))
        group_of = of.where(F.col("node").startswith("g")).select(F.expr("substring(node, 2)").alias("group"), "component")
        exclusive = meets.join(group_of, "component").join(grouped, "group").select("goal", "members")
    states = [c for c in ("stmt_type", "epi_a", "epi_b", "alea_a", "alea_b", "pinned", "votes") if c in facts.columns]
    own = needed.join(facts.select("fact", *states), "fact").groupBy("goal").agg(F.array_sort(F.collect_list(F.struct("fact", *states))).alias("facts"))
    groups = exclusive.groupBy("goal").agg(F.array_sort(F.collect_list("members")).alias("exclusive"))
    kind = own.schema["facts"].dataType.simpleString()
    empty = F.expr(f"from_json('[]', '{kind}')") if "votes" not in states else F.slice("facts", 1, 0)
    out = dnf.join(own, "goal", "left").join(groups, "goal", "left")
    return out.select("goal", "dnf", F.coalesce("facts", empty).alias("facts"), F.coalesce("exclusive", F.expr("cast(array() as array<array<string>>)")).alias("exclusive"))


def calibrated(predicted: DataFrame, knots: DataFrame | None) -> DataFrame:
    """p and its interval through the isotonic map with these knots (x, y); without any, as they are."""
    if knots is None:
        return predicted
    out, knots = predicted, checkpointed(knots.select("x", "y"))  # read three times
    for c in ("p", "ci_lo", "ci_hi"):
        out = calibration.isotonic_apply(out, knots, c).withColumn(c, F.coalesce("calibrated", c)).drop("calibrated")
    return out.select(*predicted.columns)


def predict_all(goals: DataFrame, base: DataFrame, rules: list[Rule], facts: DataFrame, rules_of: list[constraints.Constraint] | None = None, knots: DataFrame | None = None, samples: int = predict.SAMPLES) -> DataFrame:
    """From goals to calibrated predictions, one row a goal."""
    asked = problems(goals, supports(base, rules), facts, rules_of)
    return calibrated(predict.predict_goals(asked, samples), knots)


def snapshot_id(head: str, calibration_hash: str, alpha: float | None = None) -> str:
    """Which state a prediction rests on, as text: log head, engine and calibration map. Categorical predictions add their concentration to the engine."""
    engine = ENGINE if alpha is None else f"{ENGINE}+categorical(alpha={alpha!r})"
    return canon_json({"ledger_head": head, "engine_version": engine, "calib_map_hash": calibration_hash})


def parse_snapshot(text: str) -> dict[str, str]:
    out = json.loads(text)
    if set(out) != {"ledger_head", "engine_version", "calib_map_hash"}:
        raise ValueError("no snapshot")
    return out


def map_hash(knots: DataFrame | None) -> str:
    """Identity of a calibration map; that of none is the hash of no knots. Maps have at most a thousand knots."""
    rows = [] if knots is None else [[r["x"], r["y"]] for r in knots.orderBy("x").collect()]
    return sha256(canon_json(rows).encode()).hexdigest()


def cutoff_of(events: DataFrame, head: str) -> int:
    """The seq up to which events lie before the head of a snapshot; 0 for the empty log."""
    if head == ledger.GENESIS:
        return 0
    row = events.where(F.col("hash") == head).select("seq").head()
    if row is None:
        raise KeyError("the head isn't in this log")
    return row["seq"]


OBSERVED = "fact string, outcome boolean, value string, ctx map<string,string>, confidence double"


def observations(events: DataFrame, payloads: DataFrame, cutoff: int | None = None) -> DataFrame:
    """(seq, actor, fact, outcome, value, ctx, confidence) of what is neither retracted nor redacted, up to cutoff."""
    live = ledger.live(events, payloads, cutoff).where("kind = 'observation' AND payload IS NOT NULL")
    return live.select("seq", "actor", F.from_json("payload", OBSERVED).alias("o")).select("seq", "actor", "o.*").where("fact IS NOT NULL")


def predict_at(events: DataFrame, payloads: DataFrame, snapshot: str, reliability: DataFrame | None = None, knots: DataFrame | None = None, samples: int = predict.SAMPLES) -> DataFrame:
    """predict.RESULT of every fact as of a snapshot: what had been observed then, without what has been retracted or redacted since. knots are used if they are the snapshot's map."""
    at = parse_snapshot(snapshot)
    obs = observations(events, payloads, cutoff_of(events, at["ledger_head"])).where("outcome IS NOT NULL")
    if reliability is None:
        reliability = events.sparkSession.createDataFrame([], "actor string, reliability double")
    composed = tallies.compose(tallies.fact_counts(obs), reliability)
    own = knots if knots is not None and map_hash(knots) == at["calib_map_hash"] else None
    return calibrated(predict.predict_frequency(composed, samples), own)


def file_conjectures(found: DataFrame, predicted: DataFrame, claims: DataFrame, first_seq: int) -> DataFrame:
    """Claims of conjectures (pred, args, via, sim): those without an open claim on the same statement, each with the probability that its analog has earned.

    predicted: (pred, args, p, ci_lo, ci_hi) of analogs; one without a scalar prediction transfers nothing. claims: (pred, args, predictor_class, resolved). The most similar analog
    files, ties by name. Claims are numbered from first_seq in order of statement."""
    best = found.groupBy("pred", "args").agg(F.max_by("via", F.struct("sim", "via")).alias("via"), F.max("sim").alias("sim"))
    open_ = claims.where((F.col("predictor_class") == CONJECTURE) & ~F.col("resolved")).select("pred", "args").distinct()
    new = best.join(open_, ["pred", "args"], "left_anti").join(predicted.select(F.col("pred").alias("via"), "args", F.col("p").alias("predicted_p"), "ci_lo", "ci_hi"), ["via", "args"])
    numbered = new.select("pred", "args", "via", "sim", "predicted_p", "ci_lo", "ci_hi", F.lit(CONJECTURE).alias("predictor_class"), F.lit("observation_pending").alias("settlement"), F.concat(F.lit("conjecture:"), "via").alias("criterion"))
    named = F.sha2(F.to_json(F.struct("pred", "args")).cast("binary"), 256)
    return numbered.withColumn("claim", F.concat(F.lit(f"claim:{first_seq}:"), F.substring(named, 1, 16)))


def caveat_of(predicted: DataFrame) -> DataFrame:
    """(goal, caveat): goals all of whose worlds broke a constraint."""
    return predicted.where("tension").select("goal", F.lit("constraint_tension").alias("caveat"))


def under_specified(obs: DataFrame, guards: DataFrame) -> DataFrame:
    """(fact, caveat): categorical facts with recorded context that no admitted condition (fact, key) breaks down."""
    keys = obs.where("value IS NOT NULL").select("fact", F.explode(F.map_keys("ctx")).alias("key")).where(~F.col("key").startswith("derived:")).distinct()
    met = keys.join(guards.select("fact", "key").distinct(), ["fact", "key"], "left_semi").select("fact").distinct()
    return keys.select("fact").distinct().join(met, "fact", "left_anti").withColumn("caveat", F.lit("under_specified"))


def empty_claims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "pred string, args array<string>, predictor_class string, resolved boolean")
