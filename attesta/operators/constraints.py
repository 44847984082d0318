"""Integrity constraints over atoms (pred, args, and any id columns): mutual exclusion and functional dependency.

A constraint is (name, kind, body): mutex {pred, exclusive_values?, value_position?}, functional {pred, key_positions?}. Each gives matching atoms a group key; two atoms
of one group are a violation, found by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Constraint = tuple[str, str, dict]


def _key(kind: str, body: dict) -> tuple[Column, Column]:
    """(matches, group key)."""
    args, n = F.col("args"), F.size("args")
    fits = F.col("pred") == body["pred"]
    if kind == "mutex":
        at = F.lit(int(body["value_position"])) if "value_position" in body else n - 1
        if body.get("exclusive_values") is not None:
            fits = fits & (at < n) & F.get(args, at).isin([str(v) for v in body["exclusive_values"]])
        return fits, F.transform(F.filter(F.arrays_zip(args.alias("a"), F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))).alias("i")), lambda s: s["i"] != at), lambda s: s["a"])
    if kind != "functional":
        raise ValueError(f"unknown constraint kind {kind!r}")
    at = body.get("key_positions")
    return fits, F.filter(F.array(*[F.get(args, F.lit(int(i))) for i in at]), lambda x: x.isNotNull()) if at else F.slice(args, 1, F.greatest(n - 1, F.lit(0)))


def groups(atoms: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """atoms with constraint and group_key, one row for each constraint that an atom falls under."""
    found = F.filter(F.array(*[F.when(fits, F.struct(F.lit(name).alias("constraint"), F.to_json(key).alias("group_key"))) for name, kind, body in constraints for fits, key in [_key(kind, body)]]), lambda s: s.isNotNull())
    return atoms.withColumn("_g", F.explode(found)).select(*atoms.columns, "_g.constraint", "_g.group_key")


def violations(atoms: DataFrame, constraints: list[Constraint]) -> DataFrame:
    return groups(atoms.select("pred", "args").distinct(), constraints).groupBy("constraint", "group_key").agg(F.count("*").alias("members")).where("members > 1")


def without_certain_conflicts(closed: DataFrame, certain: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """closed without the atoms that share a group with a certain atom but aren't certain themselves."""
    if not constraints:
        return closed
    taken = groups(certain.select("pred", "args").distinct(), constraints).select("constraint", "group_key").distinct()
    bad = groups(closed.select("pred", "args"), constraints).join(taken, ["constraint", "group_key"], "left_semi").select("pred", "args").distinct().join(certain.select("pred", "args"), ["pred", "args"], "left_anti")
    return closed.join(bad, ["pred", "args"], "left_anti")
