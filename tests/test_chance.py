"""The probability of a disjunction of any size, against all assignments of its facts."""

import itertools
import random

import numpy as np
import pytest

from attesta.operators import predict


def brute(dnf, p, n):
    facts = sorted({f for c in dnf for f in c})
    out = np.zeros(n)
    for bits in itertools.product((False, True), repeat=len(facts)):
        on = {f for f, b in zip(facts, bits, strict=True) if b}
        if any(set(c) <= on for c in dnf):
            out += np.prod([p.get(f, np.zeros(n)) if f in on else 1 - p.get(f, np.zeros(n)) for f in facts], 0)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_mass_is_exact_for_any_number_of_conjuncts(seed, monkeypatch):
    r = random.Random(seed)
    facts = [f"f{i}" for i in range(10)]
    dnf = [r.sample(facts, r.randint(1, 4) if seed % 3 else 2) for _ in range(r.choice((1, 5, 13, 25)))]
    n = 7
    p = {f: np.array([r.random() for _ in range(n)]) for f in facts if r.random() < 0.9}
    monkeypatch.setattr(predict, "BLOCK", r.choice((1, 40, 1 << 20)))
    assert np.allclose(predict.mass(dnf, p, n), brute(dnf, p, n), atol=1e-12)
    slope = {f: np.zeros(n) for f in facts}
    for at, part in predict.Chance(dnf).slopes(p, n):
        for f, x in part.items():
            slope[f][at] = x
    for f in facts:
        assert np.allclose(slope[f], brute(dnf, p | {f: np.ones(n)}, n) - brute(dnf, p | {f: np.zeros(n)}, n), atol=1e-12)


def test_all_of_many_conjuncts_count():
    p = {f"f{i}": np.full(3, 0.01) for i in range(3000)} | {"n": np.full(3, 0.5)}
    assert np.allclose(predict.mass([[f"f{i}"] for i in range(40)], p, 3), 1 - 0.99**40)
    assert np.allclose(predict.mass([["n", f"f{i}"] for i in range(3000)], p, 3), 0.5 * (1 - 0.99**3000))
    chain = predict.mass([[f"f{i}", f"f{i + 1}"] for i in range(300)], {f: np.full(3, 0.9) for f in p}, 3)
    assert np.allclose(chain, 1)


def test_solve_of_many_conjuncts():
    rate = {"stmt_type": "frequency", "epi": (1e9, 1.0), "alea": (2.0, 98.0), "pinned": False, "votes": ()}
    facts = {f"f{i}": rate for i in range(60)}
    out = predict.solve([[f] for f in facts], facts, samples=64)
    assert abs(out["p"] - (1 - 0.98**60)) < 0.02 and len(out["sensitivity"]) == 60  # 0.70; the twelve likeliest alone give no more than 0.6


def test_spread_is_kept_where_rows_lie_by_the_key(spark):
    from pyspark.sql import functions as F

    from attesta.sources.shared import spread

    by = spark.range(100).groupBy((F.col("id") % 20).alias("k")).agg(F.count("*").alias("n"))
    parts = spread(by, "k").mapInArrow(lambda batches: (b for b in batches), "k long, n long").select(F.spark_partition_id().alias("i")).distinct().count()
    assert parts == 4
