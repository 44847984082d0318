"""Named queries do the whole job: full sample sizes, all rows."""

import inspect

import pytest

from attesta.operators import calibration, predict
from attesta.plans import catalogue
from attesta.sources import adapters, ledger


@pytest.mark.parametrize(("name", "module", "argument", "value"), [
    ("predict_frequency", predict, "samples", 512), ("predict_crisp", predict, "samples", 512), ("predict_goals", predict, "samples", 512), ("paired_bootstrap", calibration, "draws", 10_000),
])
def test_sampled_at_full_size(spark, sf, monkeypatch, name, module, argument, value):
    f, seen = getattr(module, name), []

    def call(*args, **more):
        bound = inspect.signature(f).bind(*args, **more)
        bound.apply_defaults()
        seen.append(bound.arguments[argument])
        return f(*args, **more)

    monkeypatch.setattr(module, name, call)
    catalogue.QUERIES[name](spark, sf)
    assert seen == [value]


def test_chain_over_all_events(spark, sf):
    e = adapters.from_events(spark, sf).orderBy("seq").collect()
    want = ledger.chained([(r.ts_ms, "observation", r.actor, {"fact": r.fact, "outcome": r.outcome, "value": r.value}, None, None) for r in e])[0]
    assert sorted(map(tuple, catalogue.QUERIES["event_chain_hash"](spark, sf).collect())) == [(r[0], r[8]) for r in want]


def test_aliases_of_all_suppliers_and_nations(spark, sf):
    names = {r[0] for t, c in (("supplier", "s_name"), ("nation", "concat('n', n_nationkey)")) for r in spark.read.parquet(f"{sf}/{t}.parquet").selectExpr(c).collect()}
    assert names <= {r.symbol for r in catalogue.QUERIES["alias_component"](spark, sf).collect()}
