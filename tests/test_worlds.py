"""Planted worlds: what the operators must find, and what they must leave alone."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import calibration, constraints, datalog, gate, retrieval, series, sweep, tallies, trust
from attesta.sources import evidence, ledger
from attesta.streaming import fold

OBS = "seq long, ts_ms long, fact string, actor string, outcome boolean, value string, confidence double, ctx map<string,string>"


def world(spark, facts):
    """facts: {name: (n, probability by (i, context), context by (rng, i))}."""
    rows, r, seq = [], random.Random(11), 0
    for name, (n, p, ctx) in facts.items():
        for i in range(n):
            c = ctx(r, i)
            seq += 1
            rows.append((seq, 1_700_000_000_000 + seq * 100_003_000, name, "agent:a", r.random() < p(i, c), None, None, c))
    return spark.createDataFrame(rows, OBS)


def test_sweep_tells_conditions_from_dates(spark):
    noise = lambda r, i: {"n1": str(r.randrange(3)), "n2": str(r.randrange(2))}
    o = world(spark, {
        "depends": (240, lambda i, c: 0.92 if c["m"] == "a" else 0.2, lambda r, i: {"m": r.choice("ab"), "n1": str(r.randrange(3))}),
        "step": (160, lambda i, c: 0.95 if i < 80 else 0.08, noise),
        **{f"calm{k}": (240, lambda i, c: 0.5, noise) for k in range(5)},
        "thin": (10, lambda i, c: 0.5, noise),
        "hidden": (240, lambda i, c: 0.9 if i // 20 % 2 else 0.1, noise),
    })
    out = {r["fact"]: r for r in sweep.sweep(o).collect()}
    assert (out["depends"]["verdict"], out["depends"]["key"], out["depends"]["best"]) == ("guard", "m", "a") and out["depends"]["hits"] > 3 * out["depends"]["misses"]
    assert out["step"]["verdict"] == "supersede" and abs(out["step"]["cut_seq"] - (240 + 80)) <= 4
    assert sum(out[f"calm{k}"]["verdict"] != "none" for k in range(5)) <= 1 and out["thin"]["verdict"] == "none"
    assert out["hidden"]["flagged"]
    again = sweep.sweep(o, o.select("fact").where("fact = 'step'"))
    assert [r["fact"] for r in again.collect()] == ["step"]


def test_sweep_of_a_categorical_fact(spark):
    r, rows = random.Random(5), []
    for i in range(240):
        m = r.choice("ab")
        v = r.choices(["captcha", "block", "ok"], [8, 1, 1] if m == "a" else [1, 1, 8])[0]
        rows.append((i, i * 3_700_000, "site", "agent:a", None, v, None, {"m": m}))
    out = sweep.sweep_categorical(spark.createDataFrame(rows, OBS)).collect()
    assert len(out) == 1 and out[0]["key"] == "m" and gate.guard_decisions(spark.createDataFrame(out)).first()["status"] == "admitted"


def test_order_does_not_matter_for_tallies(spark):
    o = world(spark, {"f": (60, lambda i, c: 0.5, lambda r, i: {"k": str(i % 3)} if i % 2 else {})})
    a = sorted(map(tuple, tallies.context_breakdown(o).collect()))
    assert a == sorted(map(tuple, tallies.context_breakdown(o.orderBy(F.rand(1))).collect()))
    assert sum(r[3] for r in a) == 60 and ("f", "k", tallies.RESIDUAL, 30) in {t[:4] for t in a}


def test_open_vocabulary(spark):
    c = spark.createDataFrame([("f", "a", "captcha", 8), ("f", "a", "block", 2)], "fact string, actor string, value string, n long")
    p = {r["value"]: r["p"] for r in tallies.open_vocabulary(c).collect()}
    assert p == pytest.approx({"captcha": 8 / 11, "block": 2 / 11, None: 1 / 11})
    w = spark.createDataFrame([("a", "block", 0.5)], "actor string, value string, weight double")
    assert {r["value"]: r["p"] for r in tallies.open_vocabulary(c, weights=w).collect()}["block"] == pytest.approx(1 / 10)


def test_frozen_facts_and_proposers(spark):
    o = world(spark, {"f": (5, lambda i, c: 1.0, lambda r, i: {}), "g": (5, lambda i, c: 1.0, lambda r, i: {})})
    admitted = spark.createDataFrame([("h", "human:p"), ("f", "agent:a")], "fact string, proposer string")
    got = {(r["fact"], r["actor"]): (r["n"], r["k"]) for r in tallies.fact_counts(o, frozen=spark.createDataFrame([("g",)], "fact string"), admitted=admitted).collect()}
    assert got == {("f", "agent:a"): (5, 5), ("h", "human:p"): (0, 0)}


def test_trust_learns_who_is_right(spark):
    r, rep, settled = random.Random(3), [], []
    for c in range(200):
        truth = r.random() < 0.5
        for k, (yes, false) in enumerate(((0.95, 0.05), (1, 1), (0.5, 0.02))):
            rep.append((c * 10 + k, f"c{c}", f"v:{k}", r.random() < (yes if truth else false), 0, None))
        settled.append((c * 10 + 5, f"c{c}", truth, None))
        rep.append((c * 10 + 7, f"c{c}", "v:0", not truth, 0, None))  # after the settlement: doesn't count
    reports = spark.createDataFrame(rep, "seq long, fact string, actor string, outcome boolean, grade int, value string")
    votes = trust.scored(reports, spark.createDataFrame(settled, "seq long, fact string, outcome boolean, value string"))
    lr = {x["actor"]: x for x in trust.rates(trust.confusion(votes)).collect()}
    assert lr["v:1"]["lr_yes"] < 0.3 and lr["v:2"]["lr_yes"] > 2 and lr["v:0"]["lr_no"] < -1.5
    assert {x["actor"]: x["tp"] + x["fn"] + x["fp"] + x["tn"] for x in lr.values()} == {f"v:{k}": 200 for k in range(3)}


def test_calibration(spark):
    c = spark.createDataFrame([(i / 100, i % 100 >= 50) for i in range(100)] * 3, "p double, outcome boolean")
    knots = calibration.isotonic_fit(c)
    ys = [r["y"] for r in knots.orderBy("x").collect()]
    assert ys == sorted(ys) and ys[0] == 0 and ys[-1] == 1
    out = calibration.isotonic_apply(spark.createDataFrame([(-0.5,), (0.25,), (2.0,)], "p double"), knots).collect()
    assert [r["calibrated"] for r in out] == [0.0, 0.0, 1.0]
    b = calibration.paired_bootstrap(c.select(F.lit(1.0).alias("a"), F.lit(0.25).alias("b"), F.monotonically_increasing_id().alias("key")), draws=200).first()
    assert b["delta"] == pytest.approx(0.75) and b["lo"] == pytest.approx(0.75) and b["hi"] == pytest.approx(0.75)


def test_changepoint_nulls(spark):
    r = random.Random(2)
    rows = [(f"p{k}", i, r.random() < 0.5) for k in range(40) for i in range(120)]
    found = series.changepoints(spark.createDataFrame(rows, "fact string, seq long, hit boolean"), ["fact"])
    assert found.where("detected").count() <= 2
    assert series.cusum(spark.createDataFrame([("a", i, i >= 60) for i in range(120)], "fact string, seq long, hit boolean")).first()["alarm"] is not None


L, R = datalog.Literal, datalog.Rule
REACH = [R("base", L("reach", ("?x", "?y")), (L("link", ("?x", "?y")),)), R("step", L("reach", ("?x", "?z")), (L("link", ("?x", "?y")), L("reach", ("?y", "?z"))))]


def test_rules_proofs_and_checks(spark):
    given = [("link", ("a", "b")), ("link", ("b", "c")), ("link", ("c", "a")), ("node", ("d",)), ("node", ("a",))]
    rules = [*REACH, R("alone", L("alone", ("?x",)), (L("node", ("?x",)), L("reach", ("?x", "?x"), True)))]
    closed = {(r["pred"], tuple(r["args"])) for r in datalog.closure(datalog.atoms_of(spark, [(p, list(a)) for p, a in given]), rules).collect()}
    assert {a for p, a in closed if p == "reach"} == {(x, y) for x in "abc" for y in "abc"} and ("alone", ("d",)) in closed and ("alone", ("a",)) not in closed
    base = set(given)
    s = datalog.prove(("reach", ("a", "c")), base, closed, rules)
    assert s.status == "proved" and datalog.check_proof(s.proof, base, closed, rules)
    assert not datalog.check_proof({"atom": ["reach", ["a", "d"]], "rule": "base", "premises": [{"atom": ["link", ["a", "d"]], "given": True}]}, base, closed, rules)
    lone = datalog.prove(("alone", ("d",)), base, closed, rules)
    assert lone.status == "proved" and datalog.check_proof(lone.proof, base, closed, rules)
    assert datalog.prove(("reach", ("a", "zz")), base, closed, rules).status == "exhausted"
    assert datalog.prove(("reach", ("a", "c")), base, closed, rules, budget=1).status == "truncated"
    blocked = datalog.atoms_of(spark, [("reach", ["a", "c"])])
    assert ("reach", ("a", "c")) not in {(r["pred"], tuple(r["args"])) for r in datalog.closure(datalog.atoms_of(spark, [(p, list(a)) for p, a in given]), REACH, blocked).collect()}
    with pytest.raises(ValueError):
        datalog.strata([R("bad", L("p", ("?x",)), (L("q", ("?x",)), L("p", ("?x",), True)))])


def test_constraints(spark):
    atoms = datalog.atoms_of(spark, [("state", ["m", "on"]), ("state", ["m", "off"]), ("state", ["k", "on"]), ("age", ["x", "1"]), ("age", ["x", "2"])])
    rules = [("c1", "mutex", {"pred": "state"}), ("c2", "functional", {"pred": "age"})]
    assert sorted((r["constraint"], r["members"]) for r in constraints.violations(atoms, rules).collect()) == [("c1", 2), ("c2", 2)]
    left = constraints.without_certain_conflicts(atoms, datalog.atoms_of(spark, [("state", ["m", "on"])]), rules)
    assert ("state", ["m", "off"]) not in [(r["pred"], r["args"]) for r in left.collect()] and left.count() == 4


def test_gate_decides_in_order():
    reg = gate.Registry()
    batch = [
        ("1", "fact", {"pred": "state", "args": ["m", "on"]}), ("2", "symbol", {"pred": "state", "arity": 2}), ("3", "fact", {"pred": "state", "args": ["m", "on"], "kind": "definitional"}),
        ("4", "constraint", {"ctype": "mutex", "body": {"pred": "state"}}), ("5", "fact", {"pred": "state", "args": ["m", "off"]}), ("6", "symbol", {"pred": "state", "arity": 3}), ("7", "poem", {}),
        ("8", "alias", {"canonical": "state", "alias": "mode", "basis": "behavioral", "sim": 0.5}), ("9", "guard", {"head": {"pred": "state"}, "support": {"left": 9, "right": 20}, "mdl": {"dl_guard": 3, "dl_residual_given_guard": 10, "dl_residual": 20}, "holdout": {"hits": 9, "misses": 2}}),
        ("10", "guard", {"head": {"pred": "state"}, "support": {"left": 3, "right": 20}}), ("11", "rule", {"head": {"pred": "x"}, "holdout": {"hits": 1, "misses": 2}}), ("12", "supersede_valid_time", {"fact_id": "?", "valid_to": 1}),
    ]
    out = gate.decide(batch, reg)
    assert [(d["status"], d["failing_step"]) for d in out] == [("rejected", 1), ("admitted", None), ("admitted", None), ("admitted", None), ("rejected", 7), ("rejected", 7), ("rejected", 1), ("rejected", 5), ("admitted", None), ("rejected", 5), ("rejected", 5), ("rejected", 1)]
    assert [k for k, _ in gate.expand("fact", {"pred": "new", "args": [1]}, set())] == ["symbol", "fact"]


def test_demoted_guards_stay_out_until_evidence_turns():
    reg = gate.Registry(demoted=[{"target_fact": "f", "conditioning_key": "m", "value": "a", "hits": 2, "misses": 20}])
    g = {"head": {"pred": "p"}, "target_fact": "f", "conditioning_key": "m", "value": "a", "support": {"left": 9, "right": 9}, "mdl": {"dl_guard": 1, "dl_residual_given_guard": 1, "dl_residual": 9}}
    weak, strong = g | {"post_demotion": {"hits": 9, "misses": 1}}, g | {"post_demotion": {"hits": 60, "misses": 2}}
    assert [d["status"] for d in gate.decide([("1", "guard", weak), ("2", "guard", strong)], reg)] == ["rejected", "admitted"]


def test_ledger(spark, tmp_path):
    log = ledger.Ledger(spark, f"file://{tmp_path}/log")
    assert log.head() == (0, ledger.GENESIS)
    log.append([(i, "observation", f"agent:{i % 2}", {"i": i, "text": 'a"/é\n'}, None, "s") for i in range(20)])
    log.append([(30, "retraction", "human:x", {"actor": "agent:1"}, "src", None)])
    events, payloads = log.events(), log.payloads()
    assert ledger.verify_links(events).count() == 0
    bad = events.withColumn("ts", F.when(F.col("seq") == 7, 99).otherwise(F.col("ts")))
    assert [r["seq"] for r in ledger.verify_links(bad).collect()] == [7] and ledger.longest_valid(bad).count() == 6
    assert ledger.verify_links(events.where("seq <> 5")).count() == 1
    seen = ledger.live(events, payloads)
    assert seen.where("payload IS NULL").count() == 10 and ledger.live(events, payloads, cutoff=4).count() == 4
    log.append([(31, "retraction", "human:x", {"actor": "agent:1", "restored": True}, None, None)])
    assert ledger.live(log.events(), log.payloads()).where("payload IS NULL").count() == 0
    log.delete_payload(events.where("seq = 3").first()["payload_hash"])
    assert ledger.live(log.events(), log.payloads()).where("payload IS NULL").count() == 1
    with pytest.raises(ValueError):
        log.delete_payload("../x")
    with pytest.raises(ValueError):
        log.append([(1, "poem", "a", {}, None, None)])
    assert ledger.events_since(log.events(), 20, ["retraction"]).count() == 2
    head = log.checkpoint("counts", events.groupBy("actor").count())
    assert log.restore("counts", head, "actor string, count long").count() == 3
    t = {"events": (log.events(), ["seq"])}
    assert ledger.closure_hash(t) == ledger.closure_hash({"events": (log.events().orderBy(F.rand(2)), ["seq"])}) != ledger.closure_hash({"events": (events, ["seq"])})


def test_retrieval(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("@salience: 2.0\n@topic: gpu\n\nThe host gpu-01.lab runs ollama on port 11434.\n\nNothing of note here.")
    (tmp_path / "notes" / "b.md").write_text("A host is a host.\n\nGardens need water and sun.")
    corpus = evidence.entries(evidence.files(spark, f"file://{tmp_path}/notes"))
    rows = {r["entry"]: r for r in corpus.collect()}
    assert rows["a#1"]["offset"] == len("@salience: 2.0\n@topic: gpu\n\n") and rows["a#1"]["salience"] == 2.0 and rows["b#0"]["salience"] is None
    q = spark.createDataFrame([(1, "ollama gpu host"), (2, "zebra")], "query int, text string")
    out = retrieval.recall(q, corpus, budget=100).orderBy("rank").collect()
    assert {"a#0", "a#1"} == {r["entry"] for r in out[:2]} and all(r["query"] == 1 for r in out)
    assert retrieval.recall(q, corpus, budget=5).count() <= 1
    toks = spark.createDataFrame([("Gpu-01.lab x_y a.b",)], "t string").select(retrieval.tokens(F.col("t")).alias("x")).first()["x"]
    assert toks == ["gpu-01.lab", "gpu", "01", "lab", "x_y", "a.b"] or toks == ["gpu-01.lab", "gpu", "01", "lab", "x", "y", "a.b"]
    new, gone = evidence.census(evidence.files(spark, f"file://{tmp_path}/notes").where("file = 'a'"), evidence.files(spark, f"file://{tmp_path}/notes"))
    assert [r["file"] for r in new.collect()] == ["b"] and gone.count() == 0


def test_streams_equal_batches(spark, tmp_path):
    o = world(spark, {f"f{k}": (30, lambda i, c: 0.6, lambda r, i: {"m": r.choice("ab")}) for k in range(4)})
    for k in range(3):
        o.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = fold.read(spark, f"file://{tmp_path}/in", files=1)
    q = fold.running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, tallies.fact_counts(o).select("fact", "actor", "n", "k").collect()))
    assert sorted(map(tuple, spark.table("counts").select("fact", "actor", "n", "k").collect())) == want
    q = fold.fold_and_sweep(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/c2", sweep.sweep, f"file://{tmp_path}/out")
    q.awaitTermination()
    last = spark.read.parquet(f"file://{tmp_path}/out").where("batch = 2").drop("batch")
    assert sorted(map(str, last.collect())) == sorted(map(str, sweep.sweep(o).collect()))
    o.where(F.col("seq") % 3 == 1).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")  # nothing new
    fold.fold_and_sweep(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/c2", sweep.sweep, f"file://{tmp_path}/out").awaitTermination()
    assert {r["batch"] for r in spark.read.parquet(f"file://{tmp_path}/log").select("batch").distinct().collect()} == {0, 1, 2, 3}
    assert {r["batch"] for r in spark.read.parquet(f"file://{tmp_path}/out").select("batch").distinct().collect()} == {0, 1, 2}
    d = fold.daily_quota(fold.read(spark, f"file://{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("quota").option("checkpointLocation", f"file://{tmp_path}/c3").trigger(availableNow=True).start()
    d.awaitTermination()
    assert spark.table("quota").agg(F.sum("used")).first()[0] == 160
    assert fold.over_quota(o, most=0).count() > 0


def test_checks_as_code(spark):
    from attesta.operators import verifier

    good = "def even(x):\n    return x % 2 == 0"
    assert verifier.check(good, "even", [([2], True), ([3], False)]) is None
    assert "gives" in verifier.check(good, "even", [([2], False)])
    assert verifier.check(good, "even", []) and verifier.check("def f(:", "f", [([], 1)])
    for bad in ("import os\ndef f(): return 1", "def f(): return ().__class__", "def f(): return open('x')", "def f():\n  while True: pass"):
        assert verifier.check(bad, "f", [([], 1)])
    df = spark.range(4).select(verifier.as_udf(good, "even", [([2], True)], "boolean")(F.col("id")).alias("e"))
    assert [r["e"] for r in df.collect()] == [True, False, True, False]
    reg = gate.Registry()
    out = gate.decide([("1", "verifier", {"code": good, "entry": "even", "vectors": [[[4], True]]}), ("2", "verifier", {"code": good, "entry": "even", "vectors": [[[4], False]]})], reg)
    assert [(d["status"], d["failing_step"]) for d in out] == [("admitted", None), ("rejected", 3)]
