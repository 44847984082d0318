"""Supports, problems, predictions at a snapshot, the log's rules, restoring; against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions import expressions as X
from attesta.operators import assemble, datalog, predict, retrieval, tallies
from attesta.sources import evidence, ledger, state

L, R = datalog.Literal, datalog.Rule


def brute_supports(base, rules):
    """Rounds over all bindings; the first support of an atom is the smallest of the round that made it."""
    own, first = {}, {}
    for p, a, f in base:
        own.setdefault((p, a), set()).add((f,))
    first = {k: min(v) for k, v in own.items()}

    def fire():
        for r in rules:
            for atoms in itertools.product(sorted(first), repeat=len(r.body)):
                b = {}
                for lit, (p, a) in zip(r.body, atoms, strict=True):
                    b = datalog._bind(lit.args, a, b) if b is not None and p == lit.pred else None
                if b is not None:
                    yield (r.head.pred, tuple(b.get(t, t) for t in r.head.args)), tuple(sorted({r.name, *(x for k in atoms for x in first[k])}))

    while True:
        made = {}
        for atom, s in fire():
            if atom not in first:
                made[atom] = min(made.get(atom, s), s)
        if not made:
            break
        first |= made
    for atom, s in fire():
        own.setdefault(atom, set()).add(s)
    return {k: sorted(v) for k, v in own.items()}


def test_supports(spark):
    base = [("e", ("a", "b"), "f1"), ("e", ("b", "c"), "f2"), ("e", ("a", "c"), "f3"), ("e", ("c", "a"), "f4"), ("e", ("a", "b"), "f5"), ("p", ("a", "c"), "f6")]
    rules = [R("r1", L("p", ("?x", "?y")), (L("e", ("?x", "?y")),)), R("r2", L("p", ("?x", "?z")), (L("p", ("?x", "?y")), L("e", ("?y", "?z")))), R("r3", L("q", ("?x",)), (L("e", ("?x", "?y")), L("p", ("?z", "a"))))]
    df = spark.createDataFrame([(p, list(a), f) for p, a, f in base], "pred string, args array<string>, fact string")
    got = {(r.pred, tuple(r.args)): [tuple(s) for s in r.supports] for r in assemble.supports(df, rules).collect()}
    assert got == brute_supports(base, rules)
    assert {(r.pred, tuple(r.args)) for r in datalog.closure(df, rules).collect()} == set(got)
    assert assemble.supports(df.limit(0), rules).count() == 0


def test_literals_without_shared_variables(spark):
    atoms = datalog.atoms_of(spark, [("a", ["1"]), ("a", ["2"]), ("b", ["x", "y"]), ("b", ["x", "z"])])
    rules = [R("some", L("c", ("?x",)), (L("a", ("?x",)), L("b", ("?u", "?v")))), R("pair", L("d", ("?x", "?u")), (L("a", ("?x",)), L("b", ("?u", "?v")))), R("none", L("g", ("?x",)), (L("a", ("?x",)), L("h", ("?u",))))]
    got = {(r.pred, *r.args) for r in datalog.closure(atoms, rules).where("pred NOT IN ('a', 'b')").collect()}
    assert got == {("c", "1"), ("c", "2"), ("d", "1", "x"), ("d", "2", "x")}


def test_cut_off_closure_says_so(spark):
    chain = datalog.atoms_of(spark, [("e", [str(i), str(i + 1)]) for i in range(6)])
    rules = [R("a", L("r", ("?x", "?y")), (L("e", ("?x", "?y")),)), R("b", L("r", ("?x", "?z")), (L("r", ("?x", "?y")), L("e", ("?y", "?z"))))]
    goals = datalog.atoms_of(spark, [("r", ["0", "1"]), ("r", ["0", "6"]), ("r", ["6", "0"])])
    known, whole = datalog.closure_within(chain, rules, rounds=2)
    assert not whole and [r.status for r in datalog.derive(goals, known, whole).orderBy("args").collect()] == ["proved", "truncated", "truncated"]
    known, whole = datalog.closure_within(chain, rules)
    assert whole and [r.status for r in datalog.derive(goals, known, whole).orderBy("args").collect()] == ["proved", "proved", "refuted"]


FACTS = [(f"f{i}", "p" if i < 4 else "q", [str(i % 2), str(i)], "frequency" if i % 2 else "crisp", 3.0 + i, 1.0, 2.0, 1.0 + i, i == 5) for i in range(8)]
FACT = "fact string, pred string, args array<string>, stmt_type string, epi_a double, epi_b double, alea_a double, alea_b double, pinned boolean"


def test_problems_and_predictions(spark):
    facts = spark.createDataFrame(FACTS, FACT)
    base = facts.select("pred", "args", "fact")
    rules = [R("r1", L("g", ("?x",)), (L("p", ("?x", "?y")),)), R("r2", L("h", ("?x",)), (L("g", ("?x",)), L("q", ("?x", "?y"))))]
    goals = spark.createDataFrame([("G0", "g", ["0"]), ("H1", "h", ["1"]), ("f3", "z", ["9"]), ("unknown", "z", ["8"])], "goal string, pred string, args array<string>")
    mutex = [("one", "mutex", {"pred": "p"})]
    got = {r.goal: r for r in assemble.problems(goals, assemble.supports(base, rules), facts, mutex).collect()}
    assert {g: sorted(map(sorted, r.dnf)) for g, r in got.items()} == {"G0": [["f0"], ["f2"]], "H1": [["f1", "f5"], ["f1", "f7"]], "f3": [["f3"]], "unknown": [["unknown"]]}
    assert {g: [f.fact for f in r.facts] for g, r in got.items()} == {"G0": ["f0", "f2"], "H1": ["f1", "f3", "f5", "f7"], "f3": ["f1", "f3"], "unknown": []}
    assert {g: [list(x) for x in r.exclusive] for g, r in got.items()} == {"G0": [["f0", "f2"]], "H1": [["f1", "f3"]], "f3": [["f1", "f3"]], "unknown": []}
    knots = spark.createDataFrame([(0.0, 0.2), (1.0, 0.6)], "x double, y double")
    out = {r.goal: r for r in assemble.predict_all(goals, base, rules, facts, mutex, knots, samples=64).collect()}
    by = {f[0]: {"stmt_type": f[3], "epi": f[4:6], "alea": f[6:8], "pinned": f[8]} for f in FACTS}
    for g, r in got.items():
        want = predict.solve([list(c) for c in r.dnf], {f.fact: by[f.fact] for f in r.facts}, [list(x) for x in r.exclusive], samples=64)
        for k in ("p", "ci_lo", "ci_hi"):
            assert abs(out[g][k] - (0.2 + 0.4 * want[k])) < 1e-9
        assert out[g].sensitivity == want["sensitivity"] and out[g].mpe == want["mpe"]
    tense = predict.predict_goals(spark.createDataFrame([("t", [["a"]], [("a", "crisp", 1e9, 1.0, 1.0, 1.0, False), ("b", "crisp", 1e9, 1.0, 1.0, 1.0, False)], [["a", "b"]])], "goal string, dnf array<array<string>>, facts array<struct<fact:string,stmt_type:string,epi_a:double,epi_b:double,alea_a:double,alea_b:double,pinned:boolean>>, exclusive array<array<string>>"))
    assert [(r.goal, r.caveat) for r in assemble.caveat_of(tense).collect()] == [("t", "constraint_tension")]


def test_frequency_predictions_equal_solving_each(spark):
    r = random.Random(1)
    rows = [(f"f{i}", r.random() * 3, r.random(), float(r.randint(0, 50)), 0.0) for i in range(300)]
    rows = [(f, a, b, n, float(r.randint(0, int(n)))) for f, a, b, n, _ in rows]
    out = {x.goal: x for x in predict.predict_frequency(spark.createDataFrame(rows, "fact string, epi_a double, epi_b double, alea_n double, alea_k double"), 64).collect()}
    for f, a, b, n, k in rows:
        want = predict.solve([[f]], {f: {"stmt_type": "frequency", "epi": (99 + a, 1 + b), "alea": (1 + k, 1 + n - k)}}, samples=64)
        for c in ("p", "ci_lo", "ci_hi", "epistemic", "aleatoric"):
            assert abs(out[f][c] - want[c]) < 1e-9, (f, c)
        assert out[f].mpe == want["mpe"] and abs(out[f].sensitivity[f] - want["sensitivity"][f]) < 1e-9


def test_votes_reach_problems(spark):
    votes = "array<struct<actor:string,vote:boolean,sig:string,count:long,log_lr:double,tp:long,fn:long,fp:long,tn:long>>"
    own = [("x", True, None, 3, None, 20, 1, 2, 18), ("y", False, "s", 2, -0.5, 5, 5, 5, 5)]
    p = spark.createDataFrame([("g", [["a"]], [("a", "crisp", 1.0, 1.0, 1.0, 1.0, False, own)], [])], f"goal string, dnf array<array<string>>, facts array<struct<fact:string,stmt_type:string,epi_a:double,epi_b:double,alea_a:double,alea_b:double,pinned:boolean,votes:{votes}>>, exclusive array<array<string>>")
    keys = ("actor", "vote", "sig", "count", "log_lr", "tp", "fn", "fp", "tn")
    vs = [dict(zip(keys, v, strict=True)) for v in own]
    want = predict.solve([["a"]], {"a": {"stmt_type": "crisp", "epi": (1, 1), "alea": (1, 1), "votes": vs}}, confusion={v["actor"]: (v["tp"], v["fn"], v["fp"], v["tn"]) for v in vs})
    assert abs(predict.predict_goals(p).first().p - want["p"]) < 1e-12


def test_rules_of_the_log(spark, tmp_path):
    log = ledger.Ledger(spark, f"file://{tmp_path}/log")
    s = state.State(log, per_day=2)
    a = s.observe("likes", [" x ", "y"], "agent:a", 5, outcome=True, ctx={"k": "v"})
    s.observe("likes", ["x", "y"], "agent:a", 6, outcome=False)
    with pytest.raises(state.QuotaExceeded):
        s.observe("likes", ["x", "y"], "agent:a", 7, outcome=True)
    s.observe("likes", ["x", "y"], "agent:a", 7 + state.DAY_MS, outcome=True)
    s.set_actor_quota("agent:b", 1)
    s.observe("heat", ["100 C"], "agent:b", 1, value="hot", units={"0": "K"})
    for bad in ({"outcome": True, "value": "x"}, {}, {"outcome": True, "confidence": 2.0}, {"outcome": True, "frame": "other"}):
        with pytest.raises(ValueError):
            s.observe("p", [], "agent:c", 1, **bad)
    for call in (lambda: s.pin("f", "?", "why"), lambda: s.redact("../x"), lambda: s.set_reliability("agent:a", 0, 1), lambda: s.retract_source("nobody", "why"), lambda: s.register_oracle("o", "k", "no", "no"), lambda: s.observe("p", [], "nobody", 1, outcome=True)):
        with pytest.raises(ValueError):
            call()
    before = log.head()
    s.set_authz(lambda who, what: what != "pin")
    with pytest.raises(state.Unauthorized):
        s.pin("f", "-", "why", "agent:z")
    assert s.refused == [("agent:z", "pin")] and log.head() == before
    s.set_authz(None)
    p1, p2 = s.pin("f", "-", "why"), s.pin("g", "+", "why")
    s.supersede(f"pin:{p1}", "better known")
    al = s.alias("likes", "loves")
    s.alias("likes", "adores")
    s.supersede(str(al), "not the same")
    s.set_reliability("agent:a", 3, 1)
    s.set_reliability("agent:a", 5, 1)
    s.register_oracle("o", "deterministic_total", "a" * 64, "b" * 64)
    s.demote("cand:1", "stale")
    e, p = log.events(), log.payloads()
    assert [(r.fact, r.seq, r.polarity) for r in state.pins(e, p).collect()] == [("g", p2, "+")]
    assert [tuple(r) for r in state.aliases(e, p).collect()] == [("likes", "adores")]
    assert [tuple(r) for r in state.oracles(e, p).collect()] == [("o", "deterministic_total")]
    assert [tuple(r) for r in state.reliabilities(e, p).collect()] == [("agent:a", "external", 5.0, 1.0)]
    assert [r.target_kind for r in state.superseded(e, p).orderBy("seq").collect()] == ["pin", "alias_event"]
    assert assemble.observations(e, p).count() == 4 and ledger.verify_links(e).count() == 0
    twice = e.unionByName(e.where("seq = 2"))
    assert {(r.seq, r.bad_seq) for r in ledger.verify_links(twice).collect()} == {(2, True)}

    head, schema = log.checkpoint("n", log.events().groupBy("actor").count()), "actor string, count long"
    s.observe("likes", ["q"], "agent:d", 1, outcome=True)
    table, since = log.resume("n", schema)
    assert log.restorable("n")[0] == head and since.count() == 1 and table.count() == 3
    spark.createDataFrame([("x", 1)], schema).write.parquet(f"file://{tmp_path}/log/derived/n/{'f' * 64}")  # of another chain
    assert log.restorable("n")[0] == head
    s.retract_source("agent:a", "wrong")
    assert log.restorable("n") is None and log.resume("n", schema)[1].count() == log.events().count() and log.restorable("other") is None
    folds = {"counts": (lambda live: live.where("payload IS NOT NULL AND kind = 'observation'").groupBy("actor").count(), ["actor"])}
    one = log.replay(folds)
    assert log.restorable("counts") is not None and log.replay(folds) == one
    s.retract_source("agent:a", "was right", restore=True)
    assert log.replay(folds) != one
    ph = log.events().where(F.col("seq") == a).first().payload_hash
    s.redact(ph)
    assert log.payloads().where(F.col("payload_hash") == ph).count() == 0


def test_predictions_at_a_snapshot(spark, tmp_path):
    log = ledger.Ledger(spark, f"file://{tmp_path}/log")
    said = lambda i, actor, fact, outcome: (i, "observation", actor, {"fact": fact, "outcome": outcome}, None, None)
    log.append([said(i, f"agent:{i % 3}", f"f{i % 2}", i % 5 > 1) for i in range(40)])
    knots = spark.createDataFrame([(0.0, 0.1), (1.0, 0.9)], "x double, y double")
    snap = assemble.snapshot_id(log.head()[1], assemble.map_hash(knots))
    first = {r.goal: r.p for r in assemble.predict_at(log.events(), log.payloads(), snap, knots=knots, samples=64).collect()}
    log.append([said(i, "agent:0", "f0", False) for i in range(30)])
    again = {r.goal: r.p for r in assemble.predict_at(log.events(), log.payloads(), snap, knots=knots, samples=64).collect()}
    other = {r.goal: r.p for r in assemble.predict_at(log.events(), log.payloads(), snap, knots=knots.limit(1), samples=64).collect()}
    assert first == again and first.keys() == other.keys() == {"f0", "f1"} and first != other
    obs = assemble.observations(log.events(), log.payloads(), 40)
    rel = spark.createDataFrame([], "actor string, reliability double")
    want = assemble.calibrated(predict.predict_frequency(tallies.compose(tallies.fact_counts(obs), rel), 64), knots)
    assert {r.goal: r.p for r in want.collect()} == first
    log.append([(99, "retraction", "human:operator", {"actor": "agent:1", "restored": "false"}, None, None)])
    assert {r.goal: r.p for r in assemble.predict_at(log.events(), log.payloads(), snap, knots=knots, samples=64).collect()} != first
    assert assemble.predict_at(log.events(), log.payloads(), assemble.snapshot_id(ledger.GENESIS, "")).count() == 0
    with pytest.raises(KeyError):
        assemble.predict_at(log.events(), log.payloads(), assemble.snapshot_id("e" * 64, ""))
    with pytest.raises(ValueError):
        assemble.parse_snapshot("{}")
    assert "alpha=0.5" in assemble.snapshot_id("h", "c", 0.5)


def test_conjectures_are_filed_once(spark):
    found = spark.createDataFrame([("g", ["a"], "v", 0.9), ("g", ["a"], "u", 0.9), ("g", ["b"], "v", 0.5), ("g", ["c"], "w", 0.5)], "pred string, args array<string>, via string, sim double")
    known = spark.createDataFrame([("v", ["a"], 0.7, 0.6, 0.8), ("v", ["b"], 0.6, 0.5, 0.7)], "pred string, args array<string>, p double, ci_lo double, ci_hi double")
    none = assemble.empty_claims(spark)
    filed = assemble.file_conjectures(found, known, none, 7)
    assert sorted((r.args[0], r.via, r.predicted_p) for r in filed.collect()) == [("a", "v", 0.7), ("b", "v", 0.6)]
    again = filed.select("pred", "args", "predictor_class", F.lit(False).alias("resolved"))
    assert assemble.file_conjectures(found, known, again, 9).count() == 0
    assert assemble.file_conjectures(found, known, again.withColumn("resolved", F.lit(True)), 9).count() == 2


def test_text_helpers(spark):
    df = spark.createDataFrame([(" A  Long\nspan of 12.50 words is here ", "long SPAN of 12.50 words", "Q"), ("nothing", "nothing", "q")], "t string, s string, e string")
    a, b = df.select(X.plain("t"), X.holds_span("t", "s"), X.longest_shared(F.split(X.plain("t"), " "), F.split(X.plain("s"), " ")), X.shifted_number("t", 2.0), X.negated("t"), X.swapped(F.col("t"), F.lit("SPAN"), F.col("e"))).collect()
    assert tuple(a) == ("a long span of 12.50 words is here", True, 5, " A  Long\nspan of 25.00 words is here ", " A  Long\nspan of 12.50 words is not here ", " A  Long\nQ of 12.50 words is here ")
    assert tuple(b) == ("nothing", False, 1, None, None, None)
    share = spark.range(2000).select(F.avg(X.in_training("id").cast("int"))).first()[0]
    assert 0.45 < share < 0.55
    rows = [(1, "works", " Laser ", True, {"method": "x", "kind": "odd"}), (1, "works", "laser", True, {"method": "x", "kind": "a"}), (2, "bad", "laser", True, {}), (1, "works", "#", True, {}), (1, "works", "laser", None, {})]
    out = evidence.extracted(spark.createDataFrame(rows, "epoch int, pred string, arg string, outcome boolean, ctx map<string,string>"), ["works"], {"method": (["x"], "other"), "kind": (["a", "b"], "none")}).collect()
    assert [(r.arg, r.ctx) for r in out] == [("laser", {"method": "x", "kind": "a"})]


def test_dense_ranking_leaves_headers_to_words(spark):
    corpus = spark.createDataFrame([(1, "h", [1.0, 0.0]), (2, "t" * 120, [1.0, 0.1]), (3, "t" * 120, None), (4, "t" * 120, [0.0, 1.0])], "entry long, text string, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query long, vector array<double>")
    assert [(r["query"], r.entry) for r in retrieval.dense_ranking(q, corpus, 5).orderBy("rank").collect()] == [(7, 2), (7, 4)]
    assert retrieval.dense_ranking(q, corpus.drop("embedding"), 5).count() == 0 and retrieval.dense_ranking(q.drop("vector"), corpus, 5).count() == 0


def test_categorical_caveat(spark):
    obs = spark.createDataFrame([("a", "v", {"k": "1"}), ("b", "v", {"k": "1"}), ("c", "v", {"derived:x": "1"}), ("d", None, {"k": "1"})], "fact string, value string, ctx map<string,string>")
    guards = spark.createDataFrame([("a", "k"), ("b", "other")], "fact string, key string")
    assert [r.fact for r in assemble.under_specified(obs, guards).collect()] == ["b"]


def test_bootstrap_weights_are_poisson(spark):
    from attesta.operators import calibration

    r = np.random.default_rng(1)
    rows = [(float(a), float(b), i) for i, (a, b) in enumerate(r.random((400, 2)))]
    d, lo, hi = calibration.paired_bootstrap(spark.createDataFrame(rows, "a double, b double, key long").repartition(3), draws=4000).first()
    x = np.array([a - b for a, b, _ in rows])
    assert abs(d - x.mean()) < 1e-12 and abs((hi - lo) / (2 * 1.96 * x.std() / 20) - 1) < 0.1 and lo < d < hi


def test_identities_in_the_jvm(spark):
    from attesta.functions import canon

    odd = ["".join(map(chr, range(0x20))), "\\u000B \\\\u001F", 'a"b\\', "é日🙂\u2028\x7f/", "", "x\x0b\\", "\x1f"]
    rows = [(p, [a, b], {a: b, "k": p}) for p, a, b in zip(odd, odd[1:] + odd[:1], odd[2:] + odd[:2], strict=True)] + [("p", [], {}), (None, ["a"], None), ("p", None, {"a": None}), ("p", ["a"], {"b": "1", "a": "2", "A": "3"})]
    df = spark.createDataFrame(rows, "p string, a array<string>, c map<string,string>").select("p", "a", "c", canon.fact_key_of("p", "a").alias("f"), canon.context_signature_of("c").alias("s"))
    for r in df.collect():
        assert r.f == (None if r.p is None or r.a is None else canon.fact_key(r.p, r.a)), r
        assert r.s == canon.context_signature(r.c), r
