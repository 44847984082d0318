"""Named queries over the driver's tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import canon
from attesta.functions import expressions as X
from attesta.operators import assemble, calibration, claims, components, conjecture, constraints, datalog, dispersion, gate, predict, retrieval, series, sweep, tallies, trust
from attesta.sources import adapters, ledger, state
from attesta.sources.shared import checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_E = """e AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, user_id::VARCHAR AS fact, 'agent:' || (event_id % 7) AS actor, event_type IN ('purchase', 'signup') AS outcome, event_type AS val,
  ((event_id % 11) / 10.0)::DOUBLE AS confidence, floor((props->>'$.k')::INT / 25)::INT::VARCHAR AS kbin, CASE WHEN events.value < 5 THEN 'low' WHEN events.value < 20 THEN 'mid' ELSE 'high' END AS vbin FROM events)"""
_EC = _E + """, ec AS (SELECT seq, ts_ms, fact, outcome, 'kbin' AS key, kbin AS v FROM e UNION ALL SELECT seq, ts_ms, fact, outcome, 'vbin', vbin FROM e)"""
_L = """l AS (SELECT l_suppkey::VARCHAR AS fact, 'tool:' || (l_orderkey % 5) AS actor, l_returnflag = 'R' AS outcome, l_linestatus AS status, floor(l_quantity / 10)::INT::VARCHAR AS qty FROM lineitem),
  lc AS (SELECT fact, outcome, 'status' AS key, status AS v FROM l UNION ALL SELECT fact, outcome, 'qty', qty FROM l), lg AS (SELECT fact, key, v, count(*) AS n, count(*) FILTER (outcome) AS k FROM lc GROUP BY ALL)"""
_D = """r AS (SELECT doc_id, doc_id::VARCHAR AS fact, unnest([{'actor': 'verifier:length', 'vote': n_chars >= 600}, {'actor': 'verifier:language', 'vote': coalesce(lang = 'en', false)},
  {'actor': 'verifier:shape', 'vote': coalesce(NOT regexp_matches(text, '!!|\\*\\*\\*|###|\\|'), false)}, {'actor': 'verifier:yes', 'vote': true}], recursive := true) FROM documents),
  s AS (SELECT r.fact, actor, vote, quality = 1 AS truth FROM r JOIN labels USING (doc_id) WHERE doc_id % 2 = 1),
  conf AS (SELECT actor, count(*) FILTER (vote AND truth) AS tp, count(*) FILTER (NOT vote AND truth) AS fn, count(*) FILTER (vote AND NOT truth) AS fp, count(*) FILTER (NOT vote AND NOT truth) AS tn FROM s GROUP BY actor),
  rate AS (SELECT *, (9.5 + tp) / (10 + tp + fn) AS sens, (0.5 + fp) / (10 + fp + tn) AS fpr FROM conf),
  lr AS (SELECT *, ln(sens / fpr) AS lr_yes, ln((1 - sens) / (1 - fpr)) AS lr_no FROM rate),
  claim AS (SELECT r.doc_id, r.fact, 1 / (1 + exp(-greatest(-60, least(60, sum(CASE WHEN vote THEN lr_yes ELSE lr_no END))))) AS p FROM r JOIN lr USING (actor) GROUP BY ALL),
  c AS (SELECT fact, p, quality = 1 AS outcome FROM claim JOIN labels USING (doc_id) WHERE doc_id % 2 = 0)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def _groups(obs: DataFrame) -> DataFrame:
    return obs.select("fact", "outcome", F.explode("ctx").alias("key", "val")).groupBy("fact", "key", "val").agg(F.count("*").alias("n"), F.count_if("outcome").alias("k"))


def _hits(s: SparkSession, d: str) -> DataFrame:
    return adapters.from_events(s, d).select("fact", "seq", F.col("outcome").alias("hit"))


# ---- tallies


@query("posterior_mean_rate", f"WITH {_E} SELECT fact, count(*) AS n, count(*) FILTER (outcome) AS k, (count(*) FILTER (outcome) + 1) / (count(*) + 2) AS p FROM e GROUP BY fact")
def _(s, d):
    c = adapters.from_events(s, d).groupBy("fact").agg(F.count("*").alias("n"), F.count_if("outcome").alias("k"))
    return c.withColumn("p", X.posterior_mean("k", "n"))


@query("fold_counts", f"WITH {_E} SELECT fact, actor, 'alea' AS channel, count(*) AS n, count(*) FILTER (outcome) AS k FROM e GROUP BY fact, actor")
def _(s, d):
    return tallies.fact_counts(adapters.from_events(s, d))


@query("fold_counts_lineitem", f"WITH {_L} SELECT fact, actor, 'alea' AS channel, count(*) AS n, count(*) FILTER (outcome) AS k FROM l GROUP BY fact, actor")
def _(s, d):
    return tallies.fact_counts(adapters.from_lineitem(s, d))


@query("category_counts", "SELECT o_custkey::VARCHAR AS fact, 'agent:' || (o_orderkey % 3) AS actor, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL")
def _(s, d):
    return tallies.category_counts(adapters.from_orders(s, d))


@query("context_diversity", f"WITH {_EC} SELECT fact, key, count(DISTINCT v) AS n_values FROM ec GROUP BY fact, key")
def _(s, d):
    return tallies.context_diversity(adapters.from_events(s, d))


@query("quota_usage", f"WITH {_E} SELECT actor, ts_ms // 86400000 AS epoch, count(*) AS used FROM e GROUP BY ALL")
def _(s, d):
    return tallies.quota_usage(adapters.from_events(s, d))


@query("context_breakdown_residual", f"""WITH {_EC}, x AS (SELECT * FROM ec WHERE v <> 'high'), t AS (SELECT fact, count(*) AS tn, count(*) FILTER (outcome) AS tk FROM e GROUP BY fact),
g AS (SELECT fact, key, v AS val, count(*) AS n, count(*) FILTER (outcome) AS k FROM x GROUP BY ALL), u AS (SELECT fact, key, sum(n) AS sn, sum(k) AS sk FROM g GROUP BY ALL)
SELECT fact, key, val, n, k FROM g UNION ALL SELECT fact, key, '__residual__', (tn - sn)::BIGINT, (tk - sk)::BIGINT FROM u JOIN t USING (fact) WHERE tn > sn""")
def _(s, d):
    o = adapters.from_events(s, d).withColumn("ctx", F.map_filter("ctx", lambda k, v: v != "high"))
    return tallies.context_breakdown(o)


@query("pair_interactions", f"WITH {_E} SELECT 'derived:kbinxvbin' AS key, kbin || '|' || vbin AS val, count(*) AS n, count(*) FILTER (outcome) AS k FROM e GROUP BY ALL")
def _(s, d):
    o = adapters.from_events(s, d)
    return tallies.interactions(o).join(o.select("fact", "seq", "outcome"), ["fact", "seq"]).groupBy("key", "val").agg(F.count("*").alias("n"), F.count_if("outcome").alias("k"))


@query("derived_clock", f"WITH {_E} SELECT seq, strftime(make_timestamp(ts_ms * 1000), '%H') AS hour, (isodow(make_timestamp(ts_ms * 1000)) - 1)::VARCHAR AS dow FROM e")
def _(s, d):
    hour, dow = X.clock("ts_ms")
    return adapters.from_events(s, d).select("seq", hour.alias("hour"), dow.alias("dow"))


@query("derived_prev", f"WITH {_E} SELECT fact, seq, CASE WHEN lag(outcome) OVER w THEN 'T' WHEN NOT lag(outcome) OVER w THEN 'F' END AS prev FROM e WINDOW w AS (PARTITION BY fact ORDER BY seq)")
def _(s, d):
    return series.previous_outcome(adapters.from_events(s, d)).select("fact", "seq", "prev")


@query("regime_mixed", f"WITH {_E} SELECT fact, count(*) FILTER (kbin <> '3') > 0 AND (count(DISTINCT kbin) FILTER (kbin <> '3') >= 2 OR count(*) FILTER (kbin <> '3') < count(*)) AS regime_mixed FROM e GROUP BY fact")
def _(s, d):
    do = F.map_from_entries(F.filter(F.array(F.struct(F.lit("do:band").alias("key"), F.col("ctx")["kbin"].alias("value"))), lambda e: e["value"] != "3"))
    return tallies.regime_mixed(adapters.from_events(s, d).withColumn("ctx", do))


@query("shared_source", "SELECT c_nationkey::VARCHAR AS source, count(DISTINCT c_custkey) AS facts FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey) >= 2")
def _(s, d):
    return tallies.shared_sources(adapters.table(s, d, "customer").select(F.col("c_custkey").alias("fact"), F.col("c_nationkey").cast("string").alias("source")))


@query("open_vocab_predictive", """WITH c AS (SELECT o_custkey::VARCHAR AS fact, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT fact, sum(n) AS total FROM c GROUP BY fact)
SELECT fact, value, false AS is_unknown, round(n / (total + 1.0), 9) AS p FROM c JOIN t USING (fact) UNION ALL SELECT fact, NULL, true, round(1 / (total + 1.0), 9) FROM t""")
def _(s, d):
    return _round(tallies.open_vocabulary(tallies.category_counts(adapters.from_orders(s, d)), interval=False), "p", digits=9)


@query("open_vocab_intervals")
def _(s, d):
    return tallies.open_vocabulary(tallies.category_counts(adapters.from_orders(s, d)))


@query("context_predictive", """WITH c AS (SELECT o_custkey::VARCHAR || '@' || o_orderpriority AS fact, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT fact, sum(n) AS total FROM c GROUP BY fact)
SELECT fact, value, false AS is_unknown, round(n / (total + 1.0), 9) AS p FROM c JOIN t USING (fact) UNION ALL SELECT fact, NULL, true, round(1 / (total + 1.0), 9) FROM t""")
def _(s, d):
    o = adapters.from_orders(s, d)
    return _round(tallies.open_vocabulary(tallies.category_counts(o.withColumn("fact", F.concat_ws("@", "fact", F.col("ctx")["priority"]))), interval=False), "p", digits=9)


# ---- dispersion


@query("overdispersion_z", f"""WITH {_L}, t AS (SELECT fact, key, sum(n) AS tn, sum(k) AS tk FROM lg GROUP BY ALL),
x AS (SELECT fact, key, count(*) AS groups, any_value(tn)::BIGINT AS n, any_value(tk)::BIGINT AS k, sum(pow(lg.k - lg.n * (tk / tn), 2)) AS ss, sum(2 * lg.n * (lg.n - 1)) AS spread FROM lg JOIN t USING (fact, key) GROUP BY ALL)
SELECT fact, key, groups, n, k, round(CASE WHEN groups >= 2 AND k > 0 AND k < n AND spread > 0 THEN (ss / ((k / n) * (1 - k / n)) - n) / sqrt(spread) END, 6) AS z FROM x""")
def _(s, d):
    return _round(dispersion.overdispersion(_groups(adapters.from_lineitem(s, d)), ["fact", "key"]), "z")


@query("explained_fraction", f"""WITH {_L}, t AS (SELECT fact, key, sum(n) AS tn, sum(k) AS tk FROM lg GROUP BY ALL)
SELECT fact, key, round(CASE WHEN any_value(tk) IN (0, any_value(tn)) THEN 0 ELSE sum(n * pow(k / n - tk / tn, 2)) / any_value(tn) / any_value((tk / tn) * (1 - tk / tn)) END, 6) AS eta2 FROM lg JOIN t USING (fact, key) GROUP BY ALL""")
def _(s, d):
    return _round(dispersion.explained_fraction(_groups(adapters.from_lineitem(s, d)), ["fact", "key"]), "eta2")


@query("mdl_gain", f"""WITH {_L}, b AS (SELECT *, -(k * log2((k + 0.5) / (n + 1.0)) + (n - k) * log2(1 - (k + 0.5) / (n + 1.0))) AS bits FROM lg), t AS (SELECT fact, key, count(*) AS m, sum(n) AS n, sum(k) AS k, sum(bits) AS given FROM b GROUP BY ALL)
SELECT fact, key, round(2 + log2(greatest(2, m)), 6) AS dl_guard, round(given, 6) AS dl_given, round(-(k * log2((k + 0.5) / (n + 1.0)) + (n - k) * log2(1 - (k + 0.5) / (n + 1.0))), 6) AS dl_residual,
 2 + log2(greatest(2, m)) + given < -(k * log2((k + 0.5) / (n + 1.0)) + (n - k) * log2(1 - (k + 0.5) / (n + 1.0))) AS accepted FROM t""")
def _(s, d):
    return _round(dispersion.mdl(_groups(adapters.from_lineitem(s, d)), ["fact", "key"]), "dl_guard", "dl_given", "dl_residual")


@query("dispersion_pvalues")
def _(s, d):
    return dispersion.pvalues(_groups(adapters.from_lineitem(s, d)), ["fact", "key"])


@query("breadth_entropy", f"""WITH {_EC}, c AS (SELECT fact, key, v, count(*) AS c FROM ec WHERE outcome GROUP BY ALL), k AS (SELECT fact, key, sum(c) AS n, count(*) AS m, sum(c * ln(c)) AS s FROM c GROUP BY ALL),
h AS (SELECT fact, avg(CASE WHEN m > 1 THEN (ln(n) - s / n) / ln(m) ELSE 0 END) AS b FROM k WHERE n >= 3 GROUP BY fact)
SELECT f.fact, round(coalesce(b, 0), 6) AS breadth, CASE WHEN coalesce(b, 0) < 0.34 THEN 'narrow' WHEN coalesce(b, 0) < 0.67 THEN 'moderate' ELSE 'broad' END AS breadth_class FROM (SELECT DISTINCT fact FROM c) f LEFT JOIN h USING (fact)""")
def _(s, d):
    o = adapters.from_events(s, d).where("outcome")
    return _round(dispersion.breadth(o.select("fact", F.explode("ctx").alias("key", "val"))), "breadth")


# ---- series

_LOC = f"""{_E}, w AS (SELECT fact, seq, row_number() OVER o - 1 AS i, sum(outcome::INT) OVER o AS c, count(*) OVER p AS n, sum(outcome::INT) OVER p AS k FROM e WINDOW o AS (PARTITION BY fact ORDER BY seq), p AS (PARTITION BY fact)),
loc AS (SELECT fact, n, k::BIGINT AS k, i::INT AS cut, seq AS cut_seq, i + 1 AS n1, c::BIGINT AS k1 FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY abs(c * n - k * (i + 1)) DESC, i) AS r FROM w) WHERE r = 1)"""
_FISH = f"""{_LOC}, grid AS (SELECT *, unnest(range(greatest(0, k - (n - n1)), least(n1, k) + 1)) AS x FROM loc),
lp AS (SELECT *, lgamma(n1 + 1) - lgamma(x + 1) - lgamma(n1 - x + 1) + lgamma(n - n1 + 1) - lgamma(k - x + 1) - lgamma(n - n1 - k + x + 1) - (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) AS v FROM grid),
obs AS (SELECT fact, v AS o FROM lp WHERE x = k1), fisher AS (SELECT fact, CASE WHEN any_value(n - n1) = 0 THEN 1.0 ELSE least(1.0, sum(exp(v)) FILTER (v <= o + 1e-9)) END AS f FROM lp JOIN obs USING (fact) GROUP BY fact)"""


@query("changepoint_locate", f"WITH {_LOC} SELECT fact, n, k, cut, cut_seq, n1, k1 FROM loc")
def _(s, d):
    return series.locate(_hits(s, d), ["fact"])


@query("changepoint_test", f"""WITH {_FISH} SELECT fact, n, cut, round(f, 6) AS fisher, round(least(1.0, f * greatest(1, n - 15)), 6) AS p, n >= 16 AND least(n1, n - n1) >= 8 AND least(1.0, f * greatest(1, n - 15)) <= 0.01 AS detected FROM loc JOIN fisher USING (fact)""")
def _(s, d):
    return _round(series.changepoints(_hits(s, d), ["fact"]).select("fact", "n", "cut", "fisher", "p", "detected"), "fisher", "p")


@query("bh_selection", f"""WITH {_FISH}, r AS (SELECT fact, fact::INT % 5 AS family, round(f, 9) AS p, row_number() OVER (PARTITION BY fact::INT % 5 ORDER BY round(f, 9), fact) AS r, count(*) OVER (PARTITION BY fact::INT % 5) AS m FROM fisher)
SELECT fact, family, coalesce(r <= max(r) FILTER (p <= 0.5 * r / m) OVER (PARTITION BY family), false) AS keep FROM r""")
def _(s, d):
    t = series.changepoints(_hits(s, d), ["fact"]).select("fact", F.expr("cast(fact as int) % 5").alias("family"), F.round("fisher", 9).alias("p"))
    return dispersion.benjamini_hochberg(t, ["family"], ["fact"], alpha=0.5).select("fact", "family", "keep")


@query("time_blocks", f"""WITH {_E}, b AS (SELECT fact, (row_number() OVER (PARTITION BY fact ORDER BY seq) - 1) // 16 AS block, outcome FROM e)
SELECT fact, block, count(*) AS n, count(*) FILTER (outcome) AS k FROM b GROUP BY fact, block HAVING count(*) = 16""")
def _(s, d):
    return series.time_blocks(_hits(s, d), 16)


@query("temporal_dispersion")
def _(s, d):
    return series.temporal_dispersion(_hits(s, d))


@query("flaky_runs", f"""WITH {_E}, v AS (SELECT fact, seq, actor, outcome, CASE WHEN greatest(confidence, 1 - confidence) < 0.75 THEN 1 WHEN greatest(confidence, 1 - confidence) < 0.9 THEN 2 ELSE 3 END AS grade, CASE WHEN kbin = '0' THEN NULL ELSE kbin END AS sig FROM e),
m AS (SELECT *, CASE WHEN (lag(actor) OVER w = actor AND lag(outcome) OVER w = outcome AND lag(grade) OVER w = grade AND coalesce(lag(sig) OVER w, '') = coalesce(sig, '')) THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY fact ORDER BY actor, sig NULLS FIRST, seq))
SELECT fact, sum(new)::BIGINT AS runs, count(DISTINCT (actor, outcome, grade, coalesce(sig, ''))) AS classes, sum(new) > 2 * count(DISTINCT (actor, outcome, grade, coalesce(sig, ''))) AS flaky FROM m GROUP BY fact""")
def _(s, d):
    v = adapters.from_events(s, d).select("fact", "seq", "actor", "outcome", X.confidence_grade("confidence").alias("grade"), F.when(F.col("ctx")["kbin"] != "0", F.col("ctx")["kbin"]).alias("sig"))
    return series.flaky(v)


@query("cusum_alarm", f"""WITH RECURSIVE {_E}, h AS (SELECT fact, row_number() OVER (PARTITION BY fact ORDER BY seq) - 1 AS i, outcome::INT AS x, avg(outcome::INT) OVER (PARTITION BY fact) AS m FROM e WHERE outcome IS NOT NULL),
z AS (SELECT fact, i, (x - m) / sqrt(greatest(m * (1 - m), 1e-12)) AS z FROM h),
f(fact, i, up, down) AS (SELECT fact, i, greatest(0, z - 0.5)::DOUBLE, greatest(0, -z - 0.5)::DOUBLE FROM z WHERE i = 0 UNION ALL SELECT z.fact, z.i, greatest(0, up + z - 0.5), greatest(0, down - z - 0.5) FROM f JOIN z ON f.fact = z.fact AND z.i = f.i + 1)
SELECT fact, min(i) FILTER (up > 5 OR down > 5)::INT AS alarm FROM f GROUP BY fact""")
def _(s, d):
    return series.cusum(_hits(s, d))


@query("holdout_split", f"""WITH {_E}, h AS (SELECT fact, seq, seq::UBIGINT AS z FROM e), a AS (SELECT fact, seq, (xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM h),
b AS (SELECT fact, seq, (xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM a)
SELECT fact, seq, row_number() OVER (PARTITION BY fact ORDER BY xor(z, z >> 31), seq) % 4 = 0 AS held_out FROM b""")
def _(s, d):
    return series.holdout(adapters.from_events(s, d).select("fact", "seq"), ["fact"])


@query("pin_tension", f"""WITH {_E}, p AS (SELECT fact, min(seq) AS pin_seq FROM e GROUP BY fact), h AS (SELECT e.fact, seq, row_number() OVER (PARTITION BY e.fact ORDER BY seq) AS c FROM e JOIN p USING (fact) WHERE outcome AND seq > pin_seq) SELECT fact, seq FROM h WHERE c = 3""")
def _(s, d):
    o = adapters.from_events(s, d)
    return series.pin_tension(o, o.groupBy("fact").agg(F.min("seq").alias("pin_seq")))


@query("prospective_score", f"""WITH {_E}, n AS (SELECT count(*) // 2 AS m FROM e), x AS (SELECT fact, count(*) FILTER ((vbin = 'high') = outcome) AS hits, count(*) FILTER ((vbin = 'high') <> outcome) AS misses FROM e, n WHERE seq > m GROUP BY fact)
SELECT fact, 'vbin' AS key, 'high' AS best, hits, misses, round(CASE WHEN hits >= misses THEN 1 ELSE -1 END * (hits * ln(2 * (hits + 0.5) / (hits + misses + 1.0)) + misses * ln(2 * (1 - (hits + 0.5) / (hits + misses + 1.0)))), 6) AS evidence, misses > 2 * hits AS stale FROM x WHERE hits + misses >= 16""")
def _(s, d):
    o = adapters.from_events(s, d)
    m = adapters.table(s, d, "events").count() // 2
    g = o.select("fact").distinct().select("fact", F.lit("vbin").alias("key"), F.lit("high").alias("best"), F.lit(m).cast("long").alias("admitted_seq"))
    return _round(sweep.guard_scores(o, g), "evidence")


# ---- sweep and gate


@query("sweep_report")
def _(s, d):
    return sweep.sweep(adapters.from_events(s, d))


@query("sweep_categorical")
def _(s, d):
    return sweep.sweep_categorical(adapters.from_orders_by_priority(s, d))


@query("guard_decisions")
def _(s, d):
    return gate.guard_decisions(sweep.sweep_categorical(adapters.from_orders_by_priority(s, d)))


@query("open_questions")
def _(s, d):
    return sweep.questions(sweep.sweep(adapters.from_events(s, d)))


@query("gate_batch", "SELECT s_suppkey AS candidate, s_suppkey::VARCHAR AS fact, CASE WHEN s_nationkey % 5 = 4 THEN 1 WHEN s_suppkey % 10 = 0 THEN 4 END AS failing_step, CASE WHEN s_nationkey % 5 = 4 OR s_suppkey % 10 = 0 THEN 'rejected' ELSE 'admitted' END AS status FROM supplier")
def _(s, d):
    t = adapters.table(s, d, "supplier")
    c = t.select(F.col("s_suppkey").alias("candidate"), F.col("s_suppkey").cast("string").alias("fact"), F.concat(F.lit("p"), (F.col("s_nationkey") % 5).cast("string")).alias("pred"), F.lit(2).alias("arity"))
    known = s.createDataFrame([(f"p{i}", 2) for i in range(4)], "pred string, arity int")
    return gate.batch_facts(c, known, t.where("s_suppkey % 10 = 0").select(F.col("s_suppkey").cast("string").alias("fact"), F.lit("-").alias("polarity")))


# ---- trust and calibration


def _votes(s, d):
    return trust.scored(*adapters.judges(s, d))


@query("confusion", f"WITH {_D} SELECT * FROM conf")
def _(s, d):
    return trust.confusion(_votes(s, d))


@query("rates_loglr", f"WITH {_D} SELECT actor, tp, fn, fp, tn, round(sens, 6) AS sens, round(fpr, 6) AS fpr, round(lr_yes, 6) AS lr_yes, round(lr_no, 6) AS lr_no FROM lr")
def _(s, d):
    return _round(trust.rates(trust.confusion(_votes(s, d))), "sens", "fpr", "lr_yes", "lr_no")


@query("response_ledger", f"""WITH {_D}, t AS (SELECT actor, vote, count(*) FILTER (truth) AS nt, count(*) FILTER (NOT truth) AS nf FROM s GROUP BY ALL), u AS (SELECT *, sum(nt) OVER (PARTITION BY actor) AS t, sum(nf) OVER (PARTITION BY actor) AS f FROM t)
SELECT u.actor, vote, 0 AS grade, round(CASE WHEN t + f >= 10 THEN ln(((nt + 0.5) / (t + 4)) / ((nf + 0.5) / (f + 4))) WHEN vote THEN lr_yes ELSE lr_no END, 6) AS log_lr FROM u JOIN lr USING (actor)""")
def _(s, d):
    return _round(trust.response_log_lr(_votes(s, d)), "log_lr")


@query("settlement_scoring", f"WITH {_D} SELECT actor, 19.0::DOUBLE + count(*) FILTER (vote = truth) AS a, 1.0::DOUBLE + count(*) FILTER (vote <> truth) AS b, round((19.0 + count(*) FILTER (vote = truth)) / (20.0 + count(*)), 6) AS reliability FROM s GROUP BY actor")
def _(s, d):
    return _round(trust.reliability(_votes(s, d)), "reliability")


@query("reliability_override", f"""WITH {_D}, o AS (SELECT 'verifier:length' AS actor, 5.0 AS a0, 5.0 AS b0, (SELECT median(doc_id)::BIGINT FROM labels) AS mid), x AS (SELECT s.*, o.mid, a0, b0 FROM s LEFT JOIN o USING (actor))
SELECT actor, (coalesce(any_value(a0), 19.0) + count(*) FILTER (vote = truth AND (mid IS NULL OR fact::BIGINT * 10 + 9 > mid * 10)))::DOUBLE AS a, (coalesce(any_value(b0), 1.0) + count(*) FILTER (vote <> truth AND (mid IS NULL OR fact::BIGINT * 10 + 9 > mid * 10)))::DOUBLE AS b FROM x GROUP BY actor""")
def _(s, d):
    at = adapters.table(s, d, "labels").agg(F.expr("cast(rint(median(doc_id)) as bigint)").alias("m")).first()["m"]
    o = s.createDataFrame([("verifier:length", at * 10, 5.0, 5.0), ("verifier:length", at * 10 - 1, 1.0, 1.0)], "actor string, seq long, a double, b double")
    return trust.reliability(_votes(s, d), o).drop("reliability")


@query("composed_counts", f"""WITH {_D}, rel AS (SELECT actor, (19.0 + count(*) FILTER (vote = truth)) / (20.0 + count(*)) AS w FROM s GROUP BY actor)
SELECT fact, round(sum(CASE WHEN vote THEN w ELSE 0 END), 6) AS epi_a, round(sum(CASE WHEN vote THEN 0 ELSE w END), 6) AS epi_b, 0.0::DOUBLE AS alea_n, 0.0::DOUBLE AS alea_k FROM r JOIN rel USING (actor) GROUP BY fact""")
def _(s, d):
    reports, _settled = adapters.judges(s, d)
    return _round(tallies.compose(tallies.fact_counts(reports, channel="epi"), trust.reliability(_votes(s, d))), "epi_a", "epi_b")


@query("grouped_logodds", f"WITH {_D} SELECT fact, round(p, 6) AS p FROM claim")
def _(s, d):
    return _round(_claims_all(s, d), "p")


def _claims_all(s, d):
    reports, _settled = adapters.judges(s, d)
    conf = trust.confusion(_votes(s, d))
    return trust.grouped_logodds(reports.withColumnRenamed("outcome", "vote"), conf).select("fact", "p")


def _claims(s, d):
    labels = adapters.table(s, d, "labels").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("fact"), (F.col("quality") == 1).alias("outcome"))
    return _claims_all(s, d).join(labels, "fact")


_CAT = """o AS (SELECT o_orderkey AS seq, o_custkey::VARCHAR AS fact, 'agent:' || (o_orderkey % 3) AS actor, o_orderstatus AS v FROM orders), z AS (SELECT fact, max(seq) AS zs, arg_max(v, seq) AS real FROM o GROUP BY fact),
j AS (SELECT actor, v, real FROM o JOIN z USING (fact) WHERE seq < zs), cells AS (SELECT actor, real AS value, v = real AS vote, true AS truth FROM j UNION ALL SELECT actor, v, true, false FROM j WHERE v <> real),
cc AS (SELECT actor, value, count(*) FILTER (vote AND truth) AS tp, count(*) FILTER (NOT vote AND truth) AS fn, count(*) FILTER (vote AND NOT truth) AS fp, count(*) FILTER (NOT vote AND NOT truth) AS tn FROM cells GROUP BY ALL)"""


def _category_confusion(s, d):
    o = adapters.from_orders(s, d)
    settled = o.groupBy("fact").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
    return trust.category_confusion(o, settled)


@query("one_vs_rest_confusion", f"WITH {_CAT} SELECT * FROM cc")
def _(s, d):
    return _category_confusion(s, d)


@query("category_weight", f"WITH {_CAT} SELECT actor, value, round(least(1.0, exp(ln(((9.5 + tp) / (10 + tp + fn)) / ((0.5 + fp) / (10 + fp + tn))) - ln(19))), 6) AS weight FROM cc")
def _(s, d):
    return _round(trust.category_weights(_category_confusion(s, d)), "weight")


@query("calibration_buckets", f"WITH {_D} SELECT least(9, greatest(0, floor(p * 10)::INT)) AS bucket, count(*) AS n, count(*) FILTER (outcome) AS k, sum(round_even(p * 1000, 0))::BIGINT AS p_milli FROM c GROUP BY ALL")
def _(s, d):
    return calibration.tallies(_claims(s, d))


@query("calibration_report", f"WITH {_D}, t AS (SELECT least(9, greatest(0, floor(p * 10)::INT)) AS bucket, count(*) AS n, count(*) FILTER (outcome) AS k, sum(round_even(p * 1000, 0))::BIGINT AS p_milli FROM c GROUP BY ALL) SELECT *, round(p_milli / (1000 * n), 6) AS mean_p, round(k / n, 6) AS observed, n >= 50 AS alertable FROM t")
def _(s, d):
    return _round(calibration.report(calibration.tallies(_claims(s, d))), "mean_p", "observed")


@query("brier_logloss", f"WITH {_D} SELECT count(*) AS n, round(avg(pow(p - outcome::INT, 2)), 6) AS brier, round(avg(-ln(CASE WHEN outcome THEN greatest(1e-12, least(1 - 1e-12, p)) ELSE 1 - greatest(1e-12, least(1 - 1e-12, p)) END)), 6) AS log_loss, round(avg(((p >= 0.5) = outcome)::INT), 6) AS accuracy FROM c")
def _(s, d):
    return _round(calibration.scores(_claims(s, d)), "brier", "log_loss", "accuracy")


@query("ece_slope", f"WITH {_D}, b AS (SELECT least(9, greatest(0, floor(p * 10)::INT)) AS bucket, count(*) AS n, avg(p) AS x, avg(outcome::INT) AS y FROM c GROUP BY ALL) SELECT round(sum(n * abs(x - y)) / sum(n), 6) AS ece, round((sum(n) * sum(n * x * y) - sum(n * x) * sum(n * y)) / (sum(n) * sum(n * x * x) - pow(sum(n * x), 2)), 6) AS slope FROM b")
def _(s, d):
    return _round(calibration.ece_slope(_claims(s, d)), "ece", "slope")


_ISO = f"""{_D}, t AS (SELECT round(p, 3) AS x, count(*) AS n, count(*) FILTER (outcome) AS k FROM c GROUP BY ALL), span AS (SELECT a.x AS lo, b.x AS hi, sum(t.k) / sum(t.n) AS m FROM t a JOIN t b ON a.x <= b.x JOIN t ON t.x BETWEEN a.x AND b.x GROUP BY a.x, b.x),
least_right AS (SELECT z.x, s.lo, min(s.m) AS m FROM t z JOIN span s ON s.lo <= z.x AND s.hi >= z.x GROUP BY z.x, s.lo), iso AS (SELECT x, max(m) AS y FROM least_right GROUP BY x)"""


@query("isotonic_fit", f"WITH {_ISO} SELECT x, n, round(y, 6) AS y FROM t JOIN iso USING (x)")
def _(s, d):
    return _round(calibration.isotonic_fit(_claims(s, d)), "y")


@query("isotonic_apply", f"WITH {_ISO} SELECT fact, round(y, 6) AS calibrated FROM c JOIN iso ON round(p, 3) = x")
def _(s, d):
    c = _claims(s, d).withColumn("p", F.round("p", 3))
    return _round(calibration.isotonic_apply(c, calibration.isotonic_fit(c)).select("fact", "calibrated"), "calibrated")


@query("paired_bootstrap")
def _(s, d):
    y = F.col("outcome").cast("int")
    return calibration.paired_bootstrap(_claims(s, d).select(F.pow(F.col("p") - y, 2).alias("a"), F.pow(0.5 - y, 2).alias("b"), F.col("fact").alias("key")))


@query("health_rollup", "SELECT quality, toxic, count(*) AS n, grouping(quality, toxic)::INT AS level FROM labels GROUP BY CUBE (quality, toxic)")
def _(s, d):
    return adapters.table(s, d, "labels").cube("quality", "toxic").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


# ---- claims


@query("claim_triage", """WITH c AS (SELECT doc_id AS claim, doc_id::VARCHAR AS fact, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'oracle:a' WHEN 2 THEN 'tool:x' WHEN 3 THEN 'later' ELSE 'oracle:b' END AS criterion FROM documents)
SELECT claim, fact, criterion, CASE WHEN criterion = '' THEN 'unsettleable' WHEN criterion LIKE 'oracle:%' THEN 'tool_decidable' WHEN claim % 2 = 0 THEN 'entailed' WHEN criterion LIKE 'tool:%' THEN 'tool_decidable' ELSE 'observation_pending' END AS settlement,
CASE WHEN criterion = '' THEN NULL WHEN criterion LIKE 'oracle:%' THEN criterion WHEN claim % 2 = 0 THEN 'verifier:closure' WHEN criterion LIKE 'tool:%' THEN criterion ELSE 'verifier:observation(' || criterion || ')' END AS verifier,
CASE WHEN criterion = '' THEN NULL WHEN criterion = 'oracle:a' OR (criterion NOT LIKE 'oracle:%' AND claim % 2 = 0) THEN 'certain' ELSE 'estimated' END AS certainty FROM c""")
def _(s, d):
    i = F.col("doc_id")
    c = adapters.table(s, d, "documents").select(i.alias("claim"), i.cast("string").alias("fact"), F.element_at(F.array(*map(F.lit, ["", "oracle:a", "tool:x", "later", "oracle:b"])), (i % 5 + 1).cast("int")).alias("criterion"))
    oracles = s.createDataFrame([("oracle:a", "deterministic_total"), ("oracle:b", "stochastic")], "oracle string, kind string")
    return claims.triage(c, oracles, c.where("claim % 2 = 0").select("fact"))


@query("settled_surprisal", f"WITH {_D} SELECT fact, outcome, round(-ln(CASE WHEN outcome THEN greatest(1e-12, least(1 - 1e-12, p)) ELSE 1 - greatest(1e-12, least(1 - 1e-12, p)) END), 6) AS surprisal FROM c")
def _(s, d):
    c = _claims(s, d)
    first = c.select(F.col("fact").alias("claim"), "outcome", F.lit(1).alias("seq"))
    again = first.select("claim", (~F.col("outcome")).alias("outcome"), F.lit(2).alias("seq"))
    return _round(claims.settle(c.select(F.col("fact").alias("claim"), "p"), first.unionByName(again)).select(F.col("claim").alias("fact"), "outcome", "surprisal"), "surprisal")


@query("blame_target", "WITH x AS (SELECT l_orderkey AS claim, l_partkey::VARCHAR AS component, max(l_quantity) AS s FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY ALL) SELECT claim, component FROM (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY s DESC, component) AS r FROM x) WHERE r = 1")
def _(s, d):
    x = adapters.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("claim"), F.col("l_partkey").cast("string").alias("component")).agg(F.max("l_quantity").alias("s"))
    f = adapters.table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("fact"), F.lit("exact").alias("kind"), (F.col("l_partkey") % 3 == 0).alias("frozen")).distinct()
    return claims.blame(x, f)


@query("vote_baselines", f"""WITH {_D}, w AS (SELECT *, (tp + tn + 1) / (tp + fn + fp + tn + 2) AS acc, (tp + 1) / (tp + fn + 2) AS se, (fp + 1) / (fp + tn + 2) AS fa FROM conf)
SELECT fact, round(avg(vote::INT), 6) AS mean_vote, round(1 / (1 + exp(-sum(CASE WHEN vote THEN 1 ELSE -1 END * ln(acc / (1 - acc))))), 6) AS one_coin, round(1 / (1 + exp(-sum(CASE WHEN vote THEN ln(se / fa) ELSE ln((1 - se) / (1 - fa)) END))), 6) AS two_coin FROM r JOIN w USING (actor) GROUP BY fact""")
def _(s, d):
    reports, _settled = adapters.judges(s, d)
    return _round(claims.baselines(reports.withColumnRenamed("outcome", "vote"), trust.confusion(_votes(s, d))), "mean_vote", "one_coin", "two_coin")


@query("current_facts", "SELECT s_suppkey AS fact FROM supplier WHERE s_suppkey % 4 <> 0 AND NOT (s_suppkey % 3 = 0 AND s_suppkey % 2 = 1)")
def _(s, d):
    k = F.col("s_suppkey")
    f = adapters.table(s, d, "supplier").select(k.alias("fact"), F.lit("admitted").alias("structural"), F.when(k % 4 == 0, F.lit(1)).alias("valid_to"))
    pins = f.where("fact % 3 = 0").select("fact", F.lit(1).alias("seq"), F.lit("-").alias("polarity"), F.lit(True).alias("active"))
    return claims.current(f, pins.unionByName(pins.where("fact % 2 = 0").withColumn("seq", F.lit(2)).withColumn("polarity", F.lit("+")))).select("fact")


@query("distribution_report")
def _(s, d):
    o = adapters.from_events(s, d)
    return claims.distribution(o, sweep.sweep(o))


@query("prediction_caveats")
def _(s, d):
    o = adapters.from_events(s, d)
    r = sweep.sweep(o)
    facts = r.select("fact", "flagged", "breadth_class", (F.col("fact").cast("int") % 30).cast("string").alias("source"), "n")
    goals = r.select((F.col("fact").cast("int") % 10).cast("string").alias("goal"), "fact")
    return claims.caveats(goals, facts, claims.stability(o), tallies.regime_mixed(o)).withColumn("caveats", F.array_join("caveats", ","))


@query("why_report", f"""WITH {_E}, c AS (SELECT fact, actor, count(*) AS n, count(*) FILTER (outcome) AS k FROM e WHERE outcome IS NOT NULL GROUP BY ALL)
SELECT fact, '[' || string_agg('{{"actor":"' || actor || '","n":' || n || ',"k":' || k || '}}', ',' ORDER BY actor) || ']' AS reports, 'cand:' || fact AS candidate, 'log' AS source FROM c GROUP BY fact""")
def _(s, d):
    c = tallies.fact_counts(adapters.from_events(s, d))
    f = c.select("fact").distinct()
    return claims.why(f, c, f.select("fact", F.concat(F.lit("cand:"), "fact").alias("candidate"), F.lit("log").alias("source"))).withColumn("reports", F.to_json("reports"))


# ---- probability engine


@query("predict_frequency")
def _(s, d):
    o = adapters.from_events(s, d)
    none = s.createDataFrame([], "actor string, reliability double")
    return predict.predict_frequency(tallies.compose(tallies.fact_counts(o), none)).drop("sensitivity", "mpe")


@query("predict_crisp")
def _(s, d):
    reports, _settled = adapters.judges(s, d)
    return predict.predict_crisp(reports.withColumnRenamed("outcome", "vote"), trust.confusion(_votes(s, d))).drop("sensitivity", "mpe")


@query("predict_goals")
def _(s, d):
    o = adapters.from_events(s, d).groupBy("fact").agg(F.count("*").alias("n"), F.count_if("outcome").alias("k"))
    st = F.struct("fact", F.lit("frequency").alias("stmt_type"), F.lit(99.0).alias("epi_a"), F.lit(1.0).alias("epi_b"), (F.col("k") + 1.0).alias("alea_a"), (F.col("n") - F.col("k") + 1.0).alias("alea_b"), F.lit(False).alias("pinned"))
    g = o.groupBy(F.concat(F.lit("goal:"), F.floor(F.col("fact").cast("int") / 4).cast("string")).alias("goal")).agg(F.array_sort(F.collect_list(st)).alias("facts"))
    names = F.transform("facts", lambda f: f["fact"])
    p = g.select("goal", F.array(F.slice(names, 1, 2), F.slice(names, 2, 2)).alias("dnf"), "facts", F.array(F.slice(names, 3, 2)).alias("exclusive"))
    return predict.predict_goals(p).drop("mpe").withColumn("sensitivity", F.get(F.map_keys("sensitivity"), F.lit(0)))


@query("mpe", f"WITH {_E}, f AS (SELECT fact, fact::INT % 40 AS g, count(*) FILTER (outcome) + 1 AS a, count(*) FILTER (NOT outcome) + 1 AS b FROM e GROUP BY ALL) SELECT fact, a / (a + b) >= 0.5 AND (g >= 20 OR row_number() OVER (PARTITION BY g, a / (a + b) >= 0.5 ORDER BY a / (a + b) DESC, fact) = 1) AS holds FROM f")
def _(s, d):
    c = adapters.from_events(s, d).groupBy("fact").agg(F.count_if("outcome").alias("k"), F.count("*").alias("n"))
    g = F.expr("cast(fact as int) % 40")
    return predict.mpe(c.select("fact", F.when(g < 20, g).alias("group_key"), (F.col("k") + 1.0).alias("a"), (F.col("n") - F.col("k") + 1.0).alias("b"), F.lit(False).alias("pinned")))


@query("rate_intervals")
def _(s, d):
    return predict.rate_interval(QUERIES["posterior_mean_rate"](s, d))


def _nation_rules(s, d):
    """(base, rules): who supplies which nation, and what follows for nations and regions."""
    n = F.col("s_nationkey").cast("string")
    base = adapters.table(s, d, "supplier").select(F.lit("supplies").alias("pred"), F.array("s_name", n).alias("args"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("fact"))
    k = F.col("n_nationkey").cast("string")
    base = base.unionByName(adapters.table(s, d, "nation").select(F.lit("lies").alias("pred"), F.array(k, F.col("n_regionkey").cast("string")).alias("args"), F.concat(F.lit("n"), k).alias("fact")))
    L = datalog.Literal
    rules = [datalog.Rule("r1", L("served", ("?n",)), (L("supplies", ("?s", "?n")),)), datalog.Rule("r2", L("reached", ("?r",)), (L("served", ("?n",)), L("lies", ("?n", "?r"))))]
    return base, rules


@query("support_sets", """WITH s AS (SELECT s_nationkey AS n, list_sort(['s' || s_suppkey, 'r1']) AS sup FROM supplier), first AS (SELECT n, min(sup) AS f FROM s GROUP BY n)
SELECT 'served' AS pred, n::VARCHAR AS arg, array_to_string(list_sort(list(array_to_string(sup, '+'))), ',') AS supports FROM s GROUP BY n
UNION ALL SELECT 'reached', n_regionkey::VARCHAR, array_to_string(list_sort(list(array_to_string(list_sort(list_distinct(list_concat(f, ['n' || n_nationkey, 'r2']))), '+'))), ',') FROM first JOIN nation ON n = n_nationkey GROUP BY n_regionkey""")
def _(s, d):
    base, rules = _nation_rules(s, d)
    found = assemble.supports(base, rules).where("pred IN ('served', 'reached')")
    return found.select("pred", F.col("args")[0].alias("arg"), F.array_join(F.array_sort(F.transform("supports", lambda x: F.array_join(x, "+"))), ",").alias("supports"))


def _nation_goals(s, d):
    n = F.col("n_nationkey").cast("string")
    return adapters.table(s, d, "nation").select(F.concat(F.lit("served:"), n).alias("goal"), F.lit("served").alias("pred"), F.array(n).alias("args"))


def _nation_facts(s, d):
    base, _ = _nation_rules(s, d)
    rate = adapters.table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("fact"), F.when(F.col("s_acctbal") > 5000, 3.0).otherwise(1.0).alias("a"))
    a = F.coalesce("a", F.lit(9.0))
    return base.join(rate, "fact", "left").select("fact", "pred", "args", F.lit("crisp").alias("stmt_type"), a.alias("epi_a"), F.lit(2.0).alias("epi_b"), F.lit(1.0).alias("alea_a"), F.lit(1.0).alias("alea_b"), F.lit(False).alias("pinned"))


_ONE_SUPPLIER = [("one", "mutex", {"pred": "supplies", "value_position": 0})]


@query("goal_problems", """WITH s AS (SELECT s_nationkey AS n, count(*) AS c FROM supplier GROUP BY s_nationkey)
SELECT 'served:' || n_nationkey AS goal, greatest(1, coalesce(c, 0))::INT AS conjuncts, coalesce(c, 0)::INT AS facts, (coalesce(c, 0) > 0)::INT AS groups, coalesce(c, 0)::INT AS members FROM nation LEFT JOIN s ON n = n_nationkey""")
def _(s, d):
    base, rules = _nation_rules(s, d)
    p = assemble.problems(_nation_goals(s, d), assemble.supports(base, rules), _nation_facts(s, d), _ONE_SUPPLIER)
    return p.select("goal", F.size("dnf").alias("conjuncts"), F.size("facts").alias("facts"), F.size("exclusive").alias("groups"), F.coalesce(F.size(F.get("exclusive", F.lit(0))), F.lit(0)).alias("members"))


@query("predict_derived")
def _(s, d):
    base, rules = _nation_rules(s, d)
    claims = QUERIES["isotonic_fit"](s, d).select("x", "y")
    return assemble.predict_all(_nation_goals(s, d), base, rules, _nation_facts(s, d), knots=claims).drop("mpe", "sensitivity")


def _log(s, d):
    """(events, payloads) of all observations, in order, and a retraction of one source at the end."""
    o = adapters.from_events(s, d)
    said = F.to_json(F.struct("fact", "outcome", "value"))
    rows = o.select(F.col("seq").alias("order"), F.col("ts_ms").alias("ts"), F.lit("observation").alias("kind"), "actor", said.alias("payload"))
    last = s.createDataFrame([(1 << 60, 0, "retraction", "human:operator", '{"actor":"agent:3","restored":"false"}')], "order long, ts long, kind string, actor string, payload string")
    rows = rows.unionByName(last).withColumn("payload_hash", F.sha2(F.col("payload").cast("binary"), 256))
    none = F.lit(None).cast("string")
    events = ledger.chain(rows.select("order", "ts", "kind", "actor", "payload_hash", none.alias("source_ref"), none.alias("context_sig")), ["order"])
    return events, rows.select("payload_hash", "payload").distinct()


def _half(s, d, events):
    n = adapters.table(s, d, "events").count()
    return assemble.snapshot_id(events.where(F.col("seq") == n // 2).head()["hash"] if n > 1 else ledger.GENESIS, assemble.map_hash(None))


@query("counts_at_snapshot", f"WITH {_E}, o AS (SELECT *, row_number() OVER (ORDER BY seq) AS r, count(*) OVER () AS c FROM e) SELECT fact, actor, count(*) AS n, count(*) FILTER (outcome) AS k FROM o WHERE r <= c // 2 AND actor <> 'agent:3' AND outcome IS NOT NULL GROUP BY fact, actor")
def _(s, d):
    events, payloads = _log(s, d)
    obs = assemble.observations(events, payloads, assemble.cutoff_of(events, assemble.parse_snapshot(_half(s, d, events))["ledger_head"]))
    return tallies.fact_counts(obs).drop("channel")


@query("predict_at")
def _(s, d):
    events, payloads = _log(s, d)
    return assemble.predict_at(events, payloads, _half(s, d, events)).drop("mpe", "sensitivity")


@query("conjecture_claims", """WITH c AS (SELECT s_nationkey::VARCHAR AS n, min(s_name) AS a FROM supplier GROUP BY s_nationkey) SELECT 'likely' AS pred, n AS arg, 'supplied' AS via, 0.75::DOUBLE AS predicted_p FROM c WHERE n::INT % 5 <> 0""")
def _(s, d):
    own = adapters.table(s, d, "supplier").select(F.col("s_nationkey").cast("string").alias("n")).distinct()
    args = F.array("n").alias("args")
    found = own.select(F.lit("likely").alias("pred"), args, F.explode(F.array(F.struct(F.lit("supplied").alias("via"), F.lit(0.9).alias("sim")), F.struct(F.lit("other").alias("via"), F.lit(0.4).alias("sim")))).alias("x")).select("pred", "args", "x.via", "x.sim")
    known = own.select(F.lit("supplied").alias("pred"), args, F.lit(0.75).alias("p"), F.lit(0.5).alias("ci_lo"), F.lit(0.9).alias("ci_hi"))
    filed = own.where("cast(n as int) % 5 = 0").select(F.lit("likely").alias("pred"), args, F.lit(assemble.CONJECTURE).alias("predictor_class"), F.lit(False).alias("resolved"))
    return assemble.file_conjectures(found, known, filed, 1).select("pred", F.col("args")[0].alias("arg"), "via", "predicted_p")


@query("statement_lookup", """SELECT n_nationkey::VARCHAR AS nation, (SELECT arg_min('f' || s_suppkey, (CASE WHEN s_suppkey % 2 = 0 THEN 'provides' ELSE 'supplies' END, s_suppkey)) FROM supplier WHERE s_nationkey = n_nationkey) AS fact FROM nation""")
def _(s, d):
    own = adapters.table(s, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "provides").otherwise("supplies").alias("pred"), F.array(F.col("s_nationkey").cast("string")).alias("args"), F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("fact"), F.col("s_suppkey").cast("long").alias("seq"))
    asked = adapters.table(s, d, "nation").select(F.lit("supplies").alias("pred"), F.array(F.col("n_nationkey").cast("string")).alias("args"))
    same = components.alias_members(s.createDataFrame([("provides", "supplies")], "canonical string, alias string"))
    return state.lookup(asked, own, same).select(F.col("args")[0].alias("nation"), "fact")


@query("training_split", "SELECT doc_id, ('0x' || substr(sha256('20260725' || doc_id), 1, 8))::BIGINT % 100 < 50 AS training FROM documents")
def _(s, d):
    return adapters.table(s, d, "documents").select("doc_id", X.in_training("doc_id").alias("training"))


@query("categorical_caveats", f"WITH {_E} SELECT DISTINCT fact, 'under_specified' AS caveat FROM e WHERE fact::INT % 3 <> 0")
def _(s, d):
    o = adapters.from_events(s, d)
    return assemble.under_specified(o, o.where("cast(fact as int) % 3 = 0").select("fact", F.lit("kbin").alias("key")).distinct())


# ---- log

@query("retraction_filter", """WITH e AS (SELECT event_id AS seq, 'agent:' || (event_id % 7) AS actor FROM events), r AS (SELECT 'agent:' || (event_id // 500 % 7) AS actor, event_id AS seq, event_id // 500 % 2 = 1 AS restored FROM events WHERE event_id % 500 = 499),
gone AS (SELECT actor FROM r GROUP BY actor HAVING NOT arg_max(restored, seq)) SELECT actor, count(*) AS n, count(*) FILTER (seq % 500 = 499 OR actor NOT IN (SELECT actor FROM gone)) AS visible FROM e GROUP BY actor""")
def _(s, d):
    e = adapters.table(s, d, "events").select(F.col("event_id").alias("seq"))
    kind = F.when(F.col("seq") % 500 == 499, "retraction").otherwise("observation")
    target = F.concat(F.lit("agent:"), (F.floor(F.col("seq") / 500) % 7).cast("string"))
    body = F.when(kind == "retraction", F.to_json(F.struct(target.alias("actor"), (F.floor(F.col("seq") / 500) % 2 == 1).alias("restored")))).otherwise("{}")
    rows = e.select("seq", kind.alias("kind"), F.concat(F.lit("agent:"), (F.col("seq") % 7).cast("string")).alias("actor"), F.col("seq").cast("string").alias("payload_hash"), body.alias("payload"))
    out = ledger.live(rows.drop("payload"), rows.select("payload_hash", "payload"))
    return out.groupBy("actor").agg(F.count("*").alias("n"), F.count("payload").alias("visible"))


@query("redaction_filter", """WITH h AS (SELECT DISTINCT (event_id // 2)::VARCHAR AS p FROM events WHERE event_id % 300 = 299), n AS (SELECT count(*) // 2 AS cutoff FROM events)
SELECT event_id AS seq, event_id::VARCHAR NOT IN (SELECT p FROM h) AS visible FROM events, n WHERE event_id <= cutoff""")
def _(s, d):
    e = adapters.table(s, d, "events").select(F.col("event_id").alias("seq"))
    body = F.when(F.col("seq") % 300 == 299, F.to_json(F.struct(F.floor(F.col("seq") / 2).cast("string").alias("payload_hash")))).otherwise("{}")
    rows = e.select("seq", F.when(F.col("seq") % 300 == 299, "redaction").otherwise("observation").alias("kind"), F.lit("agent:0").alias("actor"), F.col("seq").cast("string").alias("payload_hash"), body.alias("payload"))
    out = ledger.live(rows.drop("payload"), rows.select("payload_hash", "payload"), cutoff=adapters.table(s, d, "events").count() // 2)
    return out.select("seq", F.col("payload").isNotNull().alias("visible"))


@query("redaction_scope", "SELECT sha256((event_id % 100)::VARCHAR) AS payload_hash, count(*) AS events, array_to_string(list_sort(list(DISTINCT 'agent:' || (event_id % 7))), ',') AS actors FROM events GROUP BY ALL")
def _(s, d):
    e = adapters.table(s, d, "events").select(F.sha2((F.col("event_id") % 100).cast("string").cast("binary"), 256).alias("payload_hash"), F.concat(F.lit("agent:"), (F.col("event_id") % 7).cast("string")).alias("actor"))
    return ledger.redaction_scope(e).withColumn("actors", F.array_join("actors", ","))


@query("latest_pin", f"WITH {_E} SELECT fact, max(seq) AS seq, arg_max(outcome, seq) AS outcome FROM e GROUP BY fact")
def _(s, d):
    return ledger.latest(adapters.from_events(s, d).select("fact", "seq", "outcome"), ["fact"])


@query("statement_asof", """WITH o AS (SELECT event_id AS seq, user_id % 20 AS statement FROM events), a AS (SELECT user_id % 20 AS statement, 'fact:' || (user_id % 60) AS fact, min(event_id) AS from_seq, CASE WHEN user_id % 60 < 20 THEN min(event_id) + 2000 END AS to_seq FROM events GROUP BY user_id % 20, user_id % 60)
SELECT o.seq, statement, arg_min(fact, from_seq) AS fact FROM o LEFT JOIN a USING (statement) WHERE from_seq < seq AND (to_seq IS NULL OR seq <= to_seq) GROUP BY ALL
UNION ALL SELECT seq, statement, NULL FROM o WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.statement = o.statement AND from_seq < seq AND (to_seq IS NULL OR seq <= to_seq))""")
def _(s, d):
    e = adapters.table(s, d, "events")
    o = e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("statement"))
    u = F.col("user_id")
    a = e.groupBy((u % 20).alias("statement"), (u % 60).alias("f")).agg(F.min("event_id").alias("from_seq"))
    a = a.select("statement", F.concat(F.lit("fact:"), F.col("f").cast("string")).alias("fact"), "from_seq", F.when(F.col("f") < 20, F.col("from_seq") + 2000).alias("to_seq"))
    return ledger.as_of(o, a).select("seq", "statement", "fact")


_CHAIN = """WITH RECURSIVE n AS (SELECT n_nationkey + 1 AS seq, n_nationkey * 1000 AS ts, sha256('{"name":"' || n_name || '"}') AS p FROM nation),
ch AS (SELECT 0::BIGINT AS seq, repeat('0', 64) AS h UNION ALL SELECT n.seq::BIGINT, sha256('[' || n.seq || ',' || n.ts || ',"observation","agent:a","' || n.p || '",null,null,"' || ch.h || '"]') FROM ch JOIN n ON n.seq = ch.seq + 1)"""


def _nations(s, d):
    rows = [(r["n_nationkey"] * 1000, "observation", "agent:a", {"name": r["n_name"]}, None, None) for r in adapters.table(s, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows, always
    return s.createDataFrame(ledger.chained(rows)[0], ledger.EVENT)


@query("chain_hash", _CHAIN + " SELECT seq, h AS hash FROM ch WHERE seq > 0")
def _(s, d):
    return _nations(s, d).select("seq", "hash")


@query("chain_verify", "SELECT n_nationkey::BIGINT + 1 AS seq, n_nationkey = 9 AS bad_hash, n_nationkey = 15 AS bad_link, n_nationkey = 15 AS bad_seq FROM nation WHERE n_nationkey IN (9, 15)")
def _(s, d):
    e = _nations(s, d).where("seq <> 15").withColumn("actor", F.when(F.col("seq") == 10, "agent:b").otherwise(F.col("actor")))
    return ledger.verify_links(e).withColumn("bad_link", F.col("bad_link") | F.col("bad_seq"))


def _event_chain(s, d):
    e = adapters.from_events(s, d)
    none = F.lit(None).cast("string")
    body = F.to_json(F.struct("fact", "outcome", "value"), {"ignoreNullFields": "false"})  # canonical: keys in order, no numbers
    rows = e.select("seq", F.col("ts_ms").alias("ts"), F.lit("observation").alias("kind"), "actor", F.sha2(body.cast("binary"), 256).alias("payload_hash"), none.alias("source_ref"), none.alias("context_sig"))
    return ledger.chain(rows, ["seq", "ts", "payload_hash"])


@query("event_chain_hash")
def _(s, d):
    return _event_chain(s, d).select("seq", "hash")


@query("event_chain_verify", "SELECT seq, seq % 1000 = 10 AS bad_hash, seq % 1000 = 16 AS bad_link, seq % 1000 = 16 AS bad_seq FROM (SELECT row_number() OVER (ORDER BY event_id) AS seq FROM events) WHERE seq % 1000 IN (10, 16)")
def _(s, d):
    e = _event_chain(s, d).where("seq % 1000 <> 15").withColumn("actor", F.when(F.col("seq") % 1000 == 10, "agent:b").otherwise(F.col("actor")))
    return ledger.verify_links(e).withColumn("bad_link", F.col("bad_link") | F.col("bad_seq"))


@query("fact_keys", """SELECT s_suppkey, 'fact:' || substr(sha256('["supplies",["' || s_name || '","' || s_nationkey || '"]]'), 1, 32) AS fact FROM supplier""")
def _(s, d):
    t = adapters.table(s, d, "supplier")
    return t.select("s_suppkey", canon.fact_key_of(F.lit("supplies"), F.array("s_name", F.col("s_nationkey").cast("string"))).alias("fact"))


@query("context_signature", f"""WITH {_E} SELECT seq, sha256('[["kbin","' || kbin || '"],["vbin","' || vbin || '"]]') AS sig FROM e""")
def _(s, d):
    return adapters.from_events(s, d).select("seq", canon.context_signature_of("ctx").alias("sig"))


@query("quantity_units", "SELECT p_partkey, (p_size * 1000)::VARCHAR || 'm' AS length FROM part")
def _(s, d):
    return adapters.table(s, d, "part").select("p_partkey", canon.quantity_udf("m")(F.concat_ws(" ", F.col("p_size").cast("string"), F.lit("km"))).alias("length"))


# ---- rules


@query("datalog_reach", """WITH RECURSIVE e AS (SELECT n_nationkey::VARCHAR AS a, ((n_nationkey * 7 + 3) % 25)::VARCHAR AS b FROM nation), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r""")
def _(s, d):
    n = F.col("n_nationkey")
    atoms = adapters.table(s, d, "nation").select(F.lit("edge").alias("pred"), F.array(n.cast("string"), ((n * 7 + 3) % 25).cast("string")).alias("args"))
    L = datalog.Literal
    rules = [datalog.Rule("base", L("reach", ("?x", "?y")), (L("edge", ("?x", "?y")),)), datalog.Rule("step", L("reach", ("?x", "?z")), (L("reach", ("?x", "?y")), L("edge", ("?y", "?z"))))]
    return datalog.closure(atoms, rules).where("pred = 'reach'").select(F.col("args")[0].alias("a"), F.col("args")[1].alias("b"))


@query("negated_rule", "SELECT n_name AS nation FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def _(s, d):
    n = adapters.table(s, d, "nation").select(F.lit("nation").alias("pred"), F.array(F.col("n_nationkey").cast("string"), "n_name").alias("args"))
    p = adapters.table(s, d, "supplier").select(F.lit("supplier").alias("pred"), F.array(F.col("s_nationkey").cast("string"), F.col("s_acctbal").cast("string")).alias("args"))
    L = datalog.Literal
    rules = [
        datalog.Rule("rich", L("rich", ("?n",)), (L("supplier", ("?n", "?b")),), (("?b", ">", "5000"),)),
        datalog.Rule("poor", L("poor", ("?name",)), (L("nation", ("?n", "?name")), L("rich", ("?n",), True))),
    ]
    return datalog.closure(n.unionByName(p), rules).where("pred = 'poor'").select(F.col("args")[0].alias("nation"))


@query("derive_goals", "SELECT n_nationkey::VARCHAR AS nation, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) THEN 'proved' ELSE 'refuted' END AS status FROM nation")
def _(s, d):
    p = adapters.table(s, d, "supplier").select(F.lit("supplier").alias("pred"), F.array(F.col("s_nationkey").cast("string"), F.col("s_acctbal").cast("string")).alias("args"))
    L = datalog.Literal
    closed = datalog.closure(p, [datalog.Rule("rich", L("rich", ("?n",)), (L("supplier", ("?n", "?b")),), (("?b", ">", "5000"),))])
    goals = adapters.table(s, d, "nation").select(F.lit("rich").alias("pred"), F.array(F.col("n_nationkey").cast("string")).alias("args"))
    return datalog.derive(goals, closed).select(F.col("args")[0].alias("nation"), "status")


@query("functional_violation", """WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) SELECT 'line' AS "constraint", '["' || l_orderkey || '","' || l_linenumber || '"]' AS group_key, count(*) AS members FROM a GROUP BY ALL HAVING count(*) > 1""")
def _(s, d):
    a = adapters.table(s, d, "lineitem").select(F.lit("line").alias("pred"), F.array(*[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("args"))
    return constraints.violations(a, [("line", "functional", {"pred": "line"})])


@query("mutex_violation", """WITH a AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')) SELECT 'status' AS "constraint", '["' || o_custkey || '"]' AS group_key, count(*) AS members FROM a GROUP BY ALL HAVING count(*) > 1""")
def _(s, d):
    a = adapters.table(s, d, "orders").select(F.lit("status").alias("pred"), F.array(F.col("o_custkey").cast("string"), "o_orderstatus").alias("args"))
    return constraints.violations(a, [("status", "mutex", {"pred": "status", "exclusive_values": ["F", "O"], "value_position": 1})])


@query("alias_component", """WITH RECURSIVE e AS (SELECT s_name AS a, 'n' || s_nationkey AS b FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS symbol, min(b) AS component FROM r GROUP BY a""")
def _(s, d):
    n = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = adapters.table(s, d, "supplier").select(F.col("s_name").alias("canonical"), n("n", "s_nationkey").alias("alias"))
    return components.alias_members(e.unionByName(adapters.table(s, d, "nation").select(n("n", "n_nationkey").alias("canonical"), n("r", "n_regionkey").alias("alias"))))


@query("alias_union_counts", f"""WITH {_E}, c AS (SELECT CASE WHEN fact::INT % 2 = 0 THEN fact ELSE (fact::INT - 1)::VARCHAR END AS fact, actor, count(*) AS n, count(*) FILTER (outcome) AS k FROM e GROUP BY ALL) SELECT fact, actor, 'alea' AS channel, n, k FROM c""")
def _(s, d):
    c = tallies.fact_counts(adapters.from_events(s, d))
    pair = F.expr("cast(cast(fact as int) - cast(fact as int) % 2 as string)")
    return tallies.alias_counts(c, c.select("fact", pair.alias("component")).distinct())


@query("signature_cosine", """WITH f AS (SELECT DISTINCT s_nationkey::VARCHAR AS symbol, 'r:' || (s_suppkey % 9) || ':0' AS feature FROM supplier), g AS (SELECT symbol, feature, count(*) AS w FROM (SELECT s_nationkey::VARCHAR AS symbol, 'r:' || (s_suppkey % 9) || ':0' AS feature FROM supplier) GROUP BY ALL),
n AS (SELECT symbol, sqrt(sum(w * w)) AS norm FROM g GROUP BY symbol HAVING count(*) >= 2), p AS (SELECT a.symbol, b.symbol AS other, round(sum(a.w * b.w) / any_value(x.norm * y.norm), 6) AS sim FROM g a JOIN g b ON a.feature = b.feature AND a.symbol <> b.symbol JOIN n x ON x.symbol = a.symbol JOIN n y ON y.symbol = b.symbol GROUP BY ALL)
SELECT symbol, other, sim FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sim DESC, other) AS r FROM p WHERE sim >= 0.3) WHERE r <= 16""")
def _(s, d):
    f = adapters.table(s, d, "supplier").select((F.col("s_suppkey") % 9).cast("string").alias("rule"), F.lit(0).alias("position"), F.col("s_nationkey").cast("string").alias("symbol"))
    sig = conjecture.signatures(f)
    near = conjecture.neighbours(sig, None, 0.3, limit=10_000)
    w = Window.partitionBy("symbol").orderBy(F.desc("sim"), "other")
    return _round(near, "sim").withColumn("r", F.row_number().over(w)).where("r <= 16").drop("r")


# ---- text

_TOK = r"""tok AS (SELECT doc_id AS entry, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_.:\-]+'), lambda x: lower(x))) AS t FROM documents),
term AS (SELECT entry, t AS term FROM tok UNION ALL SELECT entry, p FROM (SELECT entry, unnest(regexp_split_to_array(t, '[._:\-]')) AS p FROM tok WHERE regexp_matches(t, '[._:\-]')) WHERE length(p) >= 2),
len AS (SELECT doc_id AS entry, count(term) AS l FROM documents LEFT JOIN term ON entry = doc_id GROUP BY doc_id), post AS (SELECT entry, term, count(*) AS tf FROM term GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
n AS (SELECT count(*) AS n, avg(l) AS avgdl FROM len),
qt AS (SELECT item_id AS query, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_.:\-]+'), lambda x: lower(x))) AS t FROM benchmark),
q AS (SELECT query, term, count(*) AS mix FROM (SELECT query, t AS term FROM qt UNION ALL SELECT query, p FROM (SELECT query, unnest(regexp_split_to_array(t, '[._:\-]')) AS p FROM qt WHERE regexp_matches(t, '[._:\-]')) WHERE length(p) >= 2) GROUP BY ALL),
bm AS (SELECT query, entry, sum(mix * ln(1 + (n.n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * l / avgdl))) AS score FROM q JOIN post USING (term) JOIN df USING (term) JOIN len USING (entry), n GROUP BY query, entry),
rk AS (SELECT query, entry, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, entry) AS rank FROM bm WHERE score > 0)"""


def _corpus(s, d):
    return adapters.wide(adapters.table(s, d, "documents")).select(F.col("doc_id").alias("entry"), "text")


def _questions(s, d):
    return adapters.table(s, d, "benchmark").select(F.col("item_id").alias("query"), "text")


def _bm25(s, d, k):
    bag = checkpointed(retrieval.bags(_corpus(s, d)))
    df, n = retrieval.statistics(bag)
    terms = _questions(s, d).select("query", F.explode(retrieval.tokens(F.coalesce("text", F.lit("")))).alias("term")).withColumn("mix", F.lit(1.0))
    return retrieval.ranked(retrieval.bm25(terms, bag, df, n, k, 6), k), terms, bag, df, n


@query("tokenize_counts", f"WITH {_TOK} SELECT term, sum(tf)::BIGINT AS n FROM post GROUP BY term")
def _(s, d):
    return retrieval.postings(retrieval.bags(_corpus(s, d))).groupBy("term").agg(F.sum("tf").alias("n"))


@query("bm25_topk", f"WITH {_TOK} SELECT query, entry, score, rank::INT AS rank FROM rk WHERE rank <= 10")
def _(s, d):
    return _bm25(s, d, 10)[0]


@query("rm3_terms", f"""WITH {_TOK}, top AS (SELECT query, entry FROM rk WHERE rank <= 10), g AS (SELECT top.query, post.term, sum(tf / l * ln(1 + (n.n - df + 0.5) / (df + 0.5))) AS gain FROM top JOIN post USING (entry) JOIN len USING (entry) JOIN df ON df.term = post.term, n
WHERE length(post.term) >= 3 AND NOT regexp_matches(post.term, '^[0-9]+$') AND NOT EXISTS (SELECT 1 FROM q WHERE q.query = top.query AND q.term = post.term) GROUP BY ALL)
SELECT query, term, 0.4::DOUBLE AS mix FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(gain, 12) DESC, term) AS r FROM g) WHERE r <= 8""")
def _(s, d):
    top, terms, bag, df, n = _bm25(s, d, 10)
    return retrieval.feedback_terms(top, terms, bag, df, n)


@query("rrf_fusion", f"WITH {_TOK}, two AS (SELECT query, entry, rank FROM rk WHERE rank <= 10 UNION ALL SELECT query, entry, row_number() OVER (PARTITION BY query ORDER BY entry) AS rank FROM rk WHERE rank <= 5) SELECT query, entry, round(sum(1 / (60 + rank)), 9) AS score FROM two GROUP BY ALL")
def _(s, d):
    top = _bm25(s, d, 10)[0]
    other = top.where("rank <= 5").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("entry")))
    return _round(retrieval.fuse([top, other]), "score", digits=9)


@query("cosine_topk", """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT query, vec_id AS entry, round(list_sum(list_transform(list_zip(a, embedding::DOUBLE[]), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 6) AS score FROM embeddings, q)
SELECT query, entry, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, entry) AS rank FROM p) WHERE rank <= 10""")
def _(s, d):
    v = adapters.table(s, d, "embeddings").select(F.col("vec_id").alias("entry"), "embedding")
    return retrieval.nearest(v.where("entry % 50 = 0").select(F.col("entry").alias("query"), F.col("embedding").alias("vector")), v, 10)


@query("ranking_metrics", f"""WITH {_TOK}, gold AS (SELECT query, entry FROM rk WHERE rank IN (1, 3, 12)), g AS (SELECT query, count(*) AS g FROM gold GROUP BY query), h AS (SELECT query, count(*) AS h, sum(1 / log2(rank + 1)) AS dcg, max(1 / rank) AS mrr FROM rk JOIN gold USING (query, entry) WHERE rank <= 10 GROUP BY query)
SELECT query, round(h / g, 6) AS recall, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= g), 6) AS ndcg, round(mrr, 6) AS mrr FROM g JOIN h USING (query)""")
def _(s, d):
    r = _bm25(s, d, 12)[0]
    gold = r.where("rank IN (1, 3, 12)").select("query", F.col("entry").alias("item"))
    return _round(calibration.ranking_metrics(r.withColumnRenamed("entry", "item"), gold), "recall", "ndcg", "mrr")


@query("recall_report")
def _(s, d):
    return retrieval.recall(_questions(s, d), _corpus(s, d), budget=2000)
