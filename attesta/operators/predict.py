"""Probabilities of goals by stratified sampling of the facts that support them, one row a goal.

A problem row has its supports (an array of sets of facts), the state of each fact (type, validity and rate parameters, pin, votes by class with counts) and groups of mutually
exclusive facts. Rows are independent; a batch of them runs in numpy. Votes arrive aggregated by class, so a fact with very many has few entries.
"""

from __future__ import annotations

import functools
import sys
from collections import Counter
from collections.abc import Iterable
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import expressions as E
from attesta.functions.special import beta_quantile
from attesta.sources.shared import spread

SAMPLES, LEAST, EXACT, GAMMA = 512, 64, 12, 0.5
EPI_PRIOR = {"crisp": (1.0, 1.0), "frequency": (99.0, 1.0)}
#: Numbers by node and world that are held at a time.
BLOCK = 1 << 20


def samples_for(budget: int) -> int:
    return max(LEAST, min(SAMPLES, budget)) if budget < 1000 else SAMPLES


class _Kept(dict):
    """What was made lately, bounded by entries."""

    def __init__(self, most: int):
        self.most = most

    def add(self, keys, values) -> None:
        if len(self) + len(keys) > self.most:
            self.clear()
        self.update(zip(keys, values, strict=True))


_SHUFFLES, _GRIDS = _Kept(8_192), _Kept(4_096)


def permutations(tags: list[str], n: int) -> np.ndarray:
    """(tags, n): a shuffle of n for each tag that depends on the tag only; all tags take each of the n steps together."""
    m = len(tags)
    order = np.tile(np.arange(n, dtype=np.uint16 if n <= 1 << 16 else np.int64), (m, 1))
    state = np.array([int.from_bytes(sha256(t.encode()).digest()[:8], "big") for t in tags], np.uint64)
    rows = np.arange(m)
    for i in range(n - 1, 0, -1):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        z = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        j = ((z ^ (z >> np.uint64(31))) % np.uint64(i + 1)).astype(np.int64)
        here = order[:, i].copy()
        order[:, i] = order[rows, j]
        order[rows, j] = here
    return order


def permutation(tag: str, n: int) -> np.ndarray:
    if (tag, n) not in _SHUFFLES:
        _SHUFFLES.add([(tag, n)], permutations([tag], n))
    return _SHUFFLES[tag, n]


def grids(pairs: list[tuple[float, float]], n: int) -> np.ndarray:
    """(pairs, n): quantile_grid() of all of them at once."""
    a, b = np.array(pairs, float).reshape(-1, 2).T
    return beta_quantile(((np.arange(n) + 0.5) / n)[None, :], a[:, None], b[:, None])


def _grid(a: float, b: float, n: int) -> np.ndarray:
    if (a, b, n) not in _GRIDS:
        _GRIDS.add([(a, b, n)], grids([(a, b)], n))
    return _GRIDS[a, b, n]


def _prepare(tags: set[str], pairs: set[tuple[float, float]], n: int) -> None:
    """Make the shuffles and grids of a batch of problems together, before they are asked for one by one."""
    tags, pairs = sorted(t for t in tags if (t, n) not in _SHUFFLES), sorted(p for p in pairs if (*p, n) not in _GRIDS)
    if tags:
        _SHUFFLES.add([(t, n) for t in tags], permutations(tags, n))
    if pairs:
        _GRIDS.add([(*p, n) for p in pairs], grids(pairs, n))


#: Problems, and facts of them, whose shuffles and grids are made together.
TOGETHER, FACTS = 256, 2048


def _parts(pdf: pd.DataFrame):
    for a in range(0, len(pdf), TOGETHER):
        yield pdf.iloc[a : a + TOGETHER]


def _by_facts(pdf: pd.DataFrame):
    """Problems in parts of up to TOGETHER, with up to FACTS facts unless one has more."""
    begin = facts = 0
    for i, n in enumerate(map(len, pdf.facts)):
        if i > begin and (i - begin == TOGETHER or facts + n > FACTS):
            yield pdf.iloc[begin:i]
            begin, facts = i, 0
        facts += n
    yield pdf.iloc[begin:]


def _others(xs: list[np.ndarray]) -> list[np.ndarray]:
    """For each of xs the product of all others."""
    out, run = [], 1.0
    for x in xs:
        out.append(run)
        run = run * x
    run = 1.0
    for i in range(len(xs) - 1, -1, -1):
        out[i] = out[i] * run
        run = run * xs[i]
    return out


def _apart(conjuncts: frozenset) -> list[frozenset]:
    """Conjuncts in sets that share no fact."""
    parent: dict[str, str] = {}

    def root(f):
        while parent[f] != f:
            parent[f] = f = parent[parent[f]]
        return f

    for c in conjuncts:
        first, *rest = sorted(c)
        parent.setdefault(first, first)
        for f in rest:
            parent[root(parent.setdefault(f, f))] = root(first)
    sets: dict[str, list] = {}
    for c in conjuncts:
        sets.setdefault(root(min(c)), []).append(c)
    return [frozenset(s) for _, s in sorted((min(min(c) for c in s), s) for s in sets.values())]


class Chance:
    """Probability that some conjunct of a disjunction holds, of facts that are independent: exact for any number of conjuncts.

    Conjuncts without a common fact are independent. Those that share facts are told apart by the fact that most of them have, with it and without it, and what is left is treated
    alike; a few with more common facts than conjuncts by inclusion and exclusion. Time and nodes are linear where few facts are shared; in the worst case, as with any exact method, they are exponential in
    the shared facts of one set. The nodes are made once; worlds run through them in blocks of bounded size."""

    def __init__(self, dnf: Iterable[Iterable[str]]):
        self.nodes: list[tuple] = []
        self.seen: dict[frozenset, int] = {}
        dnf = frozenset(map(frozenset, dnf))
        facts = set().union(*dnf)
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 4 * len(facts)))
        self.top = self._some(dnf)
        self.step = max(1, BLOCK // len(self.nodes))

    def _add(self, *node) -> int:
        self.nodes.append(node)
        return len(self.nodes) - 1

    def _some(self, conjuncts: frozenset) -> int:
        if frozenset() in conjuncts:
            return self._add("all", ())
        parts = [self._part(s) for s in _apart(conjuncts)]
        return parts[0] if len(parts) == 1 else self._add("some", parts)

    def _part(self, own: frozenset) -> int:
        if own not in self.seen:
            times = Counter(f for c in own for f in c)
            shared = sum(m > 1 for m in times.values())
            if len(own) == 1:
                node = self._add("all", tuple(sorted(*own)))
            elif len(own) <= EXACT and shared >= len(own):
                every = sorted(map(sorted, own))
                picks = ([c for i, c in enumerate(every) if pick >> i & 1] for pick in range(1, 1 << len(every)))
                node = self._add("sum", [(1 if len(c) % 2 else -1, tuple(sorted(set().union(*c)))) for c in picks])
            else:
                f = min(times, key=lambda f: (-times[f], f))
                node = self._add("if", f, self._some(frozenset(c - {f} for c in own)), self._some(frozenset(c for c in own if f not in c)))
            self.seen[own] = node
        return self.seen[own]

    def _run(self, p: dict[str, np.ndarray], at: slice, n: int) -> list[np.ndarray]:
        zero, one = np.zeros(n), np.ones(n)
        get = lambda f: p[f][at] if f in p else zero
        product = lambda fs: functools.reduce(np.multiply, map(get, fs), one)
        out: list[np.ndarray] = []
        for kind, *x in self.nodes:
            if kind == "all":
                out.append(product(x[0]))
            elif kind == "some":
                out.append(1 - functools.reduce(np.multiply, (1 - out[i] for i in x[0]), one))
            elif kind == "if":
                f = get(x[0])
                out.append(f * out[x[1]] + (1 - f) * out[x[2]])
            else:
                out.append(sum(sign * product(fs) for sign, fs in x[0]))
        return out

    def _blocks(self, n: int):
        return ((slice(a, min(n, a + self.step)), min(n, a + self.step) - a) for a in range(0, n, self.step))

    def value(self, p: dict[str, np.ndarray], n: int) -> np.ndarray:
        return np.concatenate([self._run(p, at, m)[self.top] for at, m in self._blocks(n)])

    def slopes(self, p: dict[str, np.ndarray], n: int):
        """(worlds, by fact the difference that it makes to be true or false), by block: one pass back through the nodes for all facts."""
        for at, m in self._blocks(n):
            value, zero = self._run(p, at, m), np.zeros(m)
            get = lambda f: p[f][at] if f in p else zero  # noqa: B023, E731
            own: list = [0.0] * len(self.nodes)
            own[self.top] = np.ones(m)
            out: dict[str, np.ndarray] = {}

            def add(fs, g):
                for f, d in zip(fs, _others([get(f) for f in fs]), strict=True):  # noqa: B023
                    out[f] = out.get(f, zero) + g * d  # noqa: B023

            for i in range(len(self.nodes) - 1, -1, -1):
                (kind, *x), g = self.nodes[i], own[i]
                own[i] = None
                if kind == "all":
                    add(x[0], g)
                elif kind == "some":
                    for k, d in zip(x[0], _others([1 - value[k] for k in x[0]]), strict=True):
                        own[k] = own[k] + g * d
                elif kind == "if":
                    f, yes, no = x
                    out[f] = out.get(f, zero) + g * (value[yes] - value[no])
                    own[yes], own[no] = own[yes] + g * get(f), own[no] + g * (1 - get(f))
                else:
                    for sign, fs in x[0]:
                        add(fs, sign * g)
            yield at, out


def mass(dnf: list[list[str]], p: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Probability that some conjunct holds, by world."""
    return Chance(dnf).value(p, n)


def _logodds(votes: list[dict], rates: dict[str, tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    out, groups = np.zeros(n), {}
    for v in votes:
        if v.get("log_lr") is not None:
            lr = np.full(n, v["log_lr"])
        else:
            s, f = (np.clip(x, E.EPSILON, 1 - E.EPSILON) for x in rates[v["actor"]])
            lr = np.log(s / f) if v["vote"] else np.log((1 - s) / (1 - f))
        lr = lr * min(1.0, max(0.0, v.get("weight", 1.0))) * v["count"]
        if v.get("sig") is None:
            out = out + lr
        else:
            g = groups.setdefault(v["sig"], [np.zeros(n), 0])
            g[0] = g[0] + lr
            g[1] += v["count"]
    return out + sum((g / m**GAMMA for g, m in groups.values()), np.zeros(n))


def solve(dnf: list[list[str]], facts: dict[str, dict], exclusive: Iterable[list[str]] = (), confusion: dict[str, tuple[int, int, int, int]] | None = None, samples: int = SAMPLES) -> dict:
    """p, interval, epistemic and aleatoric parts, sensitivity by fact, most probable assignment and share of rejected worlds.

    facts: by id {stmt_type, epi (a, b), alea (a, b), pinned, votes}.
    """
    n, rates = samples, {}
    for actor in sorted({v["actor"] for st in facts.values() for v in st.get("votes") or ()}):
        tp, fn, fp, tn = (confusion or {}).get(actor, (0, 0, 0, 0))
        rates[actor] = (_grid(E.SENS_PRIOR[0] + tp, E.SENS_PRIOR[1] + fn, n)[permutation(actor + "|sens", n)], _grid(E.FPR_PRIOR[0] + fp, E.FPR_PRIOR[1] + tn, n)[permutation(actor + "|fpr", n)])
    truth, theta, cont, both = {}, {}, {}, {}
    zero, one, steps = np.zeros(n), np.ones(n), (np.arange(n) + 0.5) / n
    for f, st in facts.items():
        u = steps[permutation(f + "|bernoulli", n)]
        if st.get("pinned"):
            truth[f] = theta[f] = cont[f] = zero
        elif st["stmt_type"] == "crisp" and st.get("votes"):
            p = 1 / (1 + np.exp(-np.clip(_logodds(st["votes"], rates, n), -60, 60)))
            truth[f], theta[f], cont[f] = (u < p).astype(float), one, p
        else:
            valid = _grid(*map(float, st["epi"]), n)[permutation(f + "|validity", n)]
            truth[f] = (u < valid).astype(float)
            rate = st["stmt_type"] == "frequency"
            theta[f] = _grid(*map(float, st["alea"]), n)[permutation(f + "|rate", n)] if rate else one
            cont[f] = theta[f] if rate else valid
        both[f] = truth[f] if theta[f] is one else truth[f] * theta[f]
    groups = [g for g in ([f for f in g if f in facts] for g in exclusive) if len(g) > 1]
    ok = np.ones(n, bool)
    for g in groups:
        ok &= sum(truth[f] for f in g) <= 1
    mean = {f: st["epi"][0] / (st["epi"][0] + st["epi"][1]) for f, st in facts.items()}
    mpe = {f: int(not st.get("pinned") and mean[f] >= 0.5) for f, st in facts.items()}
    for g in groups:
        on = [f for f in g if mpe[f]]
        best = max(on, key=mean.__getitem__, default=None)
        for f in on:
            mpe[f] = int(f == best)
    if not ok.any():
        return {"p": 0.0, "ci_lo": 0.0, "ci_hi": 0.0, "epistemic": 0.0, "aleatoric": 0.0, "rejected": 1.0, "tension": True, "sensitivity": {}, "mpe": {}}
    chance = Chance(dnf)
    got, smooth = chance.value(both, n)[ok], chance.value(cont, n)[ok]
    lo, hi = np.quantile(smooth, [0.05, 0.95])
    p = got.mean()
    if not lo <= p <= hi:
        p = min(hi, max(lo, smooth.mean()))
    sens = {f: 0.0 for f in sorted({f for c in dnf for f in c} & set(facts))}
    for at, slope in chance.slopes(both, n):
        for f in sens:
            sens[f] += float((theta[f][at] * slope.get(f, 0.0))[ok[at]].sum())
    sens = {f: abs(x) / int(ok.sum()) for f, x in sens.items()}
    rated = any(st["stmt_type"] == "frequency" for st in facts.values())
    return {"p": float(p), "ci_lo": float(lo), "ci_hi": float(hi), "epistemic": float(got.std()), "aleatoric": float(chance.value(theta, n)[ok].mean()) if rated else 0.0, "rejected": float(1 - ok.mean()), "tension": False, "sensitivity": sens, "mpe": mpe}


RESULT = "goal string, p double, ci_lo double, ci_hi double, epistemic double, aleatoric double, rejected double, tension boolean, sensitivity map<string,double>, mpe map<string,int>"


def predict_frequency(composed: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """RESULT of every fact as its own goal, from composed counts (fact, epi_a, epi_b, alea_n, alea_k)."""

    def run(frames):
        q = (np.arange(samples) + 0.5) / samples
        a, b = EPI_PRIOR["frequency"]
        for whole in frames:
            for pdf in _parts(whole):
                m = len(pdf)
                epi = np.stack([a + pdf.epi_a.to_numpy(float), b + pdf.epi_b.to_numpy(float)], 1)
                alea = np.stack([1 + pdf.alea_k.to_numpy(float), 1 + np.maximum(0.0, pdf.alea_n.to_numpy(float) - pdf.alea_k.to_numpy(float))], 1)
                shuffles = permutations([f + t for f in pdf.fact for t in ("|bernoulli", "|validity", "|rate")], samples).reshape(m, 3, samples)
                both, at = np.unique(np.concatenate((epi, alea)), axis=0, return_inverse=True)
                made = grids(both, samples)
                valid, rate = made[at.ravel()[:m]], made[at.ravel()[m:]]
                truth = q[shuffles[:, 0]] < np.take_along_axis(valid, shuffles[:, 1], 1)
                theta = np.take_along_axis(rate, shuffles[:, 2], 1)
                got = truth * theta
                lo, hi = np.quantile(theta, [0.05, 0.95], axis=1)
                p, mean = got.mean(1), theta.mean(1)
                p = np.where((lo <= p) & (p <= hi), p, np.minimum(hi, np.maximum(lo, mean)))
                on = epi[:, 0] / epi.sum(1) >= 0.5
                yield pd.DataFrame({"goal": pdf.fact.to_numpy(), "p": p, "ci_lo": lo, "ci_hi": hi, "epistemic": got.std(1), "aleatoric": mean, "rejected": 0.0, "tension": False, "sensitivity": [{f: v} for f, v in zip(pdf.fact, mean.tolist(), strict=True)], "mpe": [{f: int(v)} for f, v in zip(pdf.fact, on.tolist(), strict=True)]})

    return spread(composed, "fact").mapInPandas(run, RESULT)


def predict_crisp(votes: DataFrame, confusion: DataFrame, log_lr: DataFrame | None = None, samples: int = SAMPLES) -> DataFrame:
    """RESULT of every crisp fact from its votes (fact, actor, vote, grade, sig), by class; graded votes take a learned ratio (actor, vote, grade, log_lr) where there is one."""
    classes = votes.groupBy("fact", "actor", "vote", "grade", "sig").agg(F.count("*").alias("count"))
    if log_lr is not None:
        classes = classes.join(log_lr.where("grade > 0").select("actor", "vote", "grade", "log_lr"), ["actor", "vote", "grade"], "left")
    else:
        classes = classes.withColumn("log_lr", F.lit(None).cast("double"))
    cells = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fn", "fp", "tn")]
    known = classes.join(confusion, "actor", "left").select("fact", F.struct("actor", "vote", "sig", "count", "log_lr", *cells).alias("v"))
    rows = known.groupBy("fact").agg(F.array_sort(F.collect_list("v")).alias("votes"))

    def run(frames):
        for pdf in (x for whole in frames for x in _parts(whole)):
            _prepare({f + "|bernoulli" for f in pdf.fact}, set(), samples)
            out = []
            for fact, votes in zip(pdf.fact, pdf.votes, strict=True):
                vs = [v if isinstance(v, dict) else v.asDict() for v in votes]
                conf = {v["actor"]: (v["tp"], v["fn"], v["fp"], v["tn"]) for v in vs}
                st = {"stmt_type": "crisp", "epi": EPI_PRIOR["crisp"], "votes": vs}
                out.append({"goal": fact} | solve([[fact]], {fact: st}, confusion=conf, samples=samples))
            yield pd.DataFrame(out)

    return spread(rows, "fact").mapInPandas(run, RESULT)


def predict_goals(problems: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """RESULT of goals with several supports: problems (goal, dnf array<array<string>>, facts array<struct<fact, stmt_type, epi_a, epi_b, alea_a, alea_b, pinned[, votes]>>, exclusive array<array<string>>).

    votes: array<struct<actor, vote, sig, count, log_lr, tp, fn, fp, tn>>, by class as predict_crisp() makes them."""

    def run(frames):
        for pdf in (x for whole in frames for x in _by_facts(whole)):
            get = lambda f, k: f[k] if isinstance(f, dict) else getattr(f, k)
            every = [f for fs in pdf.facts for f in fs]
            said = ((f.get("votes") if isinstance(f, dict) else getattr(f, "votes", None)) for f in every)
            actors = {get(v, "actor") for votes in said if votes is not None for v in votes}
            _prepare({get(f, "fact") + t for f in every for t in ("|bernoulli", "|validity", "|rate")} | {a + t for a in actors for t in ("|sens", "|fpr")}, {(float(get(f, x)), float(get(f, y))) for f in every for x, y in (("epi_a", "epi_b"), ("alea_a", "alea_b"))}, samples)
            out = []
            for r in pdf.itertuples():
                facts, conf = {}, {}
                for f in r.facts:
                    f = f if isinstance(f, dict) else f.asDict()
                    votes = [v if isinstance(v, dict) else v.asDict() for v in (f.get("votes") if f.get("votes") is not None else ())]
                    conf |= {v["actor"]: (v["tp"], v["fn"], v["fp"], v["tn"]) for v in votes}
                    facts[f["fact"]] = {"stmt_type": f["stmt_type"], "epi": (f["epi_a"], f["epi_b"]), "alea": (f["alea_a"], f["alea_b"]), "pinned": f["pinned"], "votes": votes}
                out.append({"goal": r.goal} | solve([list(c) for c in r.dnf], facts, [list(g) for g in r.exclusive], conf, samples))
            yield pd.DataFrame(out)

    return spread(problems, "goal").mapInPandas(run, RESULT)


def mpe(facts: DataFrame) -> DataFrame:
    """(fact, holds): facts (fact, group_key, a, b, pinned) with mean validity of at least a half, the best one of each exclusive group."""
    mean = F.col("a") / (F.col("a") + F.col("b"))
    on = facts.withColumn("on", (mean >= 0.5) & ~F.col("pinned"))
    w = Window.partitionBy("group_key", "on").orderBy(F.desc(mean), "fact")
    return on.withColumn("r", F.row_number().over(w)).select("fact", (F.col("on") & (F.col("group_key").isNull() | (F.col("r") == 1))).alias("holds"))


def rate_interval(counts: DataFrame) -> DataFrame:
    """counts (fact, n, k) with the posterior mean and its 5 and 95 per cent points, in closed form."""

    def run(frames):
        for pdf in frames:
            a, b = 1.0 + pdf.k.to_numpy(float), 1.0 + (pdf.n - pdf.k).to_numpy(float)
            yield pdf.assign(p=a / (a + b), ci_lo=beta_quantile(0.05, a, b), ci_hi=beta_quantile(0.95, a, b))

    return counts.select("fact", "n", "k").mapInPandas(run, "fact string, n long, k long, p double, ci_lo double, ci_hi double")
