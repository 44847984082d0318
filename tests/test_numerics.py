import math

import numpy as np
import pytest

from attesta.functions import canon, special
from attesta.operators import predict


def test_beta_closed_forms():
    x = np.linspace(0, 1, 21)
    assert np.allclose(special.beta_cdf(x, 1, 1), x, atol=1e-14)
    assert np.allclose(special.beta_cdf(x, 3.5, 1), x**3.5, atol=1e-13)
    assert np.allclose(special.beta_cdf(x, 1, 4), 1 - (1 - x) ** 4, atol=1e-13)
    for a, b in ((0.5, 9.5), (99, 1), (2, 3), (400, 700)):
        q = np.array([0.05, 0.5, 0.95])
        assert np.allclose(special.beta_cdf(special.beta_quantile(q, a, b), a, b), q, atol=1e-9)
    g = special.quantile_grid(9.5, 0.5, 64)
    assert (np.diff(g) > 0).all() and abs(g.mean() - 0.95) < 0.01


def test_tests():
    assert special.fisher_p(8, 8, 0, 8) == pytest.approx(2 / math.comb(16, 8))
    assert special.fisher_p(4, 8, 4, 8) == pytest.approx(1.0)
    assert special.fisher_p(0, 0, 3, 4) == 1.0
    assert special.tarone([10], [3]) is None and special.tarone([10, 10], [0, 0]) is None
    assert special.tarone([10, 10], [10, 0]) > 3
    p = special.tarone_p([20, 20, 20], [18, 2, 10])
    assert p < 0.01 and p == special.tarone_p([20, 20, 20], [10, 2, 18])


def test_canonical_forms():
    assert canon.canon_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    with pytest.raises(canon.CanonicalError):
        canon.canon_json(float("nan"))
    assert canon.quantity("100 °C", "K") == "373.15K" and canon.quantity("212F", "C") == "100C" and canon.quantity("-0 m", "km") == "0km"
    for bad, to in (("5 parsecs", "m"), ("5 kg", "m"), ("m", "m")):
        with pytest.raises(canon.CanonicalError):
            canon.quantity(bad, to)
    assert canon.canonical_args([" a ", "1 km", 3], {"1": "m"}) == ["a", "1000m", 3]
    assert canon.fact_key("p", ["a"]) != canon.fact_key("p", ["b"]) and len(canon.fact_key("p", [1])) == 37
    assert canon.context_signature({"b": "1", "a": "2"}) == canon.context_signature({"a": "2", "b": "1"}) and canon.context_signature({}) is None


def test_solve():
    rate = {"stmt_type": "frequency", "epi": (99.0, 1.0), "alea": (9.0, 3.0)}
    one = predict.solve([["f"]], {"f": rate})
    assert one["ci_lo"] < one["p"] < one["ci_hi"] and abs(one["p"] - 0.7425) < 0.02 and abs(one["sensitivity"]["f"] - 0.75) < 0.02
    assert predict.solve([["f"]], {"f": rate}) == one
    pinned = predict.solve([["f"]], {"f": rate | {"pinned": True}})
    assert pinned["p"] == 0 and pinned["mpe"] == {"f": 0}
    crisp = lambda yes, no: {"stmt_type": "crisp", "epi": (1.0, 1.0), "votes": [{"actor": "a", "vote": True, "count": yes, "sig": None}, {"actor": "b", "vote": False, "count": no, "sig": None}]}
    assert predict.solve([["x"]], {"x": crisp(3, 1)})["p"] > 0.9 > 0.1 > predict.solve([["x"]], {"x": crisp(1, 3)})["p"]
    both = predict.solve([["f"], ["g"]], {"f": rate, "g": rate})
    assert both["p"] > one["p"]
    split = predict.solve([["f"]], {"f": rate, "g": rate}, exclusive=[["f", "g"]])
    assert split["rejected"] > 0.9 and sum(split["mpe"].values()) == 1


def test_mass_of_many_conjuncts():
    p = {f"f{i}": np.full(4, 0.5) for i in range(20)}
    assert np.allclose(predict.mass([["f0", "f1"], ["f1", "f2"]], p, 4), 0.375)
    assert np.allclose(predict.mass([], p, 4), 0)
    assert (predict.mass([[f"f{i}"] for i in range(20)], p, 4) > 0.999).all()


def test_permutation_depends_on_the_tag():
    a = predict.permutation("a", 64)
    assert sorted(a.tolist()) == list(range(64)) and a.tolist() != predict.permutation("b", 64).tolist()
    assert predict.samples_for(10) == 64 and predict.samples_for(300) == 300 and predict.samples_for(5000) == 512
