"""The BCa interval of the hit rate against one drawn item by item."""

from statistics import NormalDist

import numpy as np

from orgweave.operators import metrics

CELLS = {"a": (3, 60), "b": (28, 40), "c": (12, 12), "d": (1, 1)}


def _scores(spark):
    rows = [("s", k, "correct" if i < h else "wrong", f"{k}{i}") for k, (h, n) in CELLS.items() for i in range(n)]
    rows += [("s", "a", "gold_ambiguous", "x"), ("t", "a", "correct", "y"), ("t", "b", "correct", "z")]
    return spark.createDataFrame(rows, "source string, stratum string, outcome string, item_id string")


def _by_item() -> tuple[float, float]:
    groups = [np.array([1.0] * h + [0.0] * (n - h)) for h, n in CELLS.values()]
    r, n = np.random.default_rng(1), sum(map(len, groups))
    drawn = np.sort(sum(g[r.integers(0, len(g), (20_000, len(g)))].sum(axis=1) for g in groups) / n)
    rate, normal = sum(g.sum() for g in groups) / n, NormalDist()
    z0 = normal.inv_cdf(((drawn < rate - 1e-12).mean() + (drawn < rate + 1e-12).mean()) / 2)
    # Leave-one-out rates with the strata's weights kept, as influence on the pooled rate.
    infl = []
    for g in groups:
        for i in range(len(g)) if len(g) > 1 else ():
            infl.append((len(g) - 1) / n * (g.mean() - np.delete(g, i).mean()))
    infl = np.array(infl)
    a = (infl**3).sum() / (6 * (infl**2).sum() ** 1.5)
    at = lambda z: drawn[int(normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) * len(drawn))]
    return at(normal.inv_cdf(0.025)), at(normal.inv_cdf(0.975))


def test_interval_is_stratified_bca(spark):
    got = {r.source: (r.low, r.high, r.resamples) for r in metrics.bootstrap(_scores(spark), ["source"]).collect()}
    low, high = _by_item()
    assert abs(got["s"][0] - low) < 0.012 and abs(got["s"][1] - high) < 0.012 and got["s"][2] == 10_000
    assert got["t"] == (1.0, 1.0, 10_000)
    assert {r.source: (r.low, r.high, r.resamples) for r in metrics.bootstrap(_scores(spark).repartition(7), ["source"]).collect()} == got


def test_no_rows_give_no_interval(spark):
    assert metrics.bootstrap(_scores(spark).limit(0), ["source"]).count() == 0
