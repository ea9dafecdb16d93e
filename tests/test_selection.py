"""Quantiles by selection against numpy, k-means by aggregates against the helper."""

from __future__ import annotations

import math

import numpy as np
import pytest

from flowrhythm.operators import quantiles as Q
from flowrhythm.operators import tune

PROBS = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)


def groups():
    r = np.random.default_rng(3)
    return {
        "normal": r.normal(0, 1, 4000), "ties": r.integers(0, 3, 3000).astype(float), "one": np.full(2500, 7.25), "wide": r.normal(0, 1, 2000) * 10.0 ** r.integers(-300, 300, 2000), "few": r.normal(5, 1, 37),
        "mostly": np.concatenate([np.full(2600, 1.5), r.normal(0, 1, 900)]), "bad": np.array([np.nan, np.inf, -np.inf, 3.0, 4.0]), "none": np.array([np.nan]),
    }


@pytest.mark.parametrize("small", (10_000, 900))
def test_quantiles_are_those_of_numpy(spark, monkeypatch, small):
    monkeypatch.setattr(Q, "CUTS", 8)
    made = groups()
    rows = spark.createDataFrame([(g, float(x)) for g, v in made.items() for x in v] + [("few", None)], "metric string, value double").repartition(5)
    got = {r.metric: r for r in Q.quantiles(rows, ("metric",), "value", PROBS, small).collect()}
    assert set(got) == set(made) - {"none"}
    for g, r in got.items():
        x = made[g][np.isfinite(made[g])]
        assert (r.n, r.least, r.greatest) == (len(x), x.min(), x.max())
        assert np.allclose(r.p, np.quantile(x, PROBS), rtol=1e-12, atol=1e-300), g


def test_rounds_equal_the_helper(spark, monkeypatch):
    monkeypatch.setattr(Q, "SMALL", 700)
    r = np.random.default_rng(4)
    made = {"b": r.integers(0, 4, 900).astype(float), "c": np.concatenate([r.normal(m, 0.2, 400) for m in (0, 5, 9)]), "d": np.full(50, 2.0), "f": np.repeat([1.0, 2.0, 3.0], [480, 60, 9]), "e": r.exponential(3, 800)}
    rows = spark.createDataFrame([("x", m, float(v)) for m, vs in made.items() for v in vs], "who string, metric string, value double").repartition(4)
    for strategy in ("spread", "variance"):
        for row in tune.rounds(rows, ("who",), strategy).collect():
            x = made[row.metric]
            c, n = tune.clusters(x)
            lo, mid = tune.bounds(c)
            want = [*c, lo, mid, *np.quantile(x, (0.1, 0.5, 0.9)), {"spread": np.quantile(x, 0.9) - np.quantile(x, 0.1), "variance": x.var()}.get(strategy, 1.0)]
            assert np.allclose([row.c1, row.c2, row.c3, row.lo, row.mid, row.p10, row.p50, row.p90, row.measure], want, rtol=1e-9, atol=1e-9), (row.metric, strategy)
            assert (row.n1, row.n2, row.n3) == tuple(n)


def test_tuning_by_either_way_is_equal(spark, monkeypatch):
    r = np.random.default_rng(5)
    daily = spark.createDataFrame([(int(k), float(r.normal()), None if k % 3 else float(r.exponential()), float("inf") if k % 5 == 0 else float(k % 7)) for k in range(300)], "day int, m1 double, m2 double, m3 double")
    metrics = {"m1": True, "m2": False, "m3": True}
    key = lambda df: {x.metric: [round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in x] for x in df.select(sorted(df.columns)).collect()}
    want = key(tune.auto_tune(daily, metrics))
    monkeypatch.setattr(tune, "SMALL", 120)
    assert key(tune.auto_tune(daily, metrics)) == want
