"""Steps whose memory, time and results must not hang on the size of a table or on how it is split."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from flowrhythm.operators import quantiles as Q
from flowrhythm.operators import score
from flowrhythm.plans import queries
from flowrhythm.sources import views

SPEC = [("C1", "a", 0.5, "tri", 0.0, 1.0, 3.0, False), ("C1", "b", 0.6, "clip", None, None, None, None), ("C2", "a", 0.7, "tri", float("-inf"), 0.0, 2.0, True), ("C2", "gone", 0.9, "tri", 0.0, 1.0, 2.0, False)]


def lineitem(folder, files: int = 3, groups: int = 200):
    """A row of each group in each file; the last file is the largest, and Spark takes large ones first."""
    r = np.random.default_rng(6)
    discount = r.integers(0, 11, (files, groups)) / 100
    at = folder / "lineitem.parquet"
    at.mkdir()
    for k in range(files):
        more = {"l_comment": ["".join(map(chr, r.integers(97, 123, 1 + 200 * k))) for _ in range(groups)]}
        days = np.full(groups, np.datetime64("1996-01-01", "us"))
        pq.write_table(pa.table({"l_suppkey": np.arange(groups), "l_shipdate": days, "l_quantity": np.full(groups, 30.0), "l_discount": discount[k], "l_returnflag": ["R"] * groups} | more), at / f"part-{k}.parquet")
    return discount


def test_repeated_values_are_counted_and_not_selected(spark, monkeypatch):
    monkeypatch.setattr(Q, "_selected", lambda *a: pytest.fail("few different values need no selection"))
    x = np.random.default_rng(7).integers(0, 9, 4000).astype(float)
    row = Q.quantiles(spark.createDataFrame([("m", float(v)) for v in x], "metric string, value double"), ("metric",), "value", (0.25, 0.5, 0.9), 100).first()
    assert row.n == 4000 and np.allclose(row.p, np.quantile(x, (0.25, 0.5, 0.9)))


def test_group_scores_need_no_shuffle(spark):
    daily = spark.createDataFrame([("x", 2.0, 0.25), (None, 1.0, 9.0), ("y", None, None)], "k string, a double, b double")
    spec = spark.createDataFrame(SPEC, score.SPEC)
    found = score.group_scores(daily, spec, ("k",), ("C1", "C2", "C3"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.k: (round(r.L_C1, 6), round(r.L_C2, 6), r.L_C3) for r in found.collect()} == {"x": (0.4, 0.7, 0.0), None: (1.0, 0.35, 0.0), "y": (0.0, 0.0, 0.0)}
    each = score.contributions(daily, spec, ("k",))
    assert "Join" not in each._jdf.queryExecution().executedPlan().toString() and each.count() == 9


def test_daily_sums_are_in_the_order_of_the_files(spark, tmp_path):
    discount = lineitem(tmp_path)
    want = {k: ((0.0 + a) + b + c) / 3 for k, (a, b, c) in enumerate(discount.T.tolist())}
    for how in ({}, {"by_entity": True}):
        assert {r.entity: r.m3 for r in views.daily_view(spark, str(tmp_path), **how).collect()} == want


def test_tasks_of_the_daily_view_grow_in_number(spark, tmp_path, monkeypatch):
    lineitem(tmp_path)
    monkeypatch.setattr(views, "ROWS", 20)
    for name in ("group_scores", "presence_flags", "history_metrics"):
        assert queries.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 30, name
