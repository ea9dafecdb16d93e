"""Automatic memberships and weights from the data: one-dimensional k-means for each metric of an entity.

Metrics of up to SMALL values are clustered by a vectorised helper, a group at a time. Larger ones
are tables of different values and their counts, and each round is one aggregate over
them: sums and counts on either side of the midpoints between centers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrhythm.functions.network import finite
from flowrhythm.operators.quantiles import BROADCAST_ROWS, quantiles
from flowrhythm.operators.status import melt
from flowrhythm.sources.scratch import written

#: Clusters, their starting quantiles, rounds; below LEAST values fixed quantiles are taken instead.
STARTS, SPARSE, ROUNDS, LEAST = (0.15, 0.5, 0.85), (0.2, 0.5, 0.8), 100, 5
#: Values of a metric that one task holds.
SMALL = 1_000_000
OUT = "metric string, c1 double, c2 double, c3 double, n1 long, n2 long, n3 long, lo double, mid double, p10 double, p50 double, p90 double, measure double"


def clusters(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centers in order, values of each) of the values; without any, zeros."""
    if not len(x):
        return np.zeros(3), np.zeros(3, int)
    if len(x) < LEAST:
        c = np.quantile(x, SPARSE)
        return c, np.bincount(np.abs(x[:, None] - c).argmin(1), minlength=3)
    c = np.quantile(x, STARTS)
    for _ in range(ROUNDS):
        own = ((x[:, None] - c) ** 2).argmin(1)
        n = np.bincount(own, minlength=3)
        new = np.where(n > 0, np.bincount(own, x, 3) / np.maximum(n, 1), c)
        done = np.allclose(new, c, rtol=1e-5, atol=1e-8)
        c = new
        if done:
            break
    order = np.argsort(c, kind="stable")
    return c[order], n[order]


def bounds(c: np.ndarray) -> tuple[float, float]:
    """Midpoints between the centers; where they fall together, the median and a little to both sides."""
    a, b = (c[0] + c[1]) / 2, (c[1] + c[2]) / 2
    if a < b:
        return float(a), float(b)
    eps = max(1e-9, 0.05 * (c.max() - c.min() + 1e-9))
    return float(np.median(c) - eps), float(np.median(c) + eps)


def rounds(values: DataFrame, one: tuple[str, ...], strategy: str = "spread") -> DataFrame:
    """What `auto_tune` finds of each metric, for groups of any size. values: one, metric, value, none missing and at least LEAST a group."""
    key = [*one, "metric"]
    asked = quantiles(values, (*one, "metric"), "value", (*STARTS, 0.1, 0.5, 0.9))
    state = asked.select(*key, *(F.col("p")[i].alias(f"c{i + 1}") for i in range(3)), *(F.col("p")[i + 3].alias(n) for i, n in enumerate(("p10", "p50", "p90"))), *(F.lit(0).cast("long").alias(f"n{i}") for i in (1, 2, 3)), F.lit(False).alias("done"))
    state = written(state, "state")
    counts = written(values.groupBy(*key, "value").agg(F.count("*").alias("n")), "values")
    near = F.broadcast if state.count() <= BROADCAST_ROWS else (lambda df: df)
    v = F.col("value")
    d = [(v - F.col(f"c{i}")) ** 2 for i in (1, 2, 3)]
    own = F.when((d[0] <= d[1]) & (d[0] <= d[2]), 1).when(d[1] <= d[2], 2).otherwise(3)
    for _ in range(ROUNDS):
        sums = counts.join(near(state.where("not done").select(*key, "c1", "c2", "c3")), key).withColumn("own", own)
        on = lambda i, x: F.coalesce(F.sum(F.when(F.col("own") == i, x)), F.lit(0))
        sums = sums.groupBy(*key).agg(*(on(i, F.col("n")).alias(f"m{i}") for i in (1, 2, 3)), *(on(i, F.col("n") * v).alias(f"s{i}") for i in (1, 2, 3)))
        new = [F.when(F.col(f"m{i}") > 0, F.col(f"s{i}") / F.col(f"m{i}")).otherwise(F.col(f"c{i}")) for i in (1, 2, 3)]
        close = [F.abs(x - F.col(f"c{i}")) <= 1e-8 + 1e-5 * F.abs(F.col(f"c{i}")) for i, x in zip((1, 2, 3), new)]
        moved = state.where("not done").join(sums, key).select(*key, *(x.alias(f"c{i}") for i, x in zip((1, 2, 3), new)), "p10", "p50", "p90", *(F.col(f"m{i}").alias(f"n{i}") for i in (1, 2, 3)), (close[0] & close[1] & close[2]).alias("done"))
        state = written(state.where("done").unionByName(moved), "state")
        if state.where("not done").isEmpty():
            break
    # centers that start alike may change places
    state = state.withColumn("__o", F.array_sort(F.array(*(F.struct(F.col(f"c{i}").alias("c"), F.lit(i).alias("i"), F.col(f"n{i}").alias("n")) for i in (1, 2, 3)))))
    state = state.withColumns({f"{c}{i}": F.col("__o")[i - 1][c] for c in "cn" for i in (1, 2, 3)}).drop("__o")
    lo, mid = _bounds(F.col("c1"), F.col("c2"), F.col("c3"))
    if strategy == "variance":
        mean = counts.groupBy(*key).agg((F.sum(F.col("n") * v) / F.sum("n")).alias("mean"), F.sum("n").alias("all"))
        spread = counts.join(near(mean), key).groupBy(*key).agg((F.sum(F.col("n") * (v - F.col("mean")) ** 2) / F.max("all")).alias("variance"))
        state = state.join(spread, key)
    measure = {"spread": F.greatest(F.lit(0.0), F.col("p90") - F.col("p10")), "variance": F.col("variance") if strategy == "variance" else F.lit(0.0)}.get(strategy, F.lit(1.0))
    return state.select(*key, "c1", "c2", "c3", "n1", "n2", "n3", lo.alias("lo"), mid.alias("mid"), "p10", "p50", "p90", measure.alias("measure"))


def _bounds(c1: Column, c2: Column, c3: Column) -> tuple[Column, Column]:
    """`bounds` of centers in order."""
    a, b = (c1 + c2) / 2, (c2 + c3) / 2
    eps = F.greatest(F.lit(1e-9), 0.05 * (c3 - c1 + 1e-9))
    return F.when(a < b, a).otherwise(c2 - eps), F.when(a < b, b).otherwise(c2 + eps)


def auto_tune(daily: DataFrame, metrics: dict[str, bool], entity: tuple[str, ...] = (), strategy: str = "spread") -> DataFrame:
    """A membership and a weight for each metric of each entity. metrics: name, and whether higher is worse.

    Weights follow the range from P10 to P90 (spread), the variance, or are equal; they add up to 1, and
    are equal where all measures are 0. Values are counted when it is called; above SMALL of them, `rounds` takes
    the place of the helper.
    """
    one = entity or ("__one",)
    base = daily if entity else daily.withColumn("__one", F.lit(0))
    long = melt(base, one, [m for m in metrics if m in daily.columns]).withColumn("value", finite(F.col("value")))

    def tune(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["value"].dropna().to_numpy(float)
        c, n = clusters(x)
        lo, mid = bounds(c)
        p = np.quantile(x, (0.1, 0.5, 0.9)) if len(x) else np.zeros(3)
        measure = {"spread": max(0.0, float(p[2] - p[0])), "variance": float(x.var()) if len(x) else 0.0}.get(strategy, 1.0)
        own = {k: [pdf[k].iloc[0]] for k in (*one, "metric")}
        return pd.DataFrame(own | {"c1": [c[0]], "c2": [c[1]], "c3": [c[2]], "n1": [int(n[0])], "n2": [int(n[1])], "n3": [int(n[2])], "lo": [lo], "mid": [mid], "p10": [p[0]], "p50": [p[1]], "p90": [p[2]], "measure": [measure]})

    kinds = ", ".join(f"`{k}` {long.schema[k].dataType.simpleString()}" for k in one)
    sizes = written(long.groupBy(*one, "metric").agg(F.count("value").alias("n")).where(F.col("n") > SMALL).select(*one, "metric"), "sizes")
    n = sizes.count()
    near = F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)
    few = long.join(near(sizes), [*one, "metric"], "left_anti") if n else long
    out = few.groupBy(*one, "metric").applyInPandas(tune, f"{kinds}, {OUT}")
    if n:
        out = out.unionByName(rounds(long.where("value is not null").join(near(sizes), [*one, "metric"], "left_semi"), one, strategy))
    w = Window.partitionBy(*one)
    total = F.sum("measure").over(w)
    weight = F.when(total > 0, F.col("measure") / total).otherwise(1.0 / F.count("*").over(w))
    worse = F.create_map(*(F.lit(v) for m, up in metrics.items() for v in (m, up)))
    out = out.withColumns({"w": weight, "type": F.lit("tri"), "hi": F.lit(float("inf")), "invert": ~worse[F.col("metric")]}).drop("measure")
    return out if entity else out.drop("__one")


def quantile_summary(daily: DataFrame, metrics: list[str], entity: tuple[str, ...] = ()) -> DataFrame:
    """(entity, metric, n, p10, p50, p90, spread, variance, w): the weights alone, in SQL functions."""
    one = entity or ("__one",)
    base = daily if entity else daily.withColumn("__one", F.lit(0))
    long = written(melt(base, one, metrics), "long")
    found = quantiles(long, (*one, "metric"), "value", (0.1, 0.5, 0.9)).select(*one, "metric", *(F.col("p")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))))
    v = finite(F.col("value"))
    agg = long.groupBy(*one, "metric").agg(F.count(v).alias("n"), F.var_pop(v).alias("variance")).join(found, [*one, "metric"], "left")
    agg = agg.select(*one, "metric", "n", "p10", "p50", "p90", F.coalesce(F.greatest(F.lit(0.0), F.col("p90") - F.col("p10")), F.lit(0.0)).alias("spread"), "variance")
    w = Window.partitionBy(*one)
    out = agg.withColumn("w", F.when(F.sum("spread").over(w) > 0, F.col("spread") / F.sum("spread").over(w)).otherwise(1.0 / F.count("*").over(w)))
    return out if entity else out.drop("__one")
