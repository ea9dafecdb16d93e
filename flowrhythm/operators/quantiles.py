"""Exact quantiles of groups of any size, by distributed selection.

Values are counted once, and the rest works on different values and their counts. Groups of
up to SMALL different values keep them in one aggregate. In larger ones a sketch of bounded size
proposes cuts, the values between and at them are counted exactly, and only those of the intervals
that hold a wanted rank go on to the next round. A round leaves about one in CUTS of them for each
rank, whatever the values are like; one that is a cut itself is found at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrhythm.functions.network import finite
from flowrhythm.sources.scratch import written

#: Different values that one task keeps, cuts of a round, accuracy of the sketch, groups whose bounds are broadcast.
SMALL, CUTS, ACCURACY, BROADCAST_ROWS = 1_000_000, 64, 10_000, 100_000


def quantiles(rows: DataFrame, by: tuple[str, ...], value: str, probs: tuple[float, ...], small: int | None = None) -> DataFrame:
    """(by, n, least, p, greatest): number, extremes and linear quantiles of the finite values of each group, as `percentile` has them.

    A group without any has no row. p holds the quantiles in the order asked for.
    """
    small = SMALL if small is None else small
    long = rows.select(*by, finite(F.col(value)).alias("__v")).where("__v is not null")
    counts = written(long.groupBy(*by, "__v").agg(F.count("*").alias("__c")), "counts")
    sizes = written(counts.groupBy(*by).agg(F.sum("__c").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("greatest"), F.count("*").alias("d")), "sizes")
    large = sizes.where(F.col("d") > small)
    n_large = large.count()
    kept = lambda df: df.groupBy(*by).agg(F.sum("__c").alias("n"), F.min("__v").alias("least"), F.percentile("__v", F.array(*map(F.lit, probs)), F.col("__c")).alias("p"), F.max("__v").alias("greatest"))
    if not n_large:
        return kept(counts)
    near = (lambda df: F.broadcast(df)) if n_large * len(probs) * 2 <= BROADCAST_ROWS else (lambda df: df)
    marked = counts.join(near(large.select(*by, F.lit(True).alias("__large"))), [*by], "left")
    few = kept(marked.where("__large is null"))
    # the two ranks around each quantile
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in probs))))
    found = _selected(marked.where("__large").drop("__large"), large.withColumn("rank", F.explode(ranks)).select(*by, "rank", "d"), by, near, small)
    at = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "__v"))).alias("m"))  # two ranks of each quantile

    def one(p: float) -> Column:
        lo, hi = F.floor(place(p)), F.ceil(place(p))
        a, b = F.col("m")[lo], F.col("m")[hi]
        return F.when(lo == hi, a).otherwise((hi - place(p)) * a + (place(p) - lo) * b)

    many = large.join(at, [*by]).select(*by, "n", "least", F.array(*map(one, probs)).alias("p"), "greatest")
    return few.unionByName(many)


def _selected(rows: DataFrame, targets: DataFrame, by: tuple[str, ...], near, small: int) -> DataFrame:
    """(by, rank, __v): the values of these ranks, counted from 0. rows: by, __v, __c (its count); targets: by, rank, d (different values).

    Ranks share the values of a cell: of the group at first, then of the interval that holds them.
    """
    cell = [*by, "cell"]
    rows = rows.withColumn("cell", F.lit(""))
    todo = targets.withColumns({"cell": F.lit(""), "left": F.col("rank")})  # left: the rank within the cell
    in_cells = lambda df, t: df.join(near(t.select(*cell).distinct()), cell, "left_semi")
    holds = (F.col("upto") > F.col("left")) & (F.col("upto") - F.col("__c") <= F.col("left"))
    done: list[DataFrame] = []
    while True:
        last = todo.where(F.col("d") <= small)
        w = Window.partitionBy(*cell).orderBy("__v")  # `small` values at most
        done.append(written(in_cells(rows, last).withColumn("upto", F.sum("__c").over(w)).join(near(last), cell).where(holds).select(*by, "rank", "__v"), "found"))
        todo = todo.where(F.col("d") > small).drop("d")
        if todo.isEmpty():
            break
        cuts = in_cells(rows, todo).groupBy(*cell).agg(F.array_distinct(F.percentile_approx("__v", [i / CUTS for i in range(CUTS + 1)], ACCURACY)).alias("cuts"))
        cuts = written(cuts, "cuts")
        # even places are between cuts, odd ones are cuts
        below = F.size(F.filter("cuts", lambda c: c < F.col("__v")))
        placed = rows.join(near(cuts), cell).withColumn("at", below * 2 + F.array_contains("cuts", F.col("__v")).cast("int"))
        counted = written(placed.groupBy(*cell, "at").agg(F.sum("__c").alias("__c"), F.count("*").alias("d")), "cells")
        w = Window.partitionBy(*cell).orderBy("at")  # 2 * CUTS + 3 rows at most
        held = counted.withColumn("upto", F.sum("__c").over(w)).join(todo, cell).where(holds)
        held = written(held.select(*cell, "rank", "at", (F.col("left") - (F.col("upto") - F.col("__c"))).alias("left"), "d"), "held")
        done.append(held.where(F.col("at") % 2 == 1).join(cuts, cell).select(*by, "rank", F.element_at("cuts", F.floor(F.col("at") / 2).cast("int") + 1).alias("__v")))
        inner = F.concat_ws("/", "cell", F.col("at").cast("string"))
        kept = held.where(F.col("at") % 2 == 0)
        rows = written(placed.join(near(kept.select(*cell, "at").distinct()), [*cell, "at"], "left_semi").withColumn("cell", inner).drop("at", "cuts"), "rest")
        todo = kept.withColumn("cell", inner).drop("at")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
