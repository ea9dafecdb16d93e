"""Measures of the per-minute and per-hour series in closed form, without filling in zero minutes.

With N minutes from the first to the last active one, A of them active, p = A / N: the
0/1 series has squared deviations N p (1 - p), and its differences are 1 exactly at
the edges of islands of active minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrhythm.functions.network import share


def minutes(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, minute, n, bytes) of the active minutes; minutes count from 1970."""
    return rows.groupBy(*keys, "minute").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def minute_measures(active: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Active minutes by day and night, IS, IV, Fano factor, hourly variation, idle shares; one row of each key."""
    w = Window.partitionBy(*keys).orderBy("minute")
    rows = active.withColumns({"hour": F.pmod(F.floor(F.col("minute") / 60), F.lit(24)), "hours": F.floor(F.col("minute") / 60), "island": F.coalesce(F.col("minute") - F.lag("minute").over(w) > 1, F.lit(True)).cast("int")})
    hours = rows.groupBy(*keys, "hours").agg(
        F.first("hour").alias("hour"), F.count("*").alias("a"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("nn"), F.sum("island").alias("islands"), F.min("minute").alias("lo"), F.max("minute").alias("hi")
    )
    ends = hours.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("a").alias("all"))
    # minutes of an hour of the day inside the span; an hour that never is active adds N_h p^2, N_h being its minutes in the span
    clock = hours.groupBy(*keys, "hour").agg(F.sum("a").alias("a"))
    span = ends.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("hour", F.col("hour").cast("bigint"))
    day = F.lit(1440)
    upto = lambda m: F.floor((m - F.col("hour") * 60) / day) * 60 + F.least(F.lit(60), F.pmod(m - F.col("hour") * 60, day))  # noqa: E731  minutes of this hour before m
    by_clock = span.join(clock.withColumn("hour", F.col("hour").cast("bigint")), [*keys, "hour"], "left").withColumn("n_h", upto(F.col("hi") + 1) - upto(F.col("lo")))
    n, p = F.col("hi") - F.col("lo") + 1, F.col("all") / (F.col("hi") - F.col("lo") + 1)
    mean = F.when(F.col("n_h") > 0, F.coalesce("a", F.lit(0)) / F.col("n_h")).otherwise(F.lit(0.0))
    regular = by_clock.groupBy(*keys).agg(F.sum((mean - p) ** 2).alias("between"))
    in_hours = lambda a, b: F.sum(F.when(F.col("hour").between(a, b), F.col("a")).otherwise(0))
    total = hours.groupBy(*keys).agg(
        in_hours(0, 5).alias("ActiveNightMinutes"), in_hours(8, 20).alias("ActiveDayMinutes"), in_hours(8, 17).alias("__day"), in_hours(9, 17).alias("__mid"), F.sum("a").alias("all"), F.sum("n").alias("n"), F.sum("nn").alias("nn"),
        F.sum(F.col("n").cast("double") ** 2).alias("hh"), F.sum("islands").alias("islands"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("hours").alias("h0"), F.max("hours").alias("h1"),
    )
    out = total.join(regular, [*keys])
    n, a = F.col("hi") - F.col("lo") + 1, F.col("all")
    ssd = n * (a / n) * (1 - a / n)
    k = F.col("h1") - F.col("h0") + 1
    # minutes of hours [a, b] of the clock inside the span
    within = lambda a_, b_: sum((F.floor((F.col(e) + d - h * 60) / day) * 60 + F.least(F.lit(60), F.pmod(F.col(e) + d - h * 60, day))) * sign for h in range(a_, b_ + 1) for e, d, sign in (("hi", 1, 1), ("lo", 0, -1)))
    mean_n, mean_h = F.col("n") / n, F.col("n") / k
    return out.select(
        *keys, "ActiveNightMinutes", "ActiveDayMinutes", share(F.col("ActiveNightMinutes"), F.col("ActiveDayMinutes")).alias("ND_Ratio"),
        F.when((n >= 2) & (ssd > 1e-12), n * F.col("between") / (24 * ssd)).alias("IS"), F.when((n >= 2) & (ssd > 1e-12), n * (2.0 * (F.col("islands") - 1)) / ((n - 1) * ssd)).alias("IV"),
        F.when(mean_n > 0, (F.col("nn") / n - mean_n**2) / mean_n).alias("F6_Fano"), F.when(mean_h > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("hh") / k - mean_h**2)) / mean_h).alias("F7_HourlyCV"),
        F.when(within(8, 17) > 0, 1 - F.col("__day") / within(8, 17)).alias("C4_F7_DaytimeIdleRatio0818"), F.when(within(9, 17) > 0, (within(9, 17) - F.col("__mid")) / F.lit(540.0)).alias("C6_F3_DayIdleRatio_09_18"),
    )
