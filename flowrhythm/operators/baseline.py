"""Comparison of a day with the entity's own earlier days.

"The last n values" are rows with a value, not calendar days: days without one neither
count nor use up the window. Windows are partitioned by entity, never global.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = tuple[str, ...]


def delta_from_median(daily: DataFrame, column: str, entity: Keys, day: str = "Date", window: int = 28, output: str = "delta") -> DataFrame:
    """The value less the median of up to `window` earlier rows; null without a value or an earlier one."""
    w = Window.partitionBy(*(entity or (F.lit(0),))).orderBy(day).rowsBetween(-window, -1)
    return daily.withColumn(output, F.col(column) - F.percentile(column, F.lit(0.5)).over(w))


def _history(daily: DataFrame, column: str, entity: Keys, day: str, n: int, include_current: bool) -> DataFrame:
    """daily with __h: count, mean, deviation and angular sums of the last n values before each row.

    Values are numbered along the days; a row without one has the number of the latest before it. A frame
    over these numbers is then the last n values, in one pass over the rows as they are.
    """
    by = Window.partitionBy(*(entity or (F.lit(0),)))
    angle = F.col(column) * (2 * math.pi / 1440)

    def stats(w: WindowSpec) -> Column:
        return F.struct(F.count(column).over(w).alias("n"), F.avg(column).over(w).alias("avg"), F.stddev_samp(column).over(w).alias("sd"), F.sum(F.cos(angle)).over(w).alias("cos"), F.sum(F.sin(angle)).over(w).alias("sin"))

    rows = daily.withColumn("__no", F.count(column).over(by.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)))
    numbered = by.orderBy("__no")
    through, before = stats(numbered.rangeBetween(-(n - 1), 0)), stats(numbered.rangeBetween(-n, -1))
    return rows.withColumn("__h", through if include_current else F.when(F.col(column).isNull(), through).otherwise(before)).drop("__no")


def absolute_z(daily: DataFrame, column: str, entity: Keys, day: str = "Date", n: int = 30, least: int = 7, include_current: bool = False, output: str = "abs_z") -> DataFrame:
    """|value - mean| / sd of the last n values; null below `least` values or without spread."""
    rows = _history(daily, column, entity, day, n, include_current)
    z = F.when((F.col("__h.n") >= least) & (F.col("__h.sd") > 0), F.abs((F.col(column) - F.col("__h.avg")) / F.col("__h.sd")))
    return rows.withColumn(output, z).drop("__h")


def circular_spread(daily: DataFrame, column: str, entity: Keys, day: str = "Date", n: int = 14, least: int = 3, include_current: bool = False, output: str = "spread") -> DataFrame:
    """Circular standard deviation, in minutes, of the last n values (minutes of the day)."""
    rows = _history(daily, column, entity, day, n, include_current)
    h = F.col("__h")
    r = F.sqrt(h["cos"] ** 2 + h["sin"] ** 2) / h["n"]
    sd = F.sqrt(F.greatest(F.lit(0.0), -2 * F.log(F.least(r, F.lit(1.0))))) * (1440 / (2 * math.pi))
    return rows.withColumn(output, F.when((h["n"] >= least) & (r > 0), sd)).drop("__h")


def with_history(daily: DataFrame, entity: Keys = (), day: str = "Date", include_current: bool = False) -> DataFrame:
    """The three metrics that need earlier days."""
    out = circular_spread(daily, "C4_F1_OnsetLocalMin", entity, day, include_current=include_current, output="C4_F3_OnsetVar14dMin")
    out = absolute_z(out, "LongestInactivityHours", entity, day, include_current=include_current, output="C4_F4_SleepDurationZAbs30d")
    return delta_from_median(out, "C6_F8_FirstActivityMin", entity, day, output="C6_F9_ActivationDelayVsBase28d")
