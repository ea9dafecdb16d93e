"""Overviews: series, mixes, heatmaps, distributions and drill-downs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrhythm.functions.network import MICROS
from flowrhythm.operators.gaps import busiest_slot, with_previous
from flowrhythm.operators.quantiles import quantiles
from flowrhythm.operators.sessions import seconds, sessions

DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def per_minute(rows: DataFrame, labels: tuple[str, ...] = ("Dataset", "Date")) -> DataFrame:
    """Packets and bytes of every minute of the day, zero where there are none. labels hold Date."""
    found = rows.groupBy(*labels, F.pmod("minute", F.lit(1440)).cast("int").alias("minute_of_day")).agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes"))
    return _filled(found, labels, "minute_of_day", 1440)


def per_week_minute(rows: DataFrame, labels: tuple[str, ...] = ("Dataset",)) -> DataFrame:
    """The same over weeks from Monday on, with the minute of the week."""
    at = (F.weekday("Date") * 1440 + F.pmod("minute", F.lit(1440))).cast("int")
    found = rows.withColumn("WeekStart", F.date_sub("Date", F.weekday("Date"))).groupBy(*labels, "WeekStart", at.alias("minute_of_week")).agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes"))
    return _filled(found, (*labels, "WeekStart"), "minute_of_week", 10080)


def _filled(found: DataFrame, labels: tuple[str, ...], at: str, n: int) -> DataFrame:
    every = found.select(*labels).distinct().withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return every.join(found, [*labels, at], "left").fillna(0, ["packets", "bytes"])


def protocol_mix(rows: DataFrame, labels: tuple[str, ...] = ("Date",)) -> DataFrame:
    return rows.groupBy(*labels, "minute", "protocol").agg(F.count("*").alias("packets"))


def hourly_heatmap(rows: DataFrame, labels: tuple[str, ...] = ("Date",)) -> DataFrame:
    """A row for each day, a column for each hour."""
    return rows.groupBy(*labels).agg(*(F.count_if(F.col("hour") == h).alias(f"h{h:02d}") for h in range(24)))


def weekday_heatmap(rows: DataFrame) -> DataFrame:
    """A row for each weekday, a column for each hour."""
    return rows.groupBy(weekday_name(F.col("Date")).alias("weekday")).agg(*(F.count_if(F.col("hour") == h).alias(f"h{h:02d}") for h in range(24)))


def weekday_name(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAYS)), F.weekday(day) + 1)


def by_group(rows: DataFrame, group: str = "Dataset") -> DataFrame:
    """Packets and bytes, the largest first."""
    return rows.groupBy(group).agg(F.count("us").alias("packets"), F.sum("length").alias("bytes")).orderBy(F.desc("packets"), group)


def by_weekday(daily: DataFrame, metric: str, day: str = "Date") -> DataFrame:
    return daily.groupBy(weekday_name(F.col(day)).alias("weekday")).agg(F.sum(metric).alias("total"))


def week_by_weekday(daily: DataFrame, metric: str, day: str = "Date") -> DataFrame:
    """A row for each week, from Monday, a column for each day."""
    w = F.weekday(day)
    return daily.groupBy(F.date_sub(day, w).alias("WeekStart")).agg(*(F.sum(F.when(w == i, F.col(metric))).alias(n) for i, n in enumerate(DAYS)))


def distribution(long: DataFrame, by: tuple[str, ...] = ("metric",), value: str = "value") -> DataFrame:
    """Least, quartiles and greatest of the finite values; groups of any size, whose sizes are counted when it is called."""
    found = quantiles(long, by, value, (0.25, 0.5, 0.75))
    return found.select(*by, "n", "least", F.col("p")[0].alias("q1"), F.col("p")[1].alias("q2"), F.col("p")[2].alias("q3"), "greatest")


def domains(rows: DataFrame, category: str, n: int | None = None) -> DataFrame:
    """Domains of a category with their rows, the most frequent first."""
    out = rows.where(F.col(category) & F.col("SLD").isNotNull()).groupBy("SLD").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "SLD")
    return out if n is None else out.limit(n)


def session_list(rows: DataFrame, keys: tuple[str, ...], category: str, gap: int = 300, n: int = 20) -> DataFrame:
    """The first n sessions of a category by time."""
    found = sessions(rows.where(F.col(category)), keys, gap)
    return found.select(*keys, "first_us", "last_us", seconds().alias("seconds")).orderBy("first_us", *keys).limit(n)


def diet_bursts(rows: DataFrame, keys: tuple[str, ...], least: int = 3) -> DataFrame:
    return rows.where("diet").groupBy(*keys, "SLD", F.floor(F.col("us") / F.lit(600 * MICROS)).alias("bin")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def cloud_providers(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Outbound bytes to each cloud domain."""
    return rows.where(F.col("cloud") & F.col("outbound")).groupBy(*keys, "SLD").agg(F.sum("bytes").alias("up_bytes"))


def reply_gaps(rows: DataFrame, keys: tuple[str, ...], n: int | None = None, most: int = 120) -> DataFrame:
    """(keys, us, seconds): chat packets sent right after one received, within `most` whole seconds, the first n by time or all."""
    return _gaps(rows, keys, F.col("chat") & F.col("src").isNotNull() & F.col("dst").isNotNull(), lambda whole, d: F.col("prev_inbound") & F.col("outbound") & (whole > 0) & (whole <= most), n)


def typing_gaps(rows: DataFrame, keys: tuple[str, ...], n: int | None = None, most: float = 3.0) -> DataFrame:
    """(keys, us, seconds): gaps of up to `most` seconds between chat packets sent."""
    return _gaps(rows, keys, F.col("chat") & F.col("outbound"), lambda whole, d: (d > 0) & (d <= int(most * MICROS)), n)


def _gaps(rows: DataFrame, keys: tuple[str, ...], which: Column, good, n: int | None) -> DataFrame:
    chosen = rows.where(which).select(*keys, "us", "tie", "inbound", "outbound")
    d = F.col("us") - F.col("prev_us")
    found = with_previous(chosen, keys, ("us", "inbound"), busiest=busiest_slot(chosen, keys)).where(good(F.floor(d / F.lit(MICROS)), d))
    return _first(found.select(*keys, "us", "tie", (d / F.lit(float(MICROS))).alias("seconds")), keys, n)


def scale_events(rows: DataFrame, keys: tuple[str, ...], n: int | None = None) -> DataFrame:
    """(keys, us, SLD, bytes): packets sent to a scale's service, the first n by time or all."""
    return _first(rows.where(F.col("scale") & F.col("outbound")).select(*keys, "us", "tie", "SLD", "bytes"), keys, n)


def _first(found: DataFrame, keys: tuple[str, ...], n: int | None) -> DataFrame:
    return (found if n is None else found.orderBy("us", "tie", *keys).limit(n)).drop("tie")
