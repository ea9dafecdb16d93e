"""Sessions by idle gap, in two steps.

Two rows in one slot as long as the gap are closer than the gap, so no session breaks
inside a slot. Rows are first aggregated by slot, partially before the shuffle, and only
slots are ordered: at most 86,400 / gap rows per key and day, however many packets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrhythm.functions.network import MICROS


def masked(rows: DataFrame, masks: dict[str, Column], name: str = "mask") -> DataFrame:
    """Each row once for every mask that holds for it: one pass over the packets for all of them."""
    held = F.filter(F.array(*(F.when(m, F.lit(k)) for k, m in masks.items())), lambda x: x.isNotNull())
    return rows.withColumn(name, F.explode(held))


def sessions(rows: DataFrame, keys: tuple[str, ...], gap: int | dict[str, int], sums: dict[str, Column] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(keys, by, session, first_us, last_us, sums): a new session begins after a gap of more than `gap` seconds.

    With a dict, `gap` is looked up by the value of the first column of `by`. rows need us.
    """
    sums = sums or {}
    micro = F.lit(gap * MICROS) if isinstance(gap, int) else F.create_map(*(F.lit(x) for k, g in gap.items() for x in (k, g * MICROS)))[F.col(by[0])]
    group = [*keys, *by]
    slots = rows.withColumn("__slot", F.floor(F.col("us") / micro)).groupBy(*group, "__slot").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), *(F.sum(c).alias(n) for n, c in sums.items()))
    w = Window.partitionBy(*group).orderBy("__slot")
    new = F.coalesce(F.col("first_us") - F.lag("last_us").over(w) > micro, F.lit(True))
    numbered = slots.withColumn("__new", new.cast("int")).withColumn("session", F.sum("__new").over(w))
    return numbered.groupBy(*group, "session").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *(F.sum(n).alias(n) for n in sums))


def seconds() -> Column:
    """Length of a session."""
    return (F.col("last_us") - F.col("first_us")) / F.lit(float(MICROS))


def session_windows(rows: DataFrame, keys: tuple[str, ...], gap: int, ts: str = "Timestamp") -> DataFrame:
    """The same sessions by Spark's session window; takes a stream with a watermark too. A gap of exactly `gap` doesn't split."""
    w = F.session_window(ts, F.lit(f"{gap} seconds"))
    return rows.groupBy(*keys, w.alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("rows")).drop("w")
