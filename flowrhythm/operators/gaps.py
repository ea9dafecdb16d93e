"""Gaps between ordered rows, found so that no task orders a whole key.

Rows are ordered inside slots, and slots after that, as long as no slot holds more rows
than a task should order. Beyond that, rows are dealt into even ranges of (group, time,
tie) whatever the times are: each range is passed through once in order, and the last
row of each goes on to the first row of the next, found among one row for each range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrhythm.functions.network import MICROS
from flowrhythm.sources.scratch import written

#: Rows of a slot that one task orders at most, and rows of a range, on average.
SLOT_ROWS, RANGE_ROWS = 2_000_000, 1_000_000


def busiest_slot(rows: DataFrame, group: tuple[str, ...], slot_seconds: int = 300) -> int:
    """The most rows that a slot of a group has; counts are summed before the shuffle."""
    return rows.groupBy(*group, F.floor(F.col("us") / F.lit(slot_seconds * MICROS))).count().agg(F.max("count")).first()[0] or 0


def with_previous(rows: DataFrame, group: tuple[str, ...], columns: tuple[str, ...], slot_seconds: int = 300, busiest: int = 0) -> DataFrame:
    """rows with prev_<column> of the row before, by us and then tie, within a group; null for the first.

    busiest tells how many rows a slot has at most: above SLOT_ROWS even ranges take the place of slots. Rows that
    agree in us and tie follow each other in any order.
    """
    if busiest > SLOT_ROWS:
        return previous_by_ranges(rows, group, columns)
    rows = rows.withColumn("__slot", F.floor(F.col("us") / F.lit(slot_seconds * MICROS)))
    own = F.struct(*columns)
    order = F.struct("us", "tie")
    w = Window.partitionBy(*group, "__slot").orderBy("us", "tie")
    inside = rows.withColumn("__prev", F.lag(own).over(w))
    last = rows.groupBy(*group, "__slot").agg(F.max_by(own, order).alias("__end"))
    last = last.withColumn("__before", F.lag("__end").over(Window.partitionBy(*group).orderBy("__slot"))).drop("__end")
    out = inside.join(last, [*group, "__slot"], "left").withColumn("__prev", F.coalesce("__prev", "__before"))
    return out.withColumns({f"prev_{c}": F.col("__prev")[c] for c in columns}).drop("__slot", "__prev", "__before")


def previous_by_ranges(rows: DataFrame, group: tuple[str, ...], columns: tuple[str, ...], range_rows: int = RANGE_ROWS) -> DataFrame:
    """The same by even ranges; they are written once, so that a lost executor repeats its own ranges only."""
    parts = max(1, math.ceil(rows.count() / range_rows))
    order = [*group, "us", "tie"]
    fields = [*rows.schema.fields, *(T.StructField(f"prev_{c}", rows.schema[c].dataType) for c in columns), T.StructField("__range", T.IntegerType()), T.StructField("__place", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place, held = TaskContext.get().partitionId(), 0, None
        for b in batches:
            n = len(b)
            if not n:
                continue
            before = lambda c: pa.concat_arrays([held.column(c) if held is not None else pa.nulls(1, b.column(c).type), b.column(c).slice(0, n - 1)])  # noqa: B023, E731
            same = pa.array(np.arange(place, place + n) > 0)
            for g in group:
                x, y = b.column(g), before(g)
                same = pc.and_(same, pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y))))
            prev = [pc.if_else(same, before(c), pa.scalar(None, b.column(c).type)) for c in columns]
            at = pa.array(np.arange(place, place + n))
            yield pa.RecordBatch.from_arrays([*b.columns, *prev, pa.array(np.full(n, number, np.int32)), at], names=[f.name for f in fields])
            place, held = place + n, b.slice(n - 1)

    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = written(ordered.mapInArrow(run, T.StructType(fields)), "ranges")
    own = F.struct(*(F.col(g).alias(f"g{i}") for i, g in enumerate(group)), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    ends = found.groupBy("__range").agg(F.max_by(own, "__place").alias("__end"))
    ends = ends.withColumn("__before", F.lag("__end").over(Window.partitionBy(F.lit(0)).orderBy("__range"))).drop("__end")  # a row for each range
    first = F.col("__place") == 0
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__before.g{i}"))
    heads = found.where(first).join(ends, "__range", "left")  # a row for each range
    heads = heads.withColumns({f"prev_{c}": F.when(F.col("__before").isNotNull() & same, F.col(f"__before.c{i}")) for i, c in enumerate(columns)})
    return found.where(~first).unionByName(heads.drop("__before")).drop("__range", "__place")
