"""Joins of many rows with a table of one row for each key, whatever keys the rows favour.

A sketch of bounded size finds the keys that many rows have. What the table says of these
few is broadcast; other rows meet theirs in a shuffle, in which the rows of frequent keys,
which need nothing there, are dealt evenly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrhythm.sources.scratch import written

#: A key is frequent if it has one in SHARE of all rows; counters that a task keeps.
SHARE, COUNTERS = 500, 4000


def frequent(rows: DataFrame, on: tuple[str, ...], share: int = SHARE) -> list[int]:
    """Hashes of the keys that one in `share` rows has, and perhaps a few others, 2 * share at most, in one pass over rows.

    Each task keeps COUNTERS counters: with more keys all counters go down by what the least of those that stay has, so
    one falls short of its count by at most one in COUNTERS of the task's rows. Rows with a null in their key don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for b in batches:
            total += len(b)
            h, at = np.unique(np.concatenate([h, b.column(0).to_numpy()]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, np.ones(len(b), np.int64)]), len(h)).astype(np.int64)
            if len(h) > COUNTERS:
                n = n - np.partition(n, len(n) - COUNTERS - 1)[len(n) - COUNTERS - 1]
                h, n = h[n > 0], n[n > 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(h, 0)), pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(h), np.int64), total))], names=["h", "n", "total"])

    known = rows.where(" and ".join(f"`{c}` is not null" for c in on)).select(F.xxhash64(*on).alias("h"))
    counts = written(known.mapInArrow(run, "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "counts")
    top = counts.orderBy(F.desc("total")).limit(1).collect()
    total = top[0].total if top else 0
    least = total / share - total / COUNTERS
    found = counts.where((F.col("n") >= least) & (F.col("n") > 0)).orderBy(F.desc("n"), "h").limit(2 * share).collect()
    return [r.h for r in found]


def look_up(rows: DataFrame, table: DataFrame, on: tuple[str, ...], hot: list[int], spread: Column) -> DataFrame:
    """rows with the other columns of table, null where it has no row for their key. hot: hashes from `frequent`.

    table has one row for each key, and no column of rows but those of `on`. spread is any number that differs
    between rows. Without hot keys this is a plain left join.
    """
    if not hot:
        return rows.join(table, [*on], "left")
    said = [c for c in table.columns if c not in on]
    is_hot = F.xxhash64(*on).isin(*hot)
    few = F.broadcast(table.where(is_hot).withColumnsRenamed({c: f"__hot_{c}" for c in said}))  # a row for each hot key
    # a column of its own to deal by: a literal one would be folded into a condition, and rows dealt by their key after all
    others = table.where(~is_hot).withColumn("__by", F.xxhash64(*on))
    dealt = rows.join(few, [*on], "left").withColumn("__by", F.when(is_hot, F.xxhash64(spread)).otherwise(F.xxhash64(*on)))
    out = dealt.join(others, [*on, "__by"], "left")
    return out.select(*rows.columns, *(F.when(is_hot, F.col(f"__hot_{c}")).otherwise(F.col(c)).alias(c) for c in said))
