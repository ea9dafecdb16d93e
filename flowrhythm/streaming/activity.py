"""Activity as a stream: sessions by idle gap, and minutes with the empty ones between them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowrhythm.operators.sessions import session_windows
from flowrhythm.streaming.slots import LAG

MINUTE_MS = 60_000


def closed_sessions(packets: DataFrame, gap: int = 300, lag: str = LAG) -> DataFrame:
    """(Dataset, first, last, rows) of sessions that the watermark has passed by the gap. Rows may come in any order within the lag."""
    rows = packets.withColumn("Timestamp", F.col("Timestamp").cast("timestamp")).withWatermark("Timestamp", lag)
    return session_windows(rows, ("Dataset",), gap)


def _fill(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts of one dataset's minutes: those that are still open are the state, closed ones go out in order, empty ones too."""
    start, minutes, packets, sizes = state.get if state.exists else (None, [], [], [])
    held: dict[int, tuple[int, int]] = {m: (n, b) for m, n, b in zip(minutes, packets, sizes)}
    for frame in frames:
        for m, n, b in frame.groupby("minute")["bytes"].agg(["count", "sum"]).itertuples():
            if start is None or m >= start:  # earlier ones have gone out
                own = held.get(m, (0, 0))
                held[m] = (own[0] + int(n), own[1] + int(b))
    stop = state.getCurrentWatermarkMs() // MINUTE_MS  # minutes before this are closed
    if held and start is None:
        start = min(held)
    out: list[tuple[Any, ...]] = []
    if start is not None and stop > start:
        out = [(key[0], m, *held.pop(m, (0, 0))) for m in range(start, stop)]
        start = stop
    if start is not None:
        kept = sorted(held)
        state.update((start, kept, [held[m][0] for m in kept], [held[m][1] for m in kept]))
        state.setTimeoutTimestamp(max((start + 1) * MINUTE_MS, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["Dataset", "minute", "packets", "bytes"])


def closed_minutes(packets: DataFrame, lag: str = LAG) -> DataFrame:
    """(Dataset, minute, packets, bytes): every minute from a dataset's first one on, once the watermark has passed it, 0 where there are no packets.

    A dataset's first minute is the first that is open when its first packets come. Rows of minutes that have gone
    out are left out. Minutes count from 1970; the state of a dataset is its open minutes, as many as the lag has.
    """
    rows = packets.select("Dataset", F.col("Timestamp").cast("timestamp").alias("at"), F.coalesce("length", F.lit(0)).cast("long").alias("bytes")).withWatermark("at", lag)
    rows = rows.withColumn("minute", F.floor(F.unix_micros("at") / F.lit(60_000_000)))
    return rows.groupBy("Dataset").applyInPandasWithState(_fill, "Dataset string, minute long, packets long, bytes long", "start long, minutes array<long>, packets array<long>, bytes array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def write_stream(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
