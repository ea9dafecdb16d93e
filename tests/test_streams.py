"""Streams with late, unordered and repeated rows against batches."""

from __future__ import annotations

import random
import tempfile

from pyspark.sql import functions as F

from flowrhythm.operators.sessions import session_windows
from flowrhythm.streaming import activity, slots

SCHEMA = "Dataset string, Timestamp timestamp_ntz, length long"


def rows_of(spark, rows):
    return spark.createDataFrame([(d, float(s), n) for d, s, n in rows], "Dataset string, s double, length long").select("Dataset", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(s AS DECIMAL(18, 3)))").alias("Timestamp"), "length")


def streamed(spark, batches):
    folder = tempfile.mkdtemp(prefix="spark-")
    for k, b in enumerate(batches):
        rows_of(spark, b).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in"), folder


def made(seed=1):
    r = random.Random(seed)
    rows = [(r.choice("ab"), round(i * 40 + r.random() * 30 + (3000 if i > 150 else 0), 3), r.randint(1, 9)) for i in range(300)]
    batches = [rows[:100], rows[100:200], rows[200:]]
    for b in batches:
        r.shuffle(b)
    # some come a batch late, within the lag of ten minutes
    moved = [x for x in batches[0] if x[1] > 3700]
    return [[x for x in batches[0] if x not in moved], batches[1] + moved, batches[2]], rows


def test_late_rows_correct_their_slot(spark):
    batches, rows = made()
    late = [("a", 5.0, 100), ("c", 7.0, 1), ("b", 11_000.0, 50)]
    stream, folder = streamed(spark, [*batches, late])
    slots.write_corrected(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("Dataset", "slot_start", "packets", "bytes", "first", "last").collect()))
    want = key(slots.slot_counts(rows_of(spark, rows + late)))
    assert key(slots.corrected_counts(spark, f"{folder}/out")) == want
    # a repeated batch writes the same part again
    slots.slot_counts(rows_of(spark, late)).write.mode("overwrite").parquet(f"{folder}/out/batch=3")
    assert key(slots.corrected_counts(spark, f"{folder}/out")) == want
    slots.merge_corrected(spark, f"{folder}/out", f"{folder}/merged")
    assert key(spark.read.parquet(f"{folder}/merged")) == want


def test_sessions_close_as_in_a_batch(spark):
    batches, rows = made(2)
    stream, folder = streamed(spark, batches)
    activity.write_stream(activity.closed_sessions(stream, 100), f"{folder}/out", f"{folder}/state").awaitTermination()
    end = max(s for _, s, _ in rows) - 600
    every = session_windows(rows_of(spark, rows).withColumn("Timestamp", F.col("Timestamp").cast("timestamp")), ("Dataset",), 100)
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    want = every.where((F.unix_micros("last") - F.unix_micros(start)) / 1e6 + 100 <= end)
    got = spark.read.parquet(f"{folder}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and 5 < got.count() < every.count()


def test_minutes_go_out_once_and_without_holes(spark):
    batches, rows = made(3)
    gone = [("a", 30.0, 1000)]  # its minute went out long ago
    stream, folder = streamed(spark, [*batches, gone])
    activity.write_stream(activity.closed_minutes(stream), f"{folder}/out", f"{folder}/state").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))
    base = 1704067200 // 60
    stop = base + int((max(s for _, s, _ in rows) - 600) // 60)
    want = []
    for d in "ab":
        own = [(base + int(s // 60), n) for x, s, n in rows if x == d]
        want += [(d, m, sum(1 for y, _ in own if y == m), sum(n for y, n in own if y == m)) for m in range(min(own)[0], stop)]
    assert got == sorted(want) and sum(1 for x in got if not x[2]) > 20


def test_addresses_are_seen_once(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for k, ips in enumerate(([("1.1.1.1", "2.2.2.2"), ("1.1.1.1", None)], [("2.2.2.2", "3.3.3.3")], [("3.3.3.3", "1.1.1.1")])):
        spark.createDataFrame(ips, "src string, dst string").coalesce(1).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema("src string, dst string").option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        slots.watch_addresses(stream, f"{folder}/out", f"{folder}/state").awaitTermination()  # goes on from its state
    assert sorted(r.ip for r in spark.read.schema("ip string").parquet(f"{folder}/out").collect()) == ["1.1.1.1", "2.2.2.2", "3.3.3.3"]
