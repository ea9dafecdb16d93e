"""Packet files: even stretches of time, listing, compaction, exports."""

from __future__ import annotations

import glob
import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from flowrhythm.sources import packets as S


def made(spark, n=12_000):
    """A dataset-hour has most rows."""
    at = F.when(F.col("id") % 10 < 9, F.lit(36_000) + F.col("id") % 3600).otherwise(F.col("id") * 13 % 86_400)
    rows = spark.range(n).select(F.col("id").alias("tie"), F.when(F.col("id") % 21 == 7, "b").otherwise("a").alias("Dataset"), F.expr("DATE'2024-01-02'").alias("Date"), at.alias("s"), F.lit(60).cast("long").alias("length"))
    return rows.withColumn("Timestamp", F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00' + make_dt_interval(0, 0, 0, s)")).drop("s")


def test_files_hold_even_stretches_of_time(spark):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/packets"
    rows = made(spark)
    S.write_slots(rows, path, file_rows=1500)
    own = glob.glob(f"{path}/Dataset=a/*/*.parquet")
    spans = []
    for f in own:
        m = pq.ParquetFile(f).metadata
        at = [m.schema.column(i).name for i in range(m.num_columns)].index("Timestamp")
        stats = [m.row_group(g).column(at).statistics for g in range(m.num_row_groups)]
        spans.append((min(s.min for s in stats), max(s.max for s in stats), m.num_rows))
    spans.sort()
    assert len(own) >= 6 and max(n for *_, n in spans) <= 4500
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    # a range of ten minutes meets the statistics of few files, and the filter reaches the scan
    start, stop = "2024-01-02 10:20:00", "2024-01-02 10:30:00"
    met = [x for x in spans if str(x[1]) >= start and str(x[0]) < stop]
    found = S.read_range(spark, path, start, stop, ["a"])
    assert 0 < len(met) <= 3 and found.count() == rows.where(f"Dataset = 'a' and Timestamp >= timestamp_ntz'{start}' and Timestamp < timestamp_ntz'{stop}'").count()
    said = S.read_range(spark, path, start, stop, ["a"], schema="Timestamp timestamp_ntz, length long, URL string, Dataset string, Date date")
    assert said.count() == found.count() and said.where("URL is not null").isEmpty()
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(Timestamp" in plan and "PartitionFilters" in plan


def test_compaction_joins_small_files_of_closed_days(spark):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/packets"
    rows = made(spark, 4000)
    later = rows.withColumns({"Date": F.expr("DATE'2024-01-03'"), "Timestamp": F.expr("Timestamp + INTERVAL 1 DAY")})
    for k in range(4):
        S.write_slots(rows.unionByName(later).where(F.col("tie") % 4 == k), path)
    files = {(r.Dataset, str(r.Date)): r.n for r in S.list_files(spark, path).groupBy("Dataset", "Date").agg(F.count("*").alias("n")).collect()}
    assert set(files) == {(d, f"2024-01-0{k}") for d in "ab" for k in (2, 3)} and min(files.values()) >= 4
    days = S.scattered_days(spark, path, "2024-01-03")
    assert {(r.Dataset, str(r.Date)) for r in days.collect()} == {("a", "2024-01-02"), ("b", "2024-01-02")}
    before = {r["name"] for r in S.list_files(spark, path).where("Date = '2024-01-03'").collect()}
    S.compact(spark, path, days)
    after = S.list_files(spark, path)
    assert {r["name"] for r in after.where("Date = '2024-01-03'").collect()} == before and after.where("Date = '2024-01-02'").count() <= 3
    key = lambda df: sorted(map(tuple, df.select("tie", "Dataset", "Date", "Timestamp", "length").collect()))
    assert key(spark.read.parquet(path)) == key(rows.unionByName(later))
    assert S.scattered_days(spark, path, "2024-01-03").isEmpty()
    prints = S.fingerprints(S.list_files(spark, path))
    assert prints.count() == 2


def test_exports_and_lists(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    S.export_csv(made(spark, 50).select("tie", "Dataset"), f"{folder}/csv")
    assert spark.read.option("header", "true").csv(f"{folder}/csv").count() == 50
    spark.createDataFrame([("1.1.1.1",), (" 2.2.2.2 ",), ("",), ("1.1.1.1",)], "value string").coalesce(1).write.text(f"{folder}/ips")
    assert {r.ip for r in S.read_known_ips(spark, f"{folder}/ips").collect()} == {"1.1.1.1", "2.2.2.2"}
    made(spark, 5).coalesce(1).write.parquet(f"{folder}/day")
    import shutil

    shutil.copy(glob.glob(f"{folder}/day/*.parquet")[0], f"{folder}/home__20240102_0305.parquet")
    assert [(r.file, str(r.slot_start)) for r in S.list_slots(spark, folder).collect()] == [("home__20240102_0305.parquet", "2024-01-02 03:05:00")]
