"""Slot states against the rebuild from packets, and ordered ranges against slots."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from flowrhythm.operators import gaps
from flowrhythm.operators.enrich import enrich
from flowrhythm.plans import metrics as M
from flowrhythm.plans.states import TABLES, SlotStates, slot_number
from flowrhythm.sources.views import packets

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(df):
    out = {}
    for r in df.collect():
        out[str(r.Date), r.asDict().get("Dataset")] = {k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items()}
    return out


def test_late_slots_equal_a_rebuild(spark):
    keys = ("Dataset", "Date")
    p = packets(spark, DIR, True).where("Date < '2024-01-03' and Dataset <> 'lab_03'").cache()
    late = p.select(*keys, slot_number().alias("slot")).distinct().where(F.col("slot") % 7 == 3)
    asked = []

    def of(rows):
        def get(slots):
            asked.append({tuple(r) for r in slots.collect()})
            return rows.join(slots.select("Date").distinct(), "Date", "left_semi")

        return get

    states = SlotStates(spark, f"{tempfile.mkdtemp(prefix='spark-')}/states", keys)
    early = p.withColumn("slot", slot_number()).join(late, [*keys, "slot"], "left_anti").drop("slot")
    # half of a slot comes first, and one that goes again
    early = early.unionByName(p.where((slot_number() % 7 == 3) & (F.col("tie") % 2 == 0)))
    gone = p.where((slot_number() % 11 == 5)).withColumns({"us": F.col("us") + 1, "tie": F.col("tie") + 10_000_000})
    states.update(early.unionByName(gone).select(*keys, slot_number().alias("slot")), of(early.unionByName(gone)))
    asked.clear()
    changed = late.unionByName(gone.select(*keys, slot_number().alias("slot"))).distinct()
    done = {tuple(r) for r in states.update(changed, of(p)).collect()}
    want = {tuple(r) for r in changed.collect()}
    every = p.select(*keys, slot_number().alias("slot")).distinct().count()
    assert asked[0] == want and done >= want and len(done) < every
    some = spark.sql("SELECT DATE'2024-01-02' AS Date")
    want = plain(M.daily(enrich(p, keys), keys))
    assert plain(states.daily(some)) == {k: v for k, v in want.items() if k[0] == "2024-01-02"}
    # a failed update: rows without a manifest change nothing
    states._append("minutes", states.table("minutes"), "lost")
    assert plain(states.daily()) == want


def test_a_slot_is_reduced_once_more_only_for_new_names(spark):
    schema = "Date date, us long, tie long, src string, dst string, sport int, dport int, length long, protocol string, is_dns boolean, qname string, ans_name string, ans_ips string, url string, http_path string, path string, flow_sec double, present array<string>"
    row = lambda us, dst, name=None, ips=None: (None, us * 1_000_000, us, "10.0.0.1", dst, 1, 443, 60, "UDP", ips is not None, None, name, ips, None, None, None, None, ["src", "dst", "length"])
    date = F.lit("1970-01-01").cast("date")
    base = spark.createDataFrame([row(1000, "1.1.1.1"), row(2000, "2.2.2.2"), row(3000, "3.3.3.3")], schema).withColumn("Date", date)
    late = spark.createDataFrame([row(5000, "9.9.9.9", "www.github.com", "2.2.2.2, 7.7.7.7")], schema).withColumn("Date", date)
    states = SlotStates(spark, f"{tempfile.mkdtemp(prefix='spark-')}/states")
    states.update(base.select("Date", slot_number().alias("slot")), lambda s: base)
    both = base.unionByName(late)
    done = states.update(late.select("Date", slot_number().alias("slot")), lambda s: both)
    assert {r.slot for r in done.collect()} == {5000 // 300, 2000 // 300}
    assert states.table("values").where("which = 'sld'").count() == 2
    assert plain(states.daily()) == plain(M.daily(enrich(both), ("Date",)))


def test_tables_without_rows_can_be_read(spark):
    states = SlotStates(spark, f"{tempfile.mkdtemp(prefix='spark-')}/states")
    assert all(states.table(n).count() == 0 for n in TABLES)


def test_ranges_equal_slots(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("id") % 3).cast("string"))).alias("g"), F.when(F.col("id") % 10 < 9, F.lit(7_000_000)).otherwise(F.col("id") * 977_777 % 90_000_000_000).alias("us"),
        (F.col("id") * 7919 % 3001).alias("tie"), (F.col("id") % 4 == 0).alias("inbound"))
    key = lambda df: sorted(map(str, df.select("g", "us", "tie", "inbound", "prev_us", "prev_inbound").collect()))
    want = key(gaps.with_previous(rows, ("g",), ("us", "inbound")))
    assert key(gaps.previous_by_ranges(rows, ("g",), ("us", "inbound"), 170)) == want
    assert key(gaps.previous_by_ranges(rows, ("g",), ("us", "inbound"), 10_000)) == want
    assert gaps.previous_by_ranges(rows.limit(0), ("g",), ("us", "inbound")).count() == 0


def test_no_range_is_large_with_most_rows_in_one_slot(spark, monkeypatch):
    rows = spark.range(20_000).select(F.lit("a").alias("Date"), F.when(F.col("id") % 10 < 9, F.lit(300_000_000) + F.col("id") % 50).otherwise(F.col("id") * 1_000_000).alias("us"), F.col("id").alias("tie"), F.lit(True).alias("inbound"))
    assert gaps.busiest_slot(rows, ("Date",)) >= 18_000
    sizes = []
    real = gaps.written
    monkeypatch.setattr(gaps, "written", lambda df, name: (found := real(df, name), sizes.extend(r["count"] for r in found.groupBy("__range").count().collect()))[0])
    monkeypatch.setattr(gaps, "SLOT_ROWS", 5000)
    monkeypatch.setattr(gaps, "RANGE_ROWS", 1000)
    monkeypatch.setattr(gaps.previous_by_ranges, "__defaults__", (1000,))
    found = gaps.with_previous(rows, ("Date",), ("us",), busiest=18_000)
    assert found.count() == 20_000 and max(sizes) <= 3000 and len(sizes) >= 15
