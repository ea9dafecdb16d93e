from __future__ import annotations

import json
import math
import random
import tempfile
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowrhythm.operators import catalog, overview, score, status, tune
from flowrhythm.operators.baseline import absolute_z, circular_spread, delta_from_median
from flowrhythm.sources import packets as P
from flowrhythm.streaming import slots


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(7)
    rows = [(e, date(2024, 1, 1) + timedelta(days=d), None if r.random() < 0.3 else round(r.uniform(0, 1440), 2)) for e in ("a", "b") for d in range(60) if r.random() < 0.8]
    return spark.createDataFrame(rows, "e string, Date date, v double")


def test_history(table):
    rows = table.toPandas().sort_values(["e", "Date"])
    z = {(r.e, r.Date): r.abs_z for r in absolute_z(table, "v", ("e",)).collect()}
    c = {(r.e, r.Date): r.spread for r in circular_spread(table, "v", ("e",)).collect()}
    d = {(r.e, r.Date): r.delta for r in delta_from_median(table, "v", ("e",)).collect()}
    for e, own in rows.groupby("e"):
        values = own.v.tolist()
        for k, day in enumerate(own.Date):
            valued = [x for x in values[:k] if not math.isnan(x)]
            last, now = valued[-30:], values[k]
            want = abs(now - np.mean(last)) / np.std(last, ddof=1) if len(last) >= 7 and not math.isnan(now) else None
            assert z[e, day] == (None if want is None else pytest.approx(want))
            a = np.array(valued[-14:]) * 2 * np.pi / 1440
            want = np.sqrt(-2 * np.log(np.hypot(np.cos(a).sum(), np.sin(a).sum()) / len(a))) * 1440 / (2 * np.pi) if len(a) >= 3 else None
            assert c[e, day] == (None if want is None else pytest.approx(want))
            window = [x for x in values[max(0, k - 28) : k] if not math.isnan(x)]
            want = now - np.median(window) if window and not math.isnan(now) else None
            assert d[e, day] == (None if want is None else pytest.approx(want))


def test_worked_score(spark):
    inf = float("inf")
    spec = spark.createDataFrame([("C2", "a", 0.5, "tri", 0.0, 1.0, inf, False), ("C2", "b", 0.3, "tri", 0.0, 1.0, inf, False), ("C2", "c", 0.2, "tri", 0.0, 1.0, inf, False)], score.SPEC)
    daily = spark.createDataFrame([(date(2024, 1, 1), 0.75, 0.87, 0.89)], "Date date, a double, b double, c double")
    assert score.group_scores(daily, spec, ("Date",)).first().L_C2 == pytest.approx(0.814)


def reference_mu(x, lo, mid, hi, invert):
    if x is None or not math.isfinite(x):
        return 0.0
    if lo == mid == hi:
        return 1.0
    up = 1.0 if math.isinf(lo) or x >= mid else max(0.0, (x - lo) / max(1e-9, mid - lo))
    down = 1.0 if math.isinf(hi) or x <= mid else max(0.0, (hi - x) / max(1e-9, hi - mid))
    mu = min(up, down)
    if not (math.isinf(lo) or math.isinf(hi)) and (x <= lo or x >= hi):
        mu = 0.0
    return 1 - mu if invert else mu


def test_memberships(spark):
    inf = float("inf")
    xs = [None, float("nan"), inf, -inf, -1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0]
    shapes = [(0.0, 1.0, 2.0), (-inf, 1.0, 2.0), (0.0, 1.0, inf), (-inf, 1.0, inf), (1.0, 1.0, 1.0), (0.0, 0.0, 2.0), (0.0, 2.0, 2.0)]
    rows = [(x, *s, i) for x in xs for s in shapes for i in (False, True)]
    df = spark.createDataFrame(rows, "x double, lo double, mid double, hi double, i boolean")
    got = df.withColumn("mu", score.triangle(*(F.col(c) for c in ("x", "lo", "mid", "hi", "i")))).collect()
    assert all(r.mu == pytest.approx(reference_mu(*r[:5])) for r in got)
    flat = spark.createDataFrame([(x,) for x in xs], "x double").select(score.clipped(F.col("x")).alias("c")).collect()
    assert [r.c for r in flat] == [0, 0, 1, 0, 0, 0, 0.5, 1, 1, 1, 1]


def test_presence_and_flag(spark):
    days = [(date(2024, 1, 1) + timedelta(days=k), float(k % 3 == 0)) for k in range(10)]
    scores = spark.createDataFrame([(d, *(v if g in ("C1", "C2") else 0.0 for g in score.GROUPS)) for d, v in days], "Date date, " + ", ".join(f"L_{g} double" for g in score.GROUPS))
    got = score.overall(score.presence(scores, (), gate={"M": 4, "N": 2, "theta": 0.5}), ["C2"], 2).orderBy("Date").collect()
    assert [r.present_C2 for r in got] == [sum(k % 3 == 0 for k in range(max(0, i - 3), i + 1)) >= 2 for i in range(10)]
    assert [r.flag for r in got] == [r.present_C2 for r in got] and score.latest(scores, ()).first().Date == date(2024, 1, 10)


def test_spec_shapes(spark):
    a = {"M": "7", "theta": 0.5, "core": "C4", "C1": {"IS": {"weight": "0.4", "lo": 1, "mid": 2, "hi": "Infinity", "invert": "yes"}, "unknown": {"w": 1}}}
    b = {"criteria": {"C1": {"metrics": [{"metric": "IS", "w": 0.4, "mf": {"lo": 1, "mid": 2, "hi": float("inf"), "invert": True}}]}}, "M": 7, "theta": 0.5, "core_symptoms": ["C4", "C99"]}
    want = ({"M": 7, "N": 10, "theta": 0.5, "core_symptoms": ["C4"]}, [("C1", "IS", 0.4, "tri", 1.0, 2.0, float("inf"), True)])
    assert score.parse_spec(a) == score.parse_spec(json.dumps(b)) == want
    assert score.parse_spec(score.write_spec(*want)) == want and score.parse_spec("[]") == (score.GATE, [])
    assert score.default_spec(spark).count() == 27 and status.catalog(spark).count() == 78


def test_status_with_overrides(spark):
    long = spark.createDataFrame([("IV", 0.8), ("IV", 0.9), ("IS", 0.5), ("IS", None), ("IS", float("inf")), ("IS", 0.4)], "metric string, value double")
    plain = [r.status for r in status.with_status(long, status.catalog(spark)).collect()]
    assert sorted(plain) == ["Caution", "Caution", "N/A", "N/A", "OK", "OK"]
    over = spark.createDataFrame([("IV", 0.95, None)], "metric string, ok double, higher_is_worse boolean")
    shown = status.with_status(long, status.catalog(spark), over)
    assert status.filtered(shown).first().status == "OK" and shown.where("metric = 'IV' and status = 'OK'").count() == 2


def naive_tune(x, starts=(0.15, 0.5, 0.85)):
    c = np.quantile(x, starts)
    for _ in range(100):
        own = np.abs(x[:, None] - c).argmin(1)
        new = np.array([x[own == k].mean() if (own == k).any() else c[k] for k in range(3)])
        if np.allclose(new, c, rtol=1e-5, atol=1e-8):
            return new
        c = new
    return c


def test_auto_tune(spark):
    r = np.random.default_rng(2)
    rows = [(e, float(v), float(w)) for e in ("a", "b") for v, w in zip(r.normal(size=60), r.exponential(size=60))] + [("c", 1.0, None), ("c", 2.0, None)]
    got = {(x.e, x.metric): x for x in tune.auto_tune(spark.createDataFrame(rows, "e string, m double, n double"), {"m": True, "n": False}, ("e",)).collect()}
    for e in ("a", "b"):
        x = np.array([v for k, v, _ in rows if k == e])
        c = naive_tune(x)
        g = got[e, "m"]
        assert np.allclose([g.c1, g.c2, g.c3], np.sort(c)) and g.n1 + g.n2 + g.n3 == 60 and not g.invert and got[e, "n"].invert
        assert g.lo == pytest.approx((g.c1 + g.c2) / 2) and g.w + got[e, "n"].w == pytest.approx(1)
    assert (got["c", "n"].c1, got["c", "n"].w, got["c", "m"].c2) == (0, 0, 1.5)


def test_sources(spark):
    decoded = spark.createDataFrame(
        [(datetime(2024, 1, 1, 5, 3), "a", "b", True, False, 1, 2, "S", 60, True, 0, "x.org.", 1, []), (datetime(2024, 1, 1, 5, 9), "a", "b", False, True, 1, 2, "S", 60, True, 1, "x.org.", 1, [("y.org.", "1.1.1.1"), ("z", "2.2.2.2")])],
        "ts timestamp_ntz, ip_src string, ip_dst string, has_tcp boolean, has_udp boolean, sport int, dport int, flags string, length int, has_dns boolean, dns_qr int, qname string, qtype int, answers array<struct<name: string, rdata: string>>",
    )
    rows = P.normalise(decoded, "onu_1")
    a, b = rows.orderBy("Timestamp").collect()
    assert (a.Protocol, a.DNS_QNAME, a.DNS_ANS_NAME, a.Hour) == ("TCP", "x.org", None, 5) and (b.Protocol, b.DNS_QNAME, b.DNS_ANS_NAME, b.DNS_ANS_IPS) == ("UDP", None, "y.org", "1.1.1.1,2.2.2.2")
    folder = tempfile.mkdtemp(prefix="spark-")
    P.write_slots(rows, f"{folder}/p")
    day = P.read_day(spark, f"{folder}/p", "2024-01-01")
    assert day.count() == 2 and P.read_range(spark, f"{folder}/p", "2024-01-01 05:04:00", "2024-01-02", ["onu_1"]).count() == 1
    assert [r.slot_start.minute for r in day.orderBy("Timestamp").collect()] == [0, 5]
    now = P.fingerprints(P.file_table(spark.read.parquet(f"{folder}/p")))
    assert len(now.first().Fingerprint) == 32 and P.stale_days(now, now).count() == 0
    cached = spark.createDataFrame([(date(2024, 1, 1), "old", 1.0), (date(2023, 1, 1), "kept", 2.0)], "Date date, Fingerprint string, m double")
    current = spark.createDataFrame([(date(2024, 1, 1), "new"), (date(2023, 1, 1), "kept")], "Date date, Fingerprint string")
    assert [r.Date for r in P.stale_days(current, cached).collect()] == [date(2024, 1, 1)]
    fresh = spark.createDataFrame([(date(2024, 1, 1), "new", 5.0)], cached.schema)
    assert sorted(r.m for r in P.rebuilt(cached, fresh, current).collect()) == [2.0, 5.0]
    P.write_daily(cached, folder, ["b", "a"], "csv")
    assert P.read_daily(spark, folder, ["a", "b"], "csv", "Date date, Fingerprint string, m double").count() == 2
    names = spark.createDataFrame([("x__20240102_0305.parquet",), ("x.parquet",)], "f string").select(P.slot_of_file(F.col("f")).alias("s")).collect()
    assert [r.s for r in names] == [datetime(2024, 1, 2, 3, 5), None]
    odd = spark.createDataFrame([(None, "2024-01-01", 7), ("2024-01-02 03:04:05", None, None), ("bad", None, None)], "Timestamp string, Date string, Hour int")
    assert [r.Timestamp for r in P.with_time(odd).collect()] == [datetime(2024, 1, 1, 7), datetime(2024, 1, 2, 3, 4, 5), None]
    with open(f"{folder}/users.json", "w") as f:
        json.dump([{"username": "u", "ip_addresses": ["1.1.1.1", " "]}, {"username": "v", "ip_addresses": ["1.1.1.1", "2.2.2.2"]}], f)
    users = P.read_users(spark, f"{folder}/users.json")
    traffic = spark.createDataFrame([("1.1.1.1", "2.2.2.2"), ("1.1.1.1", "9.9.9.9"), (None, "8.8.8.8")], "src string, dst string")
    assert sorted(r.User for r in catalog.with_user(traffic, users).collect()) == ["", "v", "v"]
    assert catalog.touching(traffic, ["9.9.9.9"]).count() == 1 and catalog.touching(traffic, users).count() == 2 and catalog.touching(traffic, []).count() == 0


def test_streaming_slots(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    t0 = datetime(2024, 1, 1)
    batch = lambda name, at: spark.createDataFrame([(t0 + timedelta(seconds=s), "d", 10, "a", "b") for s in at], "Timestamp timestamp_ntz, Dataset string, length long, src string, dst string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    schema = "Timestamp timestamp_ntz, Dataset string, length long, src string, dst string"
    read = lambda: spark.readStream.schema(schema).parquet(f"{folder}/in")

    def ingest():
        slots.write_packets(read(), f"{folder}/packets", f"{folder}/c1").awaitTermination()
        slots.write_counts(read(), f"{folder}/counts", f"{folder}/c2").awaitTermination()
        slots.watch_addresses(read(), f"{folder}/ips", f"{folder}/c3").awaitTermination()

    for k, at in enumerate(([1, 2, 299], [301, 700], [3000], [3001, 4], [6000])):
        batch(k, at)
        ingest()
    counts = {(r.slot_start - t0).seconds: r.packets for r in spark.read.parquet(f"{folder}/counts").collect()}
    assert counts == {0: 3, 300: 1, 600: 1, 3000: 2}  # the row at 4 s came too late to be counted
    assert spark.read.parquet(f"{folder}/packets").count() == 9 and spark.read.parquet(f"{folder}/ips").count() == 2
    whole = {(r.slot_start - t0).seconds: r.packets for r in slots.slot_counts(spark.read.parquet(f"{folder}/in")).collect()}
    assert whole == {0: 4, 300: 1, 600: 1, 3000: 2, 6000: 1}
    report = slots.ingest_report(spark.read.parquet(f"{folder}/counts")).first()
    assert (report.slots, report.rows) == (4, 7)
    counted, sink = spark.read.parquet(f"{folder}/counts"), spark.read.parquet(f"{folder}/packets")
    flushed = slots.with_open_slots(counted, sink)
    assert {(r.slot_start - t0).seconds: r.packets for r in flushed.collect()} == {0: 3, 300: 1, 600: 1, 3000: 2, 6000: 1}
    assert slots.ingest_report(flushed).first().rows == 8
    assert slots.with_open_slots(counted.where("false"), sink).groupBy().sum("packets").first()[0] == 9


def test_catalog_names(spark):
    df = spark.createDataFrame([("ONU_capture_Home_12",), ("bras-x-3",), ("lab",)], "Dataset string")
    got = sorted((r.Dataset, r.type, r.prefix, r.token) for r in catalog.datasets(df).collect())
    assert got == [("ONU_capture_Home_12", "ONU", "ONU_capture_Home", "home"), ("bras-x-3", "BRAS", "bras-x", "bras-x"), ("lab", "Other", "lab", "lab")]
    box = overview.distribution(spark.createDataFrame([("m", float(k)) for k in range(5)] + [("m", None), ("n", float("inf"))], "metric string, value double")).collect()
    assert [tuple(r) for r in box] == [("m", 5, 0.0, 1.0, 2.0, 3.0, 4.0)]




def test_rebuild_writes_only_stale_days(spark):
    """New and changed days are built and replace their partitions; the others keep their files."""
    import glob
    import tempfile

    from flowrhythm.sources.packets import rebuild_daily

    path = f"{tempfile.mkdtemp(prefix='spark-')}/daily"
    built = []

    def build(days):
        built.append(sorted(str(r.Date) for r in days.collect()))
        return days.selectExpr("Date", f"CAST({len(built)} AS DOUBLE) AS x")

    days = lambda *rows: spark.createDataFrame(rows, "Date string, Fingerprint string").selectExpr("CAST(Date AS DATE) AS Date", "Fingerprint")
    rebuild_daily(path, days(("2024-01-01", "a"), ("2024-01-02", "b")), None, build)
    kept = glob.glob(f"{path}/Date=2024-01-01/*.parquet")
    rebuild_daily(path, days(("2024-01-01", "a"), ("2024-01-02", "c"), ("2024-01-03", "d")), spark.read.parquet(path), build)
    assert built == [["2024-01-01", "2024-01-02"], ["2024-01-02", "2024-01-03"]]
    assert sorted((str(r.Date), r.x, r.Fingerprint) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1.0, "a"), ("2024-01-02", 2.0, "c"), ("2024-01-03", 2.0, "d")]
    assert glob.glob(f"{path}/Date=2024-01-01/*.parquet") == kept


def test_unreadable_files_are_passed_over(spark):
    import tempfile

    from flowrhythm.sources.packets import read_range, write_slots

    path = f"{tempfile.mkdtemp(prefix='spark-')}/packets"
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 10:00:00' AS Timestamp, DATE'2024-01-01' AS Date, 10 AS Hour, 'a' AS Dataset, CAST(5 AS BIGINT) AS Length")
    write_slots(rows, path)
    with open(f"{path}/Dataset=a/Date=2024-01-01/broken.parquet", "wb") as f:
        f.write(b"PAR1 no parquet at all PAR1")
    assert read_range(spark, path, "2024-01-01", "2024-01-02").count() == 1


def test_cached_values_go_first(spark):
    from flowrhythm.plans.registry import with_precedence

    computed = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 4.0), (3, 5.0, None)], "Date int, a double, b double")
    cached = spark.createDataFrame([(1, 9.0, "x"), (2, 8.0, "x"), (3, None, "x"), (4, 7.0, "x")], "Date int, a double, b_other string")
    assert sorted(map(tuple, with_precedence(computed, cached).collect())) == [(1, 9.0, 2.0), (2, 8.0, 4.0), (3, 5.0, None)]
