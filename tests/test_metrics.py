from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowrhythm.operators.enrich import dns_map, enrich, with_host
from flowrhythm.operators.gaps import with_previous
from flowrhythm.operators.series import minute_measures, minutes
from flowrhythm.operators.sessions import seconds, session_windows, sessions
from flowrhythm.plans.daily import daily_table, flags, statuses
from flowrhythm.operators.score import default_spec
from flowrhythm.plans.registry import with_value
from flowrhythm.sources.packets import standard

SCHEMA = "Timestamp timestamp_ntz, Date date, Dataset string, Protocol string, `Source IP` string, `Destination IP` string, `Source Port` int, `Destination Port` int, Length bigint, IsDNS boolean, DNS_QNAME string, DNS_ANS_NAME string, DNS_ANS_IPS string, URL string, FlowDurationSec double"
START = datetime(2024, 3, 4)
HOME, OUT = "192.168.1.2", "93.184.216.1"


def packet(at, src=HOME, dst=OUT, dport=80, length=100, protocol="TCP", dns=False, qname=None, ans=None, ips=None, url=None, flow=None, sport=40000):
    ts = START + (timedelta(seconds=at) if isinstance(at, (int, float)) else at)
    return (ts, ts.date(), "onu_capture_a_1", protocol, src, dst, sport, dport, length, dns, qname, ans, ips, url, flow)


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: standard(spark.createDataFrame(rows, SCHEMA))


@pytest.fixture(scope="module")
def times(spark):
    """Random rows of three keys: bursts and pauses."""
    r = random.Random(4)
    rows = []
    for k in range(3):
        at = 0
        for _ in range(900):
            at += r.choice((0, 1, 300_000, 2_000_000, 119_999_999, 120_000_000, 120_000_001, 300_000_000, 300_000_001, 900_000_000)) if r.random() < 0.4 else r.randint(1, 40_000_000)
            if at < 86_400_000_000:
                rows.append((k, at, len(rows), r.randint(1, 100)))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "k int, us long, tie long, bytes long").repartition(5)


@pytest.mark.parametrize("gap", [120, 300, 600])
def test_sessions_against_sorting(times, gap):
    want = []
    for k, own in times.toPandas().sort_values(["us", "tie"]).groupby("k"):
        number = (own.us.diff() > gap * 1_000_000).cumsum()
        want += [(k, g.us.min(), g.us.max(), g.bytes.sum()) for _, g in own.groupby(number)]
    got = sessions(times, ("k",), gap, {"bytes": F.col("bytes")}).select("k", "first_us", "last_us", "bytes").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    stamped = times.withColumn("Timestamp", F.timestamp_micros("us"))
    windows = session_windows(stamped, ("k",), gap).select("k", F.unix_micros("first"), F.unix_micros("last")).collect()
    assert sorted(map(tuple, windows)) == sorted(x[:3] for x in want)


def test_previous_rows(times):
    got = {(r.k, r.us, r.tie): r.prev_us for r in with_previous(times, ("k",), ("us",)).collect()}
    for k, own in times.toPandas().sort_values(["us", "tie"]).groupby("k"):
        before = None
        for us, tie in zip(own.us, own.tie):
            assert got[k, us, tie] == before
            before = us


@pytest.mark.parametrize("seed", range(2))
def test_minute_series_against_dense(spark, seed):
    r = random.Random(seed)
    lo = r.randint(0, 900)
    active = sorted({r.randint(lo, r.randint(lo, 1439)) for _ in range(r.choice((1, 3, 60, 300)))})
    base = 19_786 * 1440
    rows = [("d", base + m, 1) for m in active for _ in range(r.randint(1, 4))]
    got = minute_measures(minutes(spark.createDataFrame(rows, "k string, minute long, bytes long"), ("k",)), ("k",)).first()
    s = pd.Series(0, index=range(active[0], active[-1] + 1))
    for _, m, _ in rows:
        s[m - base] += 1
    x = (s > 0).astype(float).to_numpy()
    hour = s.index.to_numpy() // 60
    ssd, n = ((x - x.mean()) ** 2).sum(), len(x)
    means = np.array([x[hour == h].mean() if (hour == h).any() else 0.0 for h in range(24)])
    near = lambda a, b: (a is None and b is None) or abs(a - b) < 1e-9
    assert near(got["IS"], n * ((means - x.mean()) ** 2).sum() / (24 * ssd) if n >= 2 and ssd > 1e-12 else None)
    assert near(got["IV"], n * (np.diff(x) ** 2).sum() / ((n - 1) * ssd) if n >= 2 and ssd > 1e-12 else None)
    assert near(got["F6_Fano"], s.var(ddof=0) / s.mean())
    hourly = s.groupby(hour).sum()
    assert near(got["F7_HourlyCV"], hourly.std(ddof=0) / hourly.mean())
    day = x[(hour >= 8) & (hour <= 17)]
    assert near(got["C4_F7_DaytimeIdleRatio0818"], (day == 0).mean() if len(day) else None)
    assert got.ActiveNightMinutes == x[hour <= 5].sum() and got.ActiveDayMinutes == x[(hour >= 8) & (hour <= 20)].sum()


def test_first_dns_answer_wins(frame):
    rows = frame([
        packet(5, dns=True, ans="late.example.com", ips="93.184.216.1"), packet(1, dns=True, ans="www.first.com", ips="93.184.216.9, 93.184.216.1"), packet(2, dns=True, qname="asked.org"),
        packet(9), packet(10, dst="1.1.1.1", qname="own.net"),
    ])
    assert {(r.ip, r.host) for r in dns_map(rows).collect()} == {("93.184.216.9", "www.first.com"), ("93.184.216.1", "www.first.com")}
    named = {r.us % 86_400_000_000 // 1_000_000: r.SLD for r in with_host(rows).collect()}
    assert named == {5: "first.com", 1: "first.com", 2: "first.com", 9: "first.com", 10: "own.net"}


def test_a_small_day(frame):
    day = [
        packet(3600, dport=443), packet(3601, src=OUT, dst=HOME, sport=443, dport=40000, length=900), packet(3601.5, dport=5222), packet(3603, dport=5222), packet(3603.4, dport=5222),
        packet(8 * 3600, url="https://x/r/selfharm/1", flow=3.0), packet(8 * 3600 + 20, url="https://x/SETTINGS", flow=2.5), packet(8 * 3600 + 40, url="https://x/unsubscribe"), packet(12 * 3600, protocol="UDP", sport=68, dport=67, dst="255.255.255.255"),
        packet(14 * 3600, protocol="UDP", sport=68, dport=67, dst="255.255.255.255"), packet(22 * 3600), packet(23 * 3600, length=None),
    ]
    r = daily_table(frame(day)).first()
    assert r.n_total_packets_today == 12 and r.n_night_packets_today == 5 and r.night_pkts_today == 7 and r.day_pkts_today == 5
    assert r.F4_DownUpRatio == 900 / 800 and r.LateNightShare == 5 / 12 and r.LongestInactivityHours == 8
    assert r.C5_F1_DhcpPerHour == 2 / 22 and r.C5_F2_WifiDwellMin == 120
    assert r.C5_F3_MedianIKS == pytest.approx((0.4 + 1.5) / 2) or r.C5_F3_MedianIKS == pytest.approx(1.5)
    assert r.C6_F8_FirstActivityMin == 480 and r.C6_F1_LongestMiddayIdleMin == 240
    assert r.C7_F6_SettingsPrivacyDwellSec == 2.5 and r.C7_F5_AccountDeleteUnsubCount == 1 and r.C9_F4_SelfHarmForumVisits == 1 and r.C9_F6_SelfHarmForumMeanSessLenSec == 0
    assert r.C2_F3_ChatSessionCount == 1 and r.C8_F3_NotificationMicroSessionsCount == 1
    assert r.C8_F1_MedianPageDwellSec is None and r.C4_F3_OnsetVar14dMin is None and r.C6_F9_ActivationDelayVsBase28d is None
    assert r.C4_F1_OnsetLocalMin == 60 + 3.4 // 1 / 60


def test_absent_columns(spark):
    rows = spark.createDataFrame([(START + timedelta(minutes=k), START.date(), "TCP", 443) for k in range(3)], "Timestamp timestamp_ntz, Date date, Protocol string, `Destination Port` int")
    r = daily_table(standard(rows)).first()
    assert r.down_bytes_today is None and r.F4_DownUpRatio is None and r.C2_F4_MeanUpstreamRateBps is None and r.C8_F3_NotificationMicroSessionsCount is None
    assert r.C2_F7_SocialOutgoingShareUp == 1 and r.C2_F3_ChatSessionCount == 1 and r.C9_F4_SelfHarmForumVisits == 0 and r.C7_F5_AccountDeleteUnsubCount is None
    assert daily_table(standard(rows.limit(0))).count() == 0


def test_streaming_inbound(frame):
    day = [packet(0, dns=True, ans="cdn.netflix.com", ips=HOME)] + [packet(60 * k, src=OUT, dst=HOME, length=10) for k in range(0, 125, 4)]
    d = daily_table(frame(day))
    d = d.sparkSession.createDataFrame(d.collect(), d.schema)
    r = d.first()
    assert r.F3_LongStreams == 1 and r.C2_F5_PassiveActiveByteRatio == float("inf")
    shown = {x.metric: x.status for x in statuses(d).collect()}
    assert shown["C2_F5_PassiveActiveByteRatio"] == "N/A" and shown["F3_LongStreams"] == "Caution" and len(shown) == 78


def test_additive_counters_pool(frame, spark):
    rows = frame([packet(37 * k, dport=(443, 80)[k % 2]) for k in range(200)]).withColumn("Dataset", F.when(F.col("us") % 2 == 0, "a").otherwise("b"))
    pooled, parts = daily_table(rows).first(), daily_table(rows, ("Dataset", "Date"), ("Date",)).agg(F.sum("n_total_packets_today").alias("n"), F.sum("up_bytes_today").alias("b")).first()
    assert (pooled.n_total_packets_today, pooled.up_bytes_today) == (parts.n, parts.b)
    assert flags(daily_table(rows), default_spec(spark)).first().flag is False


def test_references(frame, spark):
    d = daily_table(frame([packet(k) for k in range(5)]))
    d = spark.createDataFrame(d.collect(), d.schema)
    get = lambda ref, **kw: with_value(d, ref, "x", **kw).first().x
    assert get("TODAY:n_total_packets_today") == 5 and get("CONST:1.5") == 1.5 and get("AUX:a", aux={"a": 2}) == 2
    assert get("FUNC:PostChatCount") == 0 and get("FUNC:DELTA_FROM_MEDIAN(col='n_total_packets_today', window=3)") is None
    assert all(get(x) is None for x in ("TODAY:no", "FUNC:No(x=1)", "CONST:y", "nothing", "AUX:b"))
