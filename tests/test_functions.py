from __future__ import annotations

import ipaddress
import math
import random

import pytest
from pyspark.sql import functions as F

from flowrhythm.functions import network as N
from flowrhythm.functions.lists import PRIVATE_RANGES


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_private_addresses_are_those_of_the_standard_library(spark):
    r = random.Random(1)
    ips = [str(ipaddress.IPv4Address(r.getrandbits(32))) for _ in range(800)]
    for a, b in PRIVATE_RANGES:
        for end in (a, b):
            n = int(ipaddress.IPv4Address(end))
            ips += [str(ipaddress.IPv4Address(x)) for x in (n - 1, n, n + 1) if 0 <= x < 1 << 32]
    ips += ["192.0.0.9", "192.0.0.10", "100.64.0.1", "224.0.0.1", "::1", "fe80::1", "2001:4860:4860::8888", "fd00::5", "", "1.2.3", "01.2.3.4", "256.1.1.1", "x", "a:b"]

    def private(x: str) -> bool:
        try:
            return ipaddress.ip_address(x).is_private
        except ValueError:
            return False

    df = spark.createDataFrame([(x,) for x in ips] + [(None,)], "ip string")
    for row in df.select("ip", N.is_private(F.col("ip"), ipv6=True).alias("all"), N.is_private(F.col("ip")).alias("v4")).collect():
        assert row.all == (row.ip is not None and private(row.ip)), row
        assert row.v4 == (row.ip is not None and ":" not in row.ip and private(row.ip)), row


@pytest.mark.parametrize(("host", "want"), [("a.b.c.d", "c.d"), ("localhost", "localhost"), (" x.org ", "x.org"), ("", None), (None, None), ("drive.google.com", "google.com")])
def test_sld(spark, host, want):
    assert one(spark, N.sld(F.col("h")), h=host) == want


def test_ratios(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (0.0, 3.0), (None, 1.0)], "a double, b double")
    assert [r.x for r in rows.select(N.ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [0.5, math.inf, None, 0.0, None]
    assert [r.x for r in rows.select(N.share(F.col("a"), F.col("b")).alias("x")).collect()] == [0.5, None, None, 0.0, None]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,), (None,)], "x double")
    assert [r.x for r in odd.select(N.finite(F.col("x")).alias("x")).collect()] == [None, None, 2.0, None]


def test_circular_sd_and_variation(spark):
    values = [1430.0, 10.0, 20.0, 1400.0]
    got = spark.createDataFrame([(v,) for v in values], "m double").agg(N.circular_sd(F.col("m")).alias("c"), N.variation(F.col("m")).alias("v")).first()
    angle = [2 * math.pi * v / 1440 for v in values]
    r = math.hypot(sum(map(math.cos, angle)), sum(map(math.sin, angle))) / 4
    assert abs(got.c - math.sqrt(-2 * math.log(r)) * 1440 / (2 * math.pi)) < 1e-9
    two = spark.createDataFrame([(5.0,), (5.0,)], "m double").agg(N.circular_sd(F.col("m")).alias("c"), N.variation(F.col("m")).alias("v")).first()
    assert two.c is None and two.v == 0


def test_masks_and_clock(spark):
    df = spark.createDataFrame([("udp", 68, 1), ("TCP", 68, 1), ("UDP", None, 547), (None, 67, 67), ("UDP", 1, 2)], "p string, s int, d int")
    assert [r.x for r in df.select(N.dhcp_row(F.col("p"), F.col("s"), F.col("d")).alias("x")).collect()] == [True, False, True, False, False]
    df = spark.createDataFrame([("facebook.com", 80), (None, 443), ("x.org", 80), (None, None)], "s string, d int")
    assert [r.x for r in df.select(N.chat_row(F.col("s"), F.col("d")).alias("x")).collect()] == [True, True, False, False]
    df = spark.createDataFrame([("how+to+hang",), ("HOWTOHANG",), ("nothing",), (None,)], "q string")
    assert [r.x for r in df.select(N.matches("method", F.col("q")).alias("x")).collect()] == [True, True, False, False]
    assert one(spark, N.minutes_from_22(F.col("m")), m=1380.0) == 60 and one(spark, N.minutes_from_22(F.col("m")), m=30.0) == 150
