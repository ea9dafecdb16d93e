"""Column functions over packet rows."""

from __future__ import annotations

import ipaddress
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrhythm.functions.lists import CATEGORIES, CHAT_PORTS, DHCP_PORTS, PATTERNS, PRIVATE_RANGES, PUBLIC_INSIDE

MICROS = 1_000_000


def micros(ts: str = "Timestamp") -> Column:
    """Microseconds since 1970 on the clock of the timestamp itself, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{ts}` AS TIMESTAMP_NTZ))")


def hour_of(us: Column) -> Column:
    return F.pmod(F.floor(us / F.lit(3600 * MICROS)), F.lit(24)).cast("int")


def minute_of(us: Column) -> Column:
    """Minutes since 1970."""
    return F.floor(us / F.lit(60 * MICROS))


def clock_minutes(us: Column) -> Column:
    """Minutes of the day with their fraction."""
    return F.pmod(us, F.lit(86400 * MICROS)) / F.lit(60.0 * MICROS)


def finite(x: Column) -> Column:
    """x, or null where it is not a number or infinite."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b; infinity for a positive a over nothing; null where both are nothing."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b > 0, a / b).when(a > 0, F.lit(float("inf")))


def share(a: Column, b: Column) -> Column:
    """a / b, null unless b is positive."""
    return F.when(b > 0, a.cast("double") / b.cast("double"))


def sld(host: Column) -> Column:
    """The last two labels of a host name; a single label stays; nothing for nothing."""
    h = F.trim(host)
    return F.when(F.length(host) > 0, F.substring_index(h, ".", -2))


@F.pandas_udf(T.BooleanType())
def _private_v6(ip: pd.Series) -> pd.Series:
    def one(x: str | None) -> bool:
        try:
            return x is not None and ipaddress.ip_address(x.strip()).is_private
        except ValueError:
            return False

    return ip.map(one)


def _private_pattern() -> str:
    """One pattern for all private ranges: equal octets as they are, the first that differs as a choice, none after it."""
    out = []
    for a, b in PRIVATE_RANGES:
        parts = []
        for x, y in zip(a.split("."), b.split(".")):
            if x != y:
                if (x, y) != ("0", "255"):
                    parts.append("(" + "|".join(map(str, range(int(x), int(y) + 1))) + ")")
                break
            parts.append(x)
        out.append(r"\.".join(parts) + r"\.")
    return "^(" + "|".join(out) + ")"


_OCTET = "(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def is_private(ip: Column, ipv6: bool = False) -> Column:
    """Whether an address is private; false for anything else, null included. IPv6 goes to the workers, and only if asked for."""
    v4 = F.coalesce(ip.rlike(_private_pattern()) & ip.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$") & ~ip.isin(*PUBLIC_INSIDE), F.lit(False))
    if not ipv6:
        return v4
    return F.when(F.instr(ip, ":") > 0, _private_v6(ip)).otherwise(v4)


def in_category(name: str, column: Column) -> Column:
    return F.coalesce(column.isin(*CATEGORIES[name]), F.lit(False))


def chat_row(sld_: Column, dport: Column) -> Column:
    return in_category("social", sld_) | F.coalesce(dport.isin(*CHAT_PORTS), F.lit(False))


def dhcp_row(protocol: Column, sport: Column, dport: Column) -> Column:
    return F.coalesce(F.upper(protocol) == "UDP", F.lit(False)) & (F.coalesce(sport.isin(*DHCP_PORTS), F.lit(False)) | F.coalesce(dport.isin(*DHCP_PORTS), F.lit(False)))


def matches(name: str, column: Column) -> Column:
    return F.coalesce(column.rlike(f"(?i){PATTERNS[name]}"), F.lit(False))


def circular_parts(minutes: Column) -> tuple[Column, Column, Column]:
    """Aggregates that add up: sums of cosines and sines of times of the day, and their number."""
    angle = minutes * (2 * math.pi / 1440)
    return F.sum(F.cos(angle)), F.sum(F.sin(angle)), F.count(minutes)


def circular_of(cos: Column, sin: Column, n: Column, least: int = 3) -> Column:
    """The circular standard deviation, in minutes, from the parts; null below `least` values or without any common direction."""
    r = F.sqrt(F.pow(cos, 2) + F.pow(sin, 2)) / n
    return F.when((n >= least) & (r > 0), F.sqrt(F.greatest(F.lit(0.0), -2 * F.log(F.least(r, F.lit(1.0))))) * (1440 / (2 * math.pi)))


def circular_sd(minutes: Column, least: int = 3) -> Column:
    """Aggregate: the circular standard deviation of times of the day."""
    return circular_of(*circular_parts(minutes), least)


def variation(x: Column) -> Column:
    """Aggregate: sample standard deviation over the mean; null below two values or without a positive mean."""
    return F.when((F.count(x) >= 2) & (F.avg(x) > 0), F.stddev_samp(x) / F.avg(x))


def minutes_from_22(minutes: Column) -> Column:
    """Minutes of the day counted from 22:00, past midnight."""
    return F.pmod(minutes - 1320, F.lit(1440.0))
