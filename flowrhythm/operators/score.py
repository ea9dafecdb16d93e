"""Fuzzy scores: memberships, weighted group scores, presence over days, overall flag."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from flowrhythm.functions.network import finite
from flowrhythm.operators.status import CATALOG

Keys = tuple[str, ...]
GROUPS = tuple(CATALOG)
#: Days looked at, days needed, threshold, groups one of which must be present.
GATE = {"M": 14, "N": 10, "theta": 0.7, "core_symptoms": ["C2"]}
#: The built-in specification: group, metric, weight, low, middle, high, inverted. Fixed values.
DEFAULT = (
    ("C1", "IS", 0.20, 0.30, 0.50, 0.70, False), ("C1", "IV", 0.20, 0.60, 1.00, 1.50, False), ("C1", "F2_MeanSocialDurSec", 0.10, 60, 120, 240, False), ("C1", "F7_HourlyCV", 0.10, 0.10, 0.30, 0.60, False),
    ("C1", "F8_NightDayRatioPkts", 0.10, 0.10, 0.30, 0.60, False), ("C1", "LateNightShare", 0.10, 0.10, 0.20, 0.30, False), ("C1", "LongestInactivityHours", 0.05, 2.0, 4.0, 8.0, True), ("C1", "ActiveNightMinutes", 0.05, 10, 30, 90, False),
    ("C1", "ND_Ratio", 0.05, 0.05, 0.20, 0.50, False), ("C1", "F1_DistinctSocial", 0.025, 2, 3, 5, True), ("C1", "F6_Fano", 0.025, 0.5, 1.0, 1.5, False), ("C1", "F4_DownUpRatio", 0.025, 5, 10, 20, False),
    ("C2", "C2_F3_ChatSessionCount", 0.35, -50, -25, 0, False), ("C2", "C2_F1_UniqueSLD", 0.30, -40, -20, 0, False), ("C2", "C2_F6_ProductivityHits", 0.20, -60, -30, 0, False), ("C2", "C2_F4_MeanUpstreamRateBps", 0.15, -50, -25, 0, False),
    ("C4", "C4_F4_SleepDurationZAbs30d", 0.50, 0.5, 1.0, 1.5, False), ("C4", "C4_F1_OnsetDelayFrom2200Min", 0.30, 15, 75, 180, False), ("C4", "C4_F2_WakeAfter0400Min", 0.20, 150, 210, 270, False),
    ("C5", "C5_F5_Sub30sSessions", 0.50, 0, 5, 10, False), ("C5", "C5_F1_DhcpPerHour", 0.30, 1, 3, 5, False), ("C5", "C5_F2_WifiDwellMin", 0.20, 5, 10, 20, True),
    ("C6", "C6_F8_FirstActivityMin", 0.60, 0, 45, 90, False), ("C6", "C6_F9_ActivationDelayVsBase28d", 0.40, 15, 45, 90, False),
    ("C8", "C8_F2_DNSBurstRatePerHour", 0.25, 1, 3, 5, False), ("C8", "C8_F4_RepeatedQueryRatio60m", 0.15, 0.05, 0.10, 0.20, False), ("C8", "C8_F8_MedianIKSsec", 0.60, 0.30, 0.40, 0.60, False),
)
SPEC = "criterion string, metric string, w double, type string, lo double, mid double, hi double, invert boolean"


def triangle(x: Column, lo: Column, mid: Column, hi: Column, invert: Column) -> Column:
    """Triangular membership; an infinite end is a shoulder. No value gives 0 and three equal points give 1, inverted or not."""
    v = finite(x)
    left, right = F.abs(lo) == float("inf"), F.abs(hi) == float("inf")
    tiny = F.lit(1e-9)
    rising, falling = (v - lo) / F.greatest(tiny, mid - lo), (hi - v) / F.greatest(tiny, hi - mid)
    inside = F.when(v == mid, 1.0).when(v < mid, rising).otherwise(falling)
    mu = (
        F.when(left & right, 1.0)
        .when(left, F.when(v <= mid, 1.0).when(v >= hi, 0.0).otherwise(falling))
        .when(right, F.when(v >= mid, 1.0).when(v <= lo, 0.0).otherwise(rising))
        .otherwise(F.when((v <= lo) | (v >= hi), 0.0).otherwise(inside))
    )
    return F.when(v.isNull(), 0.0).when((lo == mid) & (mid == hi), 1.0).otherwise(F.when(invert, 1.0 - mu).otherwise(mu))


def clipped(x: Column) -> Column:
    """x within [0, 1]; nothing counts as 0."""
    return F.coalesce(F.least(F.greatest(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def default_spec(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, m, float(w), "tri", float(a), float(b), float(h), i) for c, m, w, a, b, h, i in DEFAULT], SPEC)


def _number(x: Any, otherwise: float) -> float:
    try:
        return float(x)
    except (TypeError, ValueError):
        return otherwise


def _truth(x: Any) -> bool:
    return x.strip().lower() in ("true", "1", "yes", "y", "on") if isinstance(x, str) else bool(x)


def parse_spec(said: str | dict, known: dict[str, tuple[str, ...]] | None = None) -> tuple[dict, list[tuple]]:
    """(gate, rows of SPEC) of a specification in JSON, in any of its accepted shapes.

    Groups may stand at the top or under "criteria", their metrics in an object or a list or under
    "metrics", a weight as w or weight, the points flat or under mf. Unknown metrics are dropped.
    """
    d = json.loads(said) if isinstance(said, str) else said
    if not isinstance(d, dict):
        return dict(GATE), []
    known = known or {g: tuple(m) for g, m in CATALOG.items()}
    gate = dict(GATE)
    for k, kind in (("M", int), ("N", int), ("theta", float)):
        if k in d:
            gate[k] = kind(_number(d[k], gate[k]))
    core = d.get("core_symptoms", d.get("core"))
    if core is not None:
        gate["core_symptoms"] = [g for g in ([core] if isinstance(core, str) else list(core)) if g in known]
    groups = d["criteria"] if isinstance(d.get("criteria"), dict) else d
    rows = []
    for g in known:
        own = groups.get(g)
        if isinstance(own, dict) and isinstance(own.get("metrics"), (dict, list)):
            own = own["metrics"]
        pairs = own.items() if isinstance(own, dict) else [(e.get("metric") or e.get("name") or e.get("key"), e) for e in own if isinstance(e, dict)] if isinstance(own, list) else []
        for metric, e in pairs:
            if metric not in known[g] or not isinstance(e, dict):
                continue
            mf = e["mf"] if isinstance(e.get("mf"), dict) else {}
            point = lambda k, e=e, mf=mf: _number(e.get(k, mf.get(k, 0.0)), 0.0)
            rows.append((g, metric, _number(e.get("w", e.get("weight", 0.1)), 0.1), str(e.get("type", mf.get("type", "tri"))).lower(), point("lo"), point("mid"), point("hi"), _truth(e.get("invert", mf.get("invert", False)))))
    return gate, rows


def write_spec(gate: dict, rows: list[tuple]) -> str:
    """The specification as JSON that parse_spec reads back."""
    out: dict[str, Any] = dict(gate)
    for g, m, w, kind, lo, mid, hi, invert in rows:
        out.setdefault(g, {})[m] = {"w": w, "mf": {"type": kind, "lo": lo, "mid": mid, "hi": hi, "invert": invert}}
    return json.dumps(out, indent=2)


#: Metrics that a specification names at most: each is a column of the daily table.
MOST_METRICS = 2000


def _named(spec: DataFrame) -> list[Row]:
    """The rows of a specification that name a metric, in its order."""
    rows = spec.where("metric is not null").limit(MOST_METRICS * len(GROUPS) + 1).collect()
    if len(rows) > MOST_METRICS * len(GROUPS) or len({r.metric for r in rows}) > MOST_METRICS:
        raise ValueError(f"a specification has at most {MOST_METRICS} metrics")
    return rows


def _membership(r: Row) -> Column:
    """The membership of the metric that a row of a specification names. Its points are constants of the plan, which leaves short code."""
    return triangle(F.col(r.metric).cast("double"), *(F.lit(x).cast("double") for x in (r.lo, r.mid, r.hi)), F.lit(r.invert).cast("boolean")) if r.type == "tri" else clipped(F.col(r.metric))


def contributions(daily: DataFrame, spec: DataFrame, keys: Keys) -> DataFrame:
    """(keys, criterion, metric, value, mu, contribution): weight times membership, unclipped, for each metric of the spec."""
    rows = [r for r in _named(spec) if r.metric in daily.columns]
    if not rows:
        return daily.select(*keys, *(F.lit(None).cast(t).alias(c) for c, t in (("criterion", "string"), ("metric", "string"), ("value", "double"), ("mu", "double"), ("contribution", "double")))).limit(0)
    each = [F.struct(F.lit(r.criterion).cast("string").alias("criterion"), F.lit(r.metric).alias("metric"), F.col(r.metric).cast("double").alias("value"), (mu := _membership(r)).alias("mu"), (F.lit(r.w).cast("double") * mu).alias("contribution")) for r in rows]
    return daily.select(*keys, F.inline(F.array(*each)))


def group_scores(daily: DataFrame, spec: DataFrame, keys: Keys, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """L_<group> for each row: the contributions' sum within [0, 1], not divided by the weights; 0 without a spec."""
    rows = _named(spec)
    own = lambda g: [r for r in rows if r.criterion == g and r.metric in daily.columns]
    total = lambda g: sum((F.coalesce(F.lit(r.w).cast("double") * _membership(r), F.lit(0.0)) for r in own(g)), F.lit(0.0))
    return daily.select(*keys, *(F.least(F.greatest(total(g), F.lit(0.0)), F.lit(1.0)).alias(f"L_{g}") for g in groups))


def long_scores(scores: DataFrame, keys: Keys, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """(keys, Code, Display, Likelihood): one row for each score."""
    long = scores.unpivot([F.col(k) for k in keys], [F.col(f"L_{g}") for g in groups], "__name", "Likelihood")
    return long.select(*keys, F.substring("__name", 3, 10).alias("Code"), F.concat_ws(" ", F.lit("Group"), F.substring("__name", 4, 10)).alias("Display"), "Likelihood")


def presence(scores: DataFrame, entity: Keys, day: str = "Date", gate: dict | None = None, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """present_<group> at each day: at least N of the last M rows reach theta."""
    g = GATE | (gate or {})
    w = Window.partitionBy(*(entity or (F.lit(0),))).orderBy(day).rowsBetween(-(g["M"] - 1), 0)
    return scores.withColumns({f"present_{c}": F.sum(F.when(F.col(f"L_{c}") >= g["theta"], 1).otherwise(0)).over(w) >= g["N"] for c in groups})


def overall(present: DataFrame, core: list[str] | None = None, least: int = 5, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """flag: at least `least` groups present, one of them a core group; n_present counts them."""
    core = GATE["core_symptoms"] if core is None else core
    n = sum((F.col(f"present_{c}").cast("int") for c in groups), F.lit(0))
    any_core = F.lit(False)
    for c in core:
        any_core = any_core | F.col(f"present_{c}")
    return present.withColumns({"n_present": n, "flag": (n >= least) & any_core})


def latest(rows: DataFrame, entity: Keys, day: str = "Date") -> DataFrame:
    """Each entity's last row."""
    own = F.struct(*rows.columns)
    return rows.groupBy(*(entity or (F.lit(0).alias("__all"),))).agg(F.max_by(own, day).alias("x")).select("x.*")


def top_groups(scores: DataFrame, keys: Keys, n: int = 6, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """The n groups of the highest mean score, ties in the order of the groups."""
    return long_scores(scores, keys, groups).groupBy("Code").agg(F.avg("Likelihood").alias("mean_score")).orderBy(F.desc("mean_score"), "Code").limit(n)
