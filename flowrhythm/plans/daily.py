"""From packets to statuses and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrhythm.operators.baseline import with_history
from flowrhythm.operators.enrich import enrich
from flowrhythm.operators.score import GATE, group_scores, overall, presence
from flowrhythm.operators.status import CATALOG, catalog, melt, with_status
from flowrhythm.plans import metrics as M
from flowrhythm.sources.scratch import written

METRICS = [m for ms in CATALOG.values() for m in ms]


def daily_table(packets: DataFrame, keys: tuple[str, ...] = ("Date",), scope: tuple[str, ...] | None = None, night: str = "calendar") -> DataFrame:
    """All metrics by key, history included. packets have short names; scope is where a DNS answer holds.

    The enriched rows are written to the shared folder when this is called, since six branches read them; destinations
    that many packets have are looked for before.
    """
    rows = written(enrich(packets, scope or keys, skewed=True).select(*dict.fromkeys(("Date", *keys, *M.COLUMNS))), "enriched")
    return with_history(M.daily(rows, keys, night), tuple(k for k in keys if k != "Date"))


def statuses(daily: DataFrame, keys: tuple[str, ...] = ("Date",), overrides: DataFrame | None = None) -> DataFrame:
    have = [m for m in METRICS if m in daily.columns]
    return with_status(melt(daily, keys, have), catalog(daily.sparkSession), overrides)


def flags(daily: DataFrame, spec: DataFrame, keys: tuple[str, ...] = ("Date",), gate: dict | None = None) -> DataFrame:
    """Scores, presences and the overall flag of every day."""
    entity = tuple(k for k in keys if k != "Date")
    g = GATE | (gate or {})
    return overall(presence(group_scores(daily, spec, keys), entity, "Date", g), g["core_symptoms"])


def headline(packets: DataFrame, keys: tuple[str, ...] = ("Date",)) -> DataFrame:
    """The flagship: counters, night share, byte ratio and chat sessions of each day, with their statuses."""
    rows = enrich(packets, keys)
    wide = M.counters(rows, keys).join(M.session_metrics(M.session_table(rows, keys), keys), [*keys], "left")
    chosen = ["LateNightShare", "F4_DownUpRatio", "F2_MeanSocialDurSec", "C2_F3_ChatSessionCount"]
    return with_status(melt(wide, keys, chosen), catalog(packets.sparkSession)).select(*keys, "metric", F.round("value", 6).alias("value"), "status")
