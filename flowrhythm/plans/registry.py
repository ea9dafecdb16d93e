"""References to values by name, as columns of the daily frame.

    TODAY:name, TR:name   a column of the frame
    AUX:name              a value given with the call
    CONST:1.5             a number
    FUNC:Name(k=v)        a registered measure, with keyword arguments

Anything unknown or unreadable is missing: null, not an error.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrhythm.operators.baseline import absolute_z, circular_spread, delta_from_median

#: Measures that are columns of the daily frame: fixed values.
COLUMNS = {
    "ChatSessionCount": "C2_F3_ChatSessionCount", "MedianReplyLatencySec": "C2_F2_MedianReplyLatencySec", "MeanUpstreamRateBps": "C2_F4_MeanUpstreamRateBps", "PassiveActiveByteRatio": "C2_F5_PassiveActiveByteRatio",
    "FoodDeliveryHitsDay": "C3_F1_FoodDeliveryHits", "LateNightDeliveryRatio": "C3_F2_LateNightDeliveryRatio", "MeanInterOrderDaysDay": "C3_F3_MeanInterOrderDays", "DietSiteVisitsDay": "C3_F4_DietSiteVisits",
    "CalorieTrackerBurstCount": "C3_F5_TrackerBurstCount", "SmartScaleUploadEvents": "C3_F6_SmartScaleUploads", "WeighInTimeVarMinDay": "C3_F7_WeighInTimeVarMin",
    "SleepOnsetDelayFrom2200Min": "C4_F1_OnsetDelayFrom2200Min", "WakeAfter0400Min": "C4_F2_WakeAfter0400Min", "NocturnalMicroSessionCount0106": "C4_F5_NocturnalMicroSessionCount0106",
    "MeanInterAwakeningGapMin0106": "C4_F6_MeanInterAwakGapMin0106", "DaytimeIdleRatio0818": "C4_F7_DaytimeIdleRatio0818", "NightDayTrafficRatioBytes": "C4_F8_NightDayTrafficRatioBytes",
    "DhcpReassocPerHour": "C5_F1_DhcpPerHour", "MeanWifiDwellMinutes": "C5_F2_WifiDwellMin", "MedianIKSsec": "C5_F3_MedianIKS", "IKSStdSec": "C5_F4_IKSStd", "Sub30sSessionCount": "C5_F5_Sub30sSessions", "SessionFano": "C5_F6_SessionFano",
    "UpstreamBpsPerActiveHour": "C6_F4_UpstreamBpsPerActiveHour", "PostChatCount": "C6_F5_PostChatCount", "MedianInterReqSec": "C6_F6_MedianInterReqSec", "InterReqFano": "C6_F7_InterReqFano", "FirstActivityMin": "C6_F8_FirstActivityMin",
    "MentalHealthSiteVisitsDay": "C7_F1_MentalHealthSiteVisitsDay", "NegativeSelfSearchRatio": "C7_F2_NegativeSelfSearchRatio", "SettingsPrivacyDwellSec": "C7_F6_SettingsPrivacyDwellSec",
    "AccountDeleteUnsubscribeCount": "C7_F5_AccountDeleteUnsubCount", "SocialOutgoingShareUpstream": "C7_F7_SocialOutgoingShareUp", "CloudUploadBytesToday": "C7_F8_CloudUploadBytesToday",
    "DNSBurstRatePerHour": "C8_F2_DNSBurstRatePerHour", "NotificationMicroSessionsCount": "C8_F3_NotificationMicroSessionsCount", "RepeatedQueryRatio60m": "C8_F4_RepeatedQueryRatio60m",
    "CrisisLineHits": "C9_F1_CrisisLineHits", "SuicideMethodQueryRatio": "C9_F2_SuicideMethodQueryRatio", "SelfHarmForumVisits": "C9_F4_SelfHarmForumVisits", "SelfHarmForumUpBytes": "C9_F5_SelfHarmForumUpBytes",
    "SelfHarmForumMeanSessionLenSec": "C9_F6_SelfHarmForumMeanSessLenSec", "WillInsuranceDownloads": "C9_F7_WillInsuranceDownloads", "CloudBackupUpBytesToday": "C9_F8_CloudBackupUpBytesToday",
    "AccountDeletionRequestsCount": "C9_F9_AccountDeletionRequestsCount", "NightSuicideQueryBursts": "C9_F10_NightSuicideQueryBursts", "NightNegativeSearchRatio": "C9_F11_NightNegativeSearchRatio",
}

Builder = Callable[..., DataFrame]


def _delta(daily: DataFrame, entity: tuple[str, ...], day: str, output: str, *, col: str = "C6_F8_FirstActivityMin", window: int = 28, **_: Any) -> DataFrame:
    return delta_from_median(daily, col, entity, day, int(window), output)


def _onset(daily: DataFrame, entity: tuple[str, ...], day: str, output: str, **_: Any) -> DataFrame:
    return circular_spread(daily, "C4_F1_OnsetLocalMin", entity, day, output=output)


def _sleep(daily: DataFrame, entity: tuple[str, ...], day: str, output: str, **_: Any) -> DataFrame:
    return absolute_z(daily, "LongestInactivityHours", entity, day, output=output)


#: Measures that look at other rows: name to a builder that adds a column.
BUILDERS: dict[str, Builder] = {"DELTA_FROM_MEDIAN": _delta, "OnsetTimeVar14dMin": _onset, "SleepDurationZAbs30d": _sleep}


def register(name: str, builder: Builder) -> None:
    BUILDERS[name] = builder


def arguments(said: str) -> dict[str, Any]:
    """k=v, k=v: literals where they can be read as such, else text."""
    out: dict[str, Any] = {}
    for part in said.split(","):
        k, equals, v = part.partition("=")
        if equals:
            try:
                out[k.strip()] = ast.literal_eval(v.strip())
            except (ValueError, SyntaxError):
                out[k.strip()] = v.strip().strip("'\"")
    return out


def with_value(daily: DataFrame, reference: str, output: str, entity: tuple[str, ...] = (), day: str = "Date", aux: dict[str, float] | None = None) -> DataFrame:
    """daily with one more column, the value that the reference names."""
    kind, colon, rest = reference.partition(":")
    kind, rest = kind.strip().upper(), rest.strip()
    value: Column = F.lit(None).cast("double")
    if colon and kind in ("TODAY", "TR") and rest in daily.columns:
        value = F.col(rest).cast("double")
    elif colon and kind == "AUX" and rest in (aux or {}):
        value = F.lit(float(aux[rest]))
    elif colon and kind == "CONST":
        try:
            value = F.lit(float(rest))
        except ValueError:
            pass
    elif colon and kind == "FUNC" and (m := re.fullmatch(r"(\w+)\s*(?:\((.*)\))?", rest)):
        name, given = m[1], arguments(m[2] or "")
        if COLUMNS.get(name) in daily.columns:
            value = F.col(COLUMNS[name]).cast("double")
        elif name in BUILDERS and given.get("col", "C6_F8_FirstActivityMin") in daily.columns:
            return BUILDERS[name](daily, entity, day, output, **given)
    return daily.withColumn(output, value)


def with_precedence(computed: DataFrame, cached: DataFrame, keys: tuple[str, ...] = ("Date",), columns: tuple[str, ...] | None = None, latest: str | None = None) -> DataFrame:
    """computed, where the cached table's value of the same keys goes before the computed one, if it has any.

    columns: those to look up, by default all that both have. Keys that only the cached table has are left out. Of
    several cached rows of the same keys the one with the greatest `latest`, a column of the cached table, holds, else
    the one whose values are the greatest, in their order.
    """
    shared = [c for c in (columns or computed.columns) if c in cached.columns and c in computed.columns and c not in keys]
    if not shared:
        return computed
    own = F.struct(*([F.col(latest).alias("__latest")] if latest else []), *(F.col(c).alias(f"__cached_{c}") for c in shared))
    before = cached.groupBy(*keys).agg(F.max(own).alias("__own")).select(*keys, *(f"__own.__cached_{c}" for c in shared))
    out = computed.join(before, [*keys], "left")
    return out.withColumns({c: F.coalesce(f"__cached_{c}", c) for c in shared}).drop(*(f"__cached_{c}" for c in shared))
