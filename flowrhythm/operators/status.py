"""Metric catalog, thresholds and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrhythm.functions.network import finite

#: Metric: (threshold, whether higher is worse). Fixed values, in the order of the groups.
CATALOG: dict[str, dict[str, tuple[float, bool]]] = {
    "C1": {
        "LateNightShare": (0.15, True), "LongestInactivityHours": (6, False), "ActiveNightMinutes": (30, True), "IS": (0.5, False), "IV": (0.8, True), "ND_Ratio": (0.2, True), "F1_DistinctSocial": (3, False),
        "F2_MeanSocialDurSec": (120, True), "F3_LongStreams": (0, True), "F4_DownUpRatio": (20, True), "F5_RevisitRatio": (0.5, False), "F6_Fano": (1.5, True), "F7_HourlyCV": (0.3, False), "F8_NightDayRatioPkts": (0.4, True),
    },
    "C2": {
        "C2_F1_UniqueSLD": (15, False), "C2_F2_MedianReplyLatencySec": (45, True), "C2_F3_ChatSessionCount": (3, False), "C2_F4_MeanUpstreamRateBps": (100, False), "C2_F5_PassiveActiveByteRatio": (8, True),
        "C2_F6_ProductivityHits": (5, False), "C2_F7_SocialOutgoingShareUp": (0.25, False),
    },
    "C3": {
        "C3_F1_FoodDeliveryHits": (1, True), "C3_F2_LateNightDeliveryRatio": (0.10, True), "C3_F3_MeanInterOrderDays": (3, False), "C3_F4_DietSiteVisits": (1, False), "C3_F5_TrackerBurstCount": (2, True),
        "C3_F6_SmartScaleUploads": (1, False), "C3_F7_WeighInTimeVarMin": (120, True),
    },
    "C4": {
        "C4_F1_OnsetDelayFrom2200Min": (120, True), "C4_F2_WakeAfter0400Min": (240, True), "C4_F3_OnsetVar14dMin": (120, True), "C4_F4_SleepDurationZAbs30d": (2, True), "C4_F5_NocturnalMicroSessionCount0106": (2, True),
        "C4_F6_MeanInterAwakGapMin0106": (30, False), "C4_F7_DaytimeIdleRatio0818": (0.5, True), "C4_F8_NightDayTrafficRatioBytes": (0.4, True),
    },
    "C5": {
        "C5_F1_DhcpPerHour": (1, True), "C5_F2_WifiDwellMin": (30, False), "C5_F3_MedianIKS": (1, True), "C5_F4_IKSStd": (0.4, True), "C5_F5_Sub30sSessions": (12, True), "C5_F6_SessionFano": (1.5, True),
    },
    "C6": {
        "C6_F1_LongestMiddayIdleMin": (90, True), "C6_F2_DayActiveSessionCount": (5, False), "C6_F3_DayIdleRatio_09_18": (0.4, True), "C6_F4_UpstreamBpsPerActiveHour": (1e6, False), "C6_F5_PostChatCount": (50, False),
        "C6_F6_MedianInterReqSec": (10, True), "C6_F7_InterReqFano": (1.5, True), "C6_F8_FirstActivityMin": (540, True), "C6_F9_ActivationDelayVsBase28d": (60, True),
    },
    "C7": {
        "C7_F1_MentalHealthSiteVisitsDay": (0, True), "C7_F2_NegativeSelfSearchRatio": (0.02, True), "C7_F3_SelfAssessmentDwellSec": (60, True), "C7_F4_HelpTherapyLookupHits": (0, True), "C7_F5_AccountDeleteUnsubCount": (0, True),
        "C7_F6_SettingsPrivacyDwellSec": (120, True), "C7_F7_SocialOutgoingShareUp": (0.25, False), "C7_F8_CloudUploadBytesToday": (0, True),
    },
    "C8": {
        "C8_F1_MedianPageDwellSec": (10, False), "C8_F2_DNSBurstRatePerHour": (4, True), "C8_F3_NotificationMicroSessionsCount": (2, True), "C8_F4_RepeatedQueryRatio60m": (0.15, True), "C8_F5_QueryReformulationMax": (3, True),
        "C8_F6_BackNavShare": (0.25, True), "C8_F7_SERPTimeToFirstClickSec": (30, True), "C8_F8_MedianIKSsec": (0.4, True),
    },
    "C9": {
        "C9_F1_CrisisLineHits": (0, True), "C9_F2_SuicideMethodQueryRatio": (0.005, True), "C9_F3_TherapyBookingVisits": (0, True), "C9_F4_SelfHarmForumVisits": (0, True), "C9_F5_SelfHarmForumUpBytes": (0, True),
        "C9_F6_SelfHarmForumMeanSessLenSec": (3, True), "C9_F7_WillInsuranceDownloads": (0, True), "C9_F8_CloudBackupUpBytesToday": (200, True), "C9_F9_AccountDeletionRequestsCount": (0, True),
        "C9_F10_NightSuicideQueryBursts": (0, True), "C9_F11_NightNegativeSearchRatio": (0.05, True),
    },
}
ORDER = ("OK", "Caution", "N/A")


def catalog(spark: SparkSession) -> DataFrame:
    """(group, metric, ok, higher_is_worse): one row for each metric."""
    return spark.createDataFrame([(g, m, float(ok), up) for g, ms in CATALOG.items() for m, (ok, up) in ms.items()], "group string, metric string, ok double, higher_is_worse boolean")


def melt(daily: DataFrame, keys: tuple[str, ...], metrics: list[str]) -> DataFrame:
    """(keys, metric, value) of a wide table."""
    wide = daily.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics))
    return wide.unpivot([F.col(k) for k in keys], [F.col(m) for m in metrics], "metric", "value")


def with_status(long: DataFrame, definitions: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """status of each value: N/A for none or an infinite one, OK on the right side of the threshold, else Caution.

    overrides (metric, ok, higher_is_worse) take the place of the defaults, field by field.
    """
    d = definitions
    if overrides is not None:
        o = overrides.select("metric", F.col("ok").alias("__ok"), F.col("higher_is_worse").alias("__up"))
        d = d.join(o, "metric", "left").withColumns({"ok": F.coalesce("__ok", "ok"), "higher_is_worse": F.coalesce("__up", "higher_is_worse")}).drop("__ok", "__up")
    v = finite(F.col("value"))
    good = F.when(F.col("higher_is_worse"), v <= F.col("ok")).otherwise(v >= F.col("ok"))
    # a row for each metric of the catalog
    return long.join(F.broadcast(d), "metric").withColumn("status", F.when(v.isNull(), "N/A").when(good, "OK").otherwise("Caution"))


def status_counts(statuses: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Counts of each status by key and group."""
    return statuses.groupBy(*keys, "group").agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in zip(ORDER, ("n_ok", "n_caution", "n_na"))))


def rank_of_status() -> Column:
    return F.when(F.col("status") == "OK", 0).when(F.col("status") == "Caution", 1).otherwise(2)


def filtered(statuses: DataFrame, keep: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows of these statuses, OK first and N/A last, then by metric."""
    return statuses.where(F.col("status").isin(*keep)).orderBy(rank_of_status(), "metric")
