"""Daily metrics: nine groups of measures, one row for each key.

Each builder reads standard, enriched rows and returns one narrow frame per key:
plain sums, distinct counts, the minute series, sessions, ordered gaps and bins. The
daily frame joins them on the key, from the counters on, so every key that has a
packet has a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrhythm.functions import network as N
from flowrhythm.functions.lists import CHAT_PORTS
from flowrhythm.operators.gaps import busiest_slot, with_previous
from flowrhythm.operators.series import minute_measures, minutes
from flowrhythm.operators.sessions import masked, seconds, sessions

Keys = tuple[str, ...]
INF = float("inf")
#: What the builders read of enriched rows.
COLUMNS = (
    "us", "tie", "src", "dst", "dport", "qname", "ans_name", "url", "http_path", "path", "flow_sec", "present", "ResolvedHost", "SLD", "outbound", "inbound", "hour", "minute", "bytes",
    "social", "food", "diet", "scale", "mental_health", "crisis", "productivity", "cloud", "chat", "streaming", "dhcp", "forum",
)


def _if(condition: Column, x: Column | int | float = 1) -> Column:
    return F.when(condition, x if isinstance(x, Column) else F.lit(x))


def _sum(condition: Column, x: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, x)), F.lit(0))


def _has(*columns: str) -> Column:
    """Aggregate: whether the packets came with these columns."""
    return F.max(reduce(lambda a, b: a & b, (F.array_contains("present", c) for c in columns)))


def counters(rows: DataFrame, keys: Keys) -> DataFrame:
    """Everything that one pass of conditional sums gives, metrics and helpers (prefixed __)."""
    return counter_metrics(counter_sums(rows, keys, F.countDistinct(F.floor(F.col("minute") / 60))), keys)


#: How the sums of parts of a key merge, where not by adding.
LEAST_OF, MOST_OF = ("__t0", "__d0", "__first"), ("__t1", "__d1", "__addr", "__len", "__url", "__http", "__path", "__flow")


def counter_sums(rows: DataFrame, keys: Keys, hours: Column) -> DataFrame:
    """The sums, counts, least and greatest values that the counters are made of, and active hours as the aggregate given."""
    hour, out, inn = F.col("hour"), F.col("outbound"), F.col("inbound")
    small = out & (F.col("bytes") <= 300)
    clock = N.clock_minutes(F.col("us"))
    circular = []
    for name, on in (("out", F.col("scale") & (out | ~F.array_contains("present", "src"))), ("all", F.col("scale"))):
        circular += [x.alias(f"__{k}_{name}") for k, x in zip(("cos", "sin", "times"), N.circular_parts(_if(on, clock)))]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.count_if(hour.between(0, 5)).alias("__night"), F.count_if((hour >= 22) | (hour <= 5)).alias("__night22"), F.count_if(hour.between(6, 21)).alias("__day"),
        _sum(inn, F.col("bytes")).alias("__down"), _sum(out, F.col("bytes")).alias("__up"), F.min("us").alias("__t0"), F.max("us").alias("__t1"), hours.alias("__hours"),
        F.count_if("productivity").alias("C2_F6_ProductivityHits"), _sum(F.col("streaming"), F.col("bytes")).alias("__stream"), _sum(F.col("chat") & out, F.col("bytes")).alias("__chat_up"), _sum(F.col("chat") & inn, F.col("bytes")).alias("__chat_down"),
        F.count_if("social").alias("__social"), F.count_if("chat").alias("__chat"), _sum(F.col("social") & out, F.col("bytes")).alias("__soc_up"), _sum(F.col("social") & inn, F.col("bytes")).alias("__soc_down"),
        F.count_if("diet").alias("C3_F4_DietSiteVisits"), *circular,
        _sum(hour.between(0, 5), F.col("bytes")).alias("__bn"), _sum(hour.between(6, 21), F.col("bytes")).alias("__bd"),
        F.count_if("dhcp").alias("__dhcp"), F.min(_if(F.col("dhcp"), F.col("us"))).alias("__d0"), F.max(_if(F.col("dhcp"), F.col("us"))).alias("__d1"),
        F.count_if(small & (F.col("social") | F.coalesce(F.col("dport").isin(*CHAT_PORTS), F.lit(False)))).alias("__post"), F.min(_if(hour >= 4, F.col("us"))).alias("__first"),
        F.count_if("mental_health").alias("C7_F1_MentalHealthSiteVisitsDay"), F.count_if("crisis").alias("C7_F4_HelpTherapyLookupHits"), F.count_if("cloud").alias("__cloud"), _sum(F.col("cloud") & out, F.col("bytes")).alias("__cloud_up"),
        F.count_if("forum").alias("__forum"), F.count_if(F.col("SLD") == "reddit.com").alias("__reddit"), _sum(F.col("forum") & out, F.col("bytes")).alias("__forum_up"),
        _has("src", "dst").alias("__addr"), _has("length").alias("__len"), _has("url").alias("__url"), _has("http_path").alias("__http"), _has("path").alias("__path"), _has("flow_sec").alias("__flow"),
    )
    found = pattern_sums(rows, keys)
    none = {c: F.coalesce(F.col(c), F.lit(0)) for c in found.columns if c not in keys}
    return sums.join(found, [*keys], "left").withColumns(none)


QUERY_COLUMNS = {"q": "qname", "a": "ans_name", "u": "url", "http_path": "http_path", "path": "path"}


def pattern_sums(rows: DataFrame, keys: Keys) -> DataFrame:
    """Hits of the patterns in queries, addresses and paths: each different one of a key is matched once, however often it occurs."""
    night = F.col("hour").between(0, 5)
    each = F.array(*(F.struct(F.lit(k).alias("which"), F.col(c).alias("value")) for k, c in QUERY_COLUMNS.items()))
    long = rows.select(*keys, night.alias("night"), "flow_sec", F.explode(F.filter(each, lambda x: x["value"].isNotNull())).alias("x"))
    words = long.groupBy(*keys, "x.which", "x.value").agg(F.count("*").alias("n"), F.count_if("night").alias("at_night"), F.sum("flow_sec").alias("sec"))
    hits = words.withColumns({m: N.matches(m, F.col("value")) for m in ("negative_self", "method", "account", "settings", "will")})
    on = lambda k, x, *hit: _sum(reduce(lambda a, b: a & b, [F.col(h) for h in hit], F.col("which") == k), F.col(x))
    out = []
    for k in ("q", "a", "u"):
        out += [on(k, "n").alias(f"__n_{k}"), on(k, "n", "negative_self").alias(f"__neg_{k}"), on(k, "n", "method").alias(f"__met_{k}"), on(k, "at_night", "method").alias(f"__nmet_{k}")]
    out += [on(k, "n", "account").alias(f"__acc_{c}") for k, c in (("u", "url"), ("http_path", "http_path"), ("path", "path"))]
    return hits.groupBy(*keys).agg(*out, on("u", "sec", "settings").cast("double").alias("__settings"), on("u", "n", "will").alias("__will"))


def counter_metrics(agg: DataFrame, keys: Keys) -> DataFrame:
    """The counters of whole keys from their sums."""
    sd = {name: N.circular_of(*(F.col(f"__{k}_{name}") for k in ("cos", "sin", "times"))) for name in ("out", "all")}
    addr = F.col("__addr") & F.col("__len")
    n = lambda c: F.col(c).cast("double")
    first = lambda name: F.when(F.col("__n_q") > 0, F.col(f"__{name}_q")).when(F.col("__n_a") > 0, F.col(f"__{name}_a")).when(F.col("__n_u") > 0, F.col(f"__{name}_u"))
    hours = lambda a, b: (F.col(b) - F.col(a)) / F.lit(3600.0 * N.MICROS)
    up, down = F.when(F.col("__social") > 0, F.col("__soc_up")).otherwise(F.col("__chat_up")), F.when(F.col("__social") > 0, F.col("__soc_down")).otherwise(F.col("__chat_down"))
    account_count = F.when(F.col("__url"), F.col("__acc_url")).when(F.col("__http"), F.col("__acc_http_path")).when(F.col("__path"), F.col("__acc_path")).cast("double")
    cloud = F.when(F.col("__cloud") == 0, F.lit(0.0)).when(addr, n("__cloud_up")).otherwise(n("__cloud"))
    settings = F.when(F.col("__url") & F.col("__flow"), F.col("__settings"))
    return agg.select(
        *keys, n("__n").alias("n_total_packets_today"), n("__night").alias("n_night_packets_today"), n("__night22").alias("night_pkts_today"), n("__day").alias("day_pkts_today"),
        F.when(addr, n("__down")).alias("down_bytes_today"), F.when(addr, n("__up")).alias("up_bytes_today"), N.share(F.col("__night"), F.col("__n")).alias("LateNightShare"),
        F.when(addr, N.ratio(F.col("__down"), F.col("__up"))).alias("F4_DownUpRatio"), N.ratio(F.col("__night"), F.col("__day")).alias("F8_NightDayRatioPkts"),
        F.when(addr, N.ratio(F.col("__stream"), F.col("__chat_up"))).alias("C2_F5_PassiveActiveByteRatio"), n("C2_F6_ProductivityHits").alias("C2_F6_ProductivityHits"),
        F.when((F.col("__social") > 0) | (F.col("__chat") > 0), F.when(addr, N.share(up, up + down)).otherwise(F.lit(1.0))).alias("C2_F7_SocialOutgoingShareUp"),
        n("C3_F4_DietSiteVisits").alias("C3_F4_DietSiteVisits"), F.coalesce(sd["out"], sd["all"]).alias("C3_F7_WeighInTimeVarMin"),
        F.when(F.col("__len"), N.ratio(F.col("__bn"), F.col("__bd"))).otherwise(N.ratio(F.col("__night"), F.col("__day"))).alias("C4_F8_NightDayTrafficRatioBytes"),
        (n("__dhcp") / F.least(F.lit(24.0), F.greatest(F.lit(1.0), hours("__t0", "__t1")))).alias("C5_F1_DhcpPerHour"), F.when(F.col("__dhcp") >= 2, hours("__d0", "__d1") * 60 / (F.col("__dhcp") - 1)).alias("C5_F2_WifiDwellMin"),
        F.when(addr, n("__up") / (F.col("__hours") * 3600.0)).alias("C6_F4_UpstreamBpsPerActiveHour"), F.when(addr, n("__post")).alias("C6_F5_PostChatCount"),
        F.floor(N.clock_minutes(F.col("__first")) * 60 + 1e-7).cast("double").alias("__first_sec"), n("C7_F1_MentalHealthSiteVisitsDay").alias("C7_F1_MentalHealthSiteVisitsDay"), n("C7_F4_HelpTherapyLookupHits").alias("C7_F4_HelpTherapyLookupHits"),
        N.share(first("neg"), first("n")).alias("C7_F2_NegativeSelfSearchRatio"), settings.alias("C7_F3_SelfAssessmentDwellSec"), account_count.alias("C7_F5_AccountDeleteUnsubCount"), settings.alias("C7_F6_SettingsPrivacyDwellSec"),
        F.when(F.col("__social") > 0, F.when(addr, N.share(F.col("__soc_up"), F.col("__soc_up") + F.col("__soc_down"))).otherwise(F.lit(1.0))).alias("C7_F7_SocialOutgoingShareUp"), cloud.alias("C7_F8_CloudUploadBytesToday"),
        n("C7_F4_HelpTherapyLookupHits").alias("C9_F1_CrisisLineHits"), N.share(first("met"), first("n")).alias("C9_F2_SuicideMethodQueryRatio"), F.when(F.col("__url"), n("__forum")).otherwise(n("__reddit")).alias("C9_F4_SelfHarmForumVisits"),
        F.when(F.col("__url") & addr, n("__forum_up")).alias("C9_F5_SelfHarmForumUpBytes"), F.when(F.col("__url"), n("__will")).alias("C9_F7_WillInsuranceDownloads"), cloud.alias("C9_F8_CloudBackupUpBytesToday"), account_count.alias("C9_F9_AccountDeletionRequestsCount"),
        F.when(first("n") > 0, N.share(first("nmet"), F.col("__night"))).alias("C9_F11_NightNegativeSearchRatio"), "__addr",
    ).withColumn("C6_F8_FirstActivityMin", F.col("__first_sec") / 60).drop("__first_sec")


def distinct_counts(rows: DataFrame, keys: Keys) -> DataFrame:
    """Several distinct counts from one aggregate by (key, which, value), reduced before the shuffle."""
    return distinct_metrics(value_counts(rows, keys), keys)


def value_counts(rows: DataFrame, keys: Keys) -> DataFrame:
    """(keys, which, value, n): how often each domain, query and host occurs."""
    value = lambda which, c, on=None: F.struct(F.lit(which).alias("which"), (F.when(on, F.col(c)) if on is not None else F.col(c)).alias("value"))
    each = F.array(value("sld", "SLD"), value("chat", "SLD", F.col("chat")), value("q", "qname"), value("a", "ans_name"), value("u", "url"), value("h", "ResolvedHost"))
    long = rows.select(*keys, F.explode(F.filter(each, lambda x: x["value"].isNotNull())).alias("x")).select(*keys, "x.which", "x.value")
    return long.groupBy(*keys, "which", "value").agg(F.count("*").alias("n"))


def distinct_metrics(counts: DataFrame, keys: Keys) -> DataFrame:
    counted = counts.groupBy(*keys, "which").agg(F.count("*").alias("d"), F.sum("n").alias("n"))
    pick = lambda w, c: F.max(F.when(F.col("which") == w, F.col(c)))
    wide = counted.groupBy(*keys).agg(*(pick(w, c).alias(f"{c}_{w}") for w in ("sld", "chat", "q", "a", "u", "h") for c in ("d", "n")))
    repeat = lambda w: F.when(F.col(f"n_{w}") > 0, (F.col(f"n_{w}") - F.col(f"d_{w}")) / F.col(f"n_{w}").cast("double"))
    return wide.select(*keys, F.col("d_chat").cast("double").alias("F1_DistinctSocial"), F.col("d_sld").cast("double").alias("C2_F1_UniqueSLD"), F.coalesce(*map(repeat, ("sld", "q", "a", "h"))).alias("F5_RevisitRatio"), F.coalesce(*map(repeat, ("q", "a", "u"))).alias("C8_F4_RepeatedQueryRatio60m"))


def bins(rows: DataFrame, keys: Keys) -> DataFrame:
    """Bursts: minutes with three domains, ten minutes with three rows of a diet domain, night minutes with two query hits."""
    return burst_metrics(*burst_counts(rows, keys), keys)


def burst_counts(rows: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Different domains of each minute; rows of a diet domain in each ten minutes; queries and night hits of each minute."""
    by_sld = rows.where("SLD is not null").groupBy(*keys, "minute", "SLD").agg(F.lit(1).alias("x")).groupBy(*keys, "minute").agg(F.count("*").alias("n"))
    diet = rows.where("diet").groupBy(*keys, "SLD", F.floor(F.col("minute") / 10).alias("bin")).agg(F.count("*").alias("n"))
    night = F.col("hour").between(0, 5)
    hit = lambda c: F.count_if(night & N.matches("method", F.col(c)))
    queries = (("q", "qname"), ("a", "ans_name"), ("u", "url"))
    return by_sld, diet, rows.groupBy(*keys, "minute").agg(*(F.count(c).alias(f"n_{k}") for k, c in queries), *(hit(c).alias(f"h_{k}") for k, c in queries))


def burst_metrics(by_sld: DataFrame, diet: DataFrame, some: DataFrame, keys: Keys) -> DataFrame:
    dns = by_sld.groupBy(*keys).agg((F.count_if(F.col("n") >= 3) / F.greatest(F.lit(1.0), (F.max("minute") - F.min("minute")) / 60.0)).alias("C8_F2_DNSBurstRatePerHour"))
    diet = diet.groupBy(*keys).agg(F.count_if(F.col("n") >= 3).cast("double").alias("C3_F5_TrackerBurstCount"))
    two = lambda k: F.count_if(F.col(f"h_{k}") >= 2).cast("double")
    night_bursts = some.groupBy(*keys).agg(F.when(F.sum("n_q") > 0, two("q")).when(F.sum("n_a") > 0, two("a")).when(F.sum("n_u") > 0, two("u")).alias("C9_F10_NightSuicideQueryBursts"))
    return night_bursts.join(dns, [*keys], "left").join(diet, [*keys], "left")


SESSION_GAPS = {"chat": 300, "streaming": 300, "food": 300, "scale": 600, "night": 300, "all": 300, "brief": 120, "forum": 300}


def session_masks() -> dict[str, Column]:
    true = F.lit(True)
    return {"chat": F.col("chat"), "streaming": F.col("streaming"), "food": F.col("food"), "scale": F.col("scale") & (F.col("outbound") | ~F.array_contains("present", "src")), "night": F.col("hour").between(1, 6), "all": true, "brief": true, "forum": F.col("forum")}


def session_table(rows: DataFrame, keys: Keys) -> DataFrame:
    """All sessions that metrics use, by mask, with bytes sent and counts of either direction."""
    return sessions(masked(rows, session_masks()), keys, SESSION_GAPS, session_sums(), by=("mask",))


def session_sums() -> dict[str, Column]:
    return {"up": F.when(F.col("outbound"), F.col("bytes")).otherwise(0), "n_in": F.col("inbound").cast("int"), "n_out": F.col("outbound").cast("int")}


def session_metrics(found: DataFrame, keys: Keys) -> DataFrame:
    on = lambda m: F.col("mask") == m
    start = N.hour_of(F.col("first_us"))
    s = seconds()
    whole = F.floor(F.col("first_us") / F.lit(N.MICROS))
    n = lambda m, c=F.lit(True): F.count_if(on(m) & c).cast("double")
    some = lambda m, x: F.when(F.count_if(on(m)) > 0, x)
    two = lambda m, x: F.when(F.count_if(on(m)) >= 2, x)
    s_of = lambda m: F.when(on(m), s)
    mean = lambda m: F.sum(F.when(on(m), F.col("last_us") - F.col("first_us"))) / F.count_if(on(m)) / float(N.MICROS)  # noqa: E731  sums of whole numbers: in any order the same
    idle = F.max(F.when(on("night"), F.col("last_us"))) - F.min(F.when(on("night"), F.col("first_us"))) - F.sum(F.when(on("night"), F.col("last_us") - F.col("first_us")))
    return found.groupBy(*keys).agg(
        some("chat", mean("chat")).alias("F2_MeanSocialDurSec"), n("streaming", s >= 7200).alias("F3_LongStreams"), some("chat", n("chat")).alias("C2_F3_ChatSessionCount"),
        F.avg(F.when(on("chat"), F.col("up") / F.greatest(F.lit(1.0), s))).alias("__rate"), n("food").alias("C3_F1_FoodDeliveryHits"), some("food", n("food", (start >= 22) | (start < 6)) / n("food")).alias("C3_F2_LateNightDeliveryRatio"),
        two("food", (F.max(F.when(on("food"), whole)) - F.min(F.when(on("food"), whole))) / (n("food") - 1) / 86400.0).alias("C3_F3_MeanInterOrderDays"), n("scale").alias("C3_F6_SmartScaleUploads"),
        n("night", s <= 300).alias("C4_F5_NocturnalMicroSessionCount0106"), two("night", idle / F.lit(60.0 * N.MICROS) / (n("night") - 1)).alias("C4_F6_MeanInterAwakGapMin0106"),
        n("all", s < 30).alias("C5_F5_Sub30sSessions"), F.when((F.count_if(on("all")) >= 3) & (F.avg(s_of("all")) > 0), F.var_samp(s_of("all")) / F.avg(s_of("all"))).alias("C5_F6_SessionFano"),
        n("all", start.between(9, 17)).alias("C6_F2_DayActiveSessionCount"), n("brief", (s < 30) & (F.col("n_in") > 0) & (F.col("n_out") > 0)).alias("__micro"), some("forum", mean("forum")).alias("C9_F6_SelfHarmForumMeanSessLenSec"),
    )


DAY, NOON, SIX = 86400 * N.MICROS, 12 * 3600 * N.MICROS, 18 * 3600 * N.MICROS


def gap_masks(rows: DataFrame, keys: Keys, night: str = "calendar") -> DataFrame:
    """Rows once for each mask of ordered rows that holds for them."""
    in_day = F.pmod(F.col("us"), F.lit(DAY))
    known = F.col("src").isNotNull() & F.col("dst").isNotNull()
    out = F.col("outbound")
    masks = {"all": F.lit(True), "night": (F.col("hour") >= 22) | (F.col("hour") <= 4), "midday": in_day.between(NOON, SIX), "chat": F.col("chat") & known, "typing": F.col("chat") & out, "request": out & (F.col("bytes") <= 300)}
    base = rows.select(*keys, "us", "tie", "inbound", "outbound", F.explode(F.filter(F.array(*(F.when(m, F.lit(k)) for k, m in masks.items())), lambda x: x.isNotNull())).alias("mask"))
    if night == "shifted":
        moved = F.when(F.col("mask") == "night", F.to_date(F.timestamp_micros(F.col("us") - NOON)))
        base = base.withColumn("Date", F.coalesce(moved, F.col("Date")))
    return base


def gap_values() -> dict[str, Column]:
    """Of rows with the one before: whole seconds of replies and requests, microseconds between key strokes; null for others."""
    on = lambda m: F.col("mask") == m
    d = F.col("us") - F.col("prev_us")
    whole = F.floor(d / F.lit(N.MICROS))
    return {"reply": F.when(on("chat") & F.col("prev_inbound") & F.col("outbound") & (whole > 0) & (whole <= 120), whole), "typing": F.when(on("typing") & (d > 0) & (d <= 3 * N.MICROS), d), "request": F.when(on("request"), whole)}


def gap_ends() -> list[Column]:
    """Aggregates of rows with the one before that merge by the least or the greatest: longest gap, onset, gaps at midday."""
    on = lambda m: F.col("mask") == m
    d = F.col("us") - F.col("prev_us")
    noon = F.pmod(F.col("us"), F.lit(DAY)) - F.lit(NOON)
    half_hour = F.when(on("night") & (d >= 1800 * N.MICROS), F.struct("us", "prev_us"))
    return [
        F.max(F.when(on("all"), F.floor(d / F.lit(N.MICROS)))).alias("__longest"), F.min(half_hour).alias("__onset"), F.max(F.when(on("midday"), d)).alias("__mid"),
        F.min(F.when(on("midday"), noon)).alias("__mid0"), F.min(F.when(on("midday"), F.lit(SIX - NOON) - noon)).alias("__mid1"),
    ]


def gap_metrics(rows: DataFrame, keys: Keys, night: str = "calendar") -> DataFrame:
    """Measures of ordered rows. night="shifted" searches the onset in nights that begin at noon, per key with a Date."""
    gaps = with_previous(gap_masks(rows, keys, night), (*keys, "mask"), ("us", "inbound"), busiest=busiest_slot(rows, keys))
    value = gap_values()
    reply, typing, request = value["reply"], value["typing"] / F.lit(float(N.MICROS)), value["request"]
    agg = gaps.groupBy(*keys).agg(
        *gap_ends(), F.median(reply).alias("C2_F2_MedianReplyLatencySec"), F.median(typing).alias("C5_F3_MedianIKS"),
        F.when(F.count(typing) >= 3, F.stddev_samp(typing)).alias("C5_F4_IKSStd"), F.median(request).alias("C6_F6_MedianInterReqSec"), F.when((F.count(request) >= 2) & (F.avg(request) > 0), F.var_pop(request) / F.avg(request)).alias("C6_F7_InterReqFano"),
    )
    return finish_gaps(agg, keys)


def finish_gaps(agg: DataFrame, keys: Keys) -> DataFrame:
    """The measures of whole keys from their ends, medians and spreads."""
    onset, wake = F.col("__onset.prev_us"), F.col("__onset.us")
    return agg.select(
        *keys, (F.col("__longest") / 3600.0).alias("LongestInactivityHours"), N.minutes_from_22(N.clock_minutes(onset)).alias("C4_F1_OnsetDelayFrom2200Min"), (F.floor(N.clock_minutes(onset) * 60 + 1e-7) / 60).alias("C4_F1_OnsetLocalMin"),
        F.greatest(F.lit(0.0), N.clock_minutes(wake) - 240).alias("C4_F2_WakeAfter0400Min"), F.coalesce(F.greatest("__mid", "__mid0", "__mid1") / F.lit(60.0 * N.MICROS), F.lit(360.0)).alias("C6_F1_LongestMiddayIdleMin"),
        "C2_F2_MedianReplyLatencySec", "C5_F3_MedianIKS", "C5_F4_IKSStd", F.col("C5_F3_MedianIKS").alias("C8_F8_MedianIKSsec"), "C6_F6_MedianInterReqSec", "C6_F7_InterReqFano",
    )


#: Named in the catalog, without a definition: always missing.
UNDEFINED = ("C8_F1_MedianPageDwellSec", "C8_F5_QueryReformulationMax", "C8_F6_BackNavShare", "C8_F7_SERPTimeToFirstClickSec", "C9_F3_TherapyBookingVisits")
#: Counts that are 0 where a builder has no row for a key.
ZERO = ("C3_F5_TrackerBurstCount", "C2_F1_UniqueSLD", "F1_DistinctSocial")


def daily(rows: DataFrame, keys: Keys = ("Date",), night: str = "calendar") -> DataFrame:
    """All metrics of enriched rows by key, without those that need earlier days."""
    return joined_parts([counters(rows, keys), distinct_counts(rows, keys), bins(rows, keys), minute_measures(minutes(rows, keys), keys), session_metrics(session_table(rows, keys), keys), gap_metrics(rows, keys, night)], keys)


def joined_parts(parts: list[DataFrame], keys: Keys) -> DataFrame:
    """One frame of all groups of metrics; the counters come first and have every key."""
    out = reduce(lambda a, b: a.join(b, [*keys], "left"), parts)
    out = out.fillna(0.0, [*ZERO]).withColumns({"C2_F4_MeanUpstreamRateBps": F.when(F.col("__addr"), F.col("__rate")), "C8_F3_NotificationMicroSessionsCount": F.when(F.col("__addr"), F.col("__micro"))})
    return out.drop("__addr", "__rate", "__micro").withColumns({c: F.lit(None).cast("double") for c in UNDEFINED})
