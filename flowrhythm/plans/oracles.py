"""SQL for the registered queries, over the same test tables."""

from __future__ import annotations

from flowrhythm.functions.lists import CATEGORIES, PATTERNS
from flowrhythm.operators.status import CATALOG
from flowrhythm.plans.metrics import UNDEFINED
from flowrhythm.sources.views import DAILY_SQL, packet_sql

DAY = 86400000000


def _in(category: str, column: str = "SLD") -> str:
    return f"coalesce({column} IN ({', '.join(repr(x) for x in CATEGORIES[category])}), false)"


def _match(name: str, column: str) -> str:
    return f"coalesce(regexp_matches({column}, '{PATTERNS[name]}', 'i'), false)"


HOT = "SELECT * REPLACE (CASE WHEN tie % 10 <> 0 THEN CASE WHEN tie % 2 = 0 THEN '93.184.216.3' ELSE '93.184.216.200' END ELSE dst END AS dst) FROM ({})"


def _rows(dense: bool = False, view: str = "{}") -> str:
    """CTEs pk (packets), dm (DNS names) and r (enriched rows)."""
    private = "({0} LIKE '192.168.%' OR {0} = '255.255.255.255')"
    s, d = private.format("src"), private.format("dst")
    return f"""
WITH pk AS ({view.format(packet_sql(dense, "ansi"))}), dn AS (
  SELECT "Date", us, tie, ans_name, trim(x) AS ip, pos FROM (
    SELECT "Date", us, tie, ans_name, unnest(string_split(ans_ips, ',')) AS x, generate_subscripts(string_split(ans_ips, ','), 1) AS pos FROM pk WHERE is_dns AND ans_ips IS NOT NULL
  )
), dm AS (
  SELECT "Date", ip, ans_name AS host FROM (SELECT *, row_number() OVER (PARTITION BY "Date", ip ORDER BY us, tie, pos) AS rn FROM dn WHERE ans_name IS NOT NULL) WHERE rn = 1
), h AS (
  SELECT pk.*, coalesce(dm.host, ans_name, qname) AS ResolvedHost FROM pk LEFT JOIN dm ON pk."Date" = dm."Date" AND pk.dst = dm.ip
), g AS (
  SELECT *, CASE WHEN ResolvedHost LIKE '%.%' THEN regexp_extract(ResolvedHost, '[^.]+\\.[^.]+$') ELSE ResolvedHost END AS SLD, {s} AND NOT {d} AS outbound, NOT {s} AND {d} AS inbound,
    CAST(us // 3600000000 % 24 AS INTEGER) AS hour, us // 60000000 AS minute, length AS bytes FROM h
), r AS (
  SELECT *, {", ".join(f"{_in(c)} AS {c}" for c in ("social", "food", "diet", "scale", "mental_health", "crisis", "productivity", "cloud"))},
    {_in("social")} OR dport IN (443, 5222, 5223) AS chat, {_in("streaming")} AND inbound AS streaming, protocol = 'UDP' AND (sport IN (67, 68, 546, 547) OR dport IN (67, 68, 546, 547)) AS dhcp, {_match("forum", "url")} AS forum
  FROM g
)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round(CAST({a} AS DOUBLE) / {b}, 6) WHEN {a} > 0 THEN CAST('inf' AS DOUBLE) END"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round(CAST({a} AS DOUBLE) / {b}, 6) END"


def _circular(minutes: str, n: str = "3") -> str:
    r = f"(sqrt(power(sum(cos(2 * pi() * {minutes} / 1440)), 2) + power(sum(sin(2 * pi() * {minutes} / 1440)), 2)) / count({minutes}))"
    return f"CASE WHEN count({minutes}) >= {n} AND {r} > 0 THEN sqrt(greatest(0, -2 * ln(least({r}, 1)))) * 1440 / (2 * pi()) END"


def _sum(on: str, x: str = "bytes") -> str:
    return f"CAST(coalesce(sum({x}) FILTER (WHERE {on}), 0) AS DOUBLE)"


def _count(on: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {on}) AS DOUBLE)"


def _first(name: str) -> str:
    return f"CASE WHEN n_q > 0 THEN {name}_q WHEN n_a > 0 THEN {name}_a WHEN n_u > 0 THEN {name}_u END"


def counters(keys: str = '"Date"', chosen: str = "*") -> str:
    per_query = ", ".join(
        f"count({c}) AS n_{k}, {_count(_match('negative_self', c))} AS neg_{k}, {_count(_match('method', c))} AS met_{k}, {_count(_match('method', c) + ' AND hour <= 5')} AS nmet_{k}" for k, c in (("q", "qname"), ("a", "ans_name"), ("u", "url"))
    )
    clock = "(us % 86400000000) / 60000000.0"
    return f"""{_rows()}, a AS (
  SELECT {keys}, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE hour <= 5) AS night, count(*) FILTER (WHERE hour >= 22 OR hour <= 5) AS night22, count(*) FILTER (WHERE hour BETWEEN 6 AND 21) AS day,
    {_sum("inbound")} AS down, {_sum("outbound")} AS up, min(us) AS t0, max(us) AS t1, count(DISTINCT us // 3600000000) AS hours, {_count("productivity")} AS prod, {_sum("streaming")} AS stream, {_sum("chat AND outbound")} AS chat_up, {_sum("chat AND inbound")} AS chat_down,
    count(*) FILTER (WHERE social) AS social_n, count(*) FILTER (WHERE chat) AS chat_n, {_sum("social AND outbound")} AS soc_up, {_sum("social AND inbound")} AS soc_down, {_count("diet")} AS diet_n,
    {_circular("CASE WHEN scale AND outbound THEN " + clock + " END")} AS sd_out, {_circular("CASE WHEN scale THEN " + clock + " END")} AS sd_all, {_sum("hour <= 5")} AS bn, {_sum("hour BETWEEN 6 AND 21")} AS bd,
    count(*) FILTER (WHERE dhcp) AS dh, min(us) FILTER (WHERE dhcp) AS d0, max(us) FILTER (WHERE dhcp) AS d1, {_count("outbound AND bytes <= 300 AND (social OR dport IN (443, 5222, 5223))")} AS post, min(us) FILTER (WHERE hour >= 4) AS first_us,
    {_count("mental_health")} AS mh, {_count("crisis")} AS cr, {per_query}, {_count(_match("account", "url"))} AS acc, {_sum(_match("settings", "url"), "flow_sec")} AS settings, count(*) FILTER (WHERE cloud) AS cloud_n, {_sum("cloud AND outbound")} AS cloud_up,
    {_count("forum")} AS forum_n, {_sum("forum AND outbound")} AS forum_up, {_count(_match("will", "url"))} AS will_n
  FROM r GROUP BY ALL
), b AS (
  SELECT *, CASE WHEN social_n > 0 THEN soc_up ELSE chat_up END AS up2, CASE WHEN social_n > 0 THEN soc_down ELSE chat_down END AS down2, {_first("n")} AS n_x FROM a
), o AS (SELECT {keys}, n AS n_total_packets_today, CAST(night AS DOUBLE) AS n_night_packets_today, CAST(night22 AS DOUBLE) AS night_pkts_today, CAST(day AS DOUBLE) AS day_pkts_today, down AS down_bytes_today, up AS up_bytes_today,
  {_share("night", "n")} AS LateNightShare, {_ratio("down", "up")} AS F4_DownUpRatio, {_ratio("night", "day")} AS F8_NightDayRatioPkts, {_ratio("stream", "chat_up")} AS C2_F5_PassiveActiveByteRatio, prod AS C2_F6_ProductivityHits,
  CASE WHEN social_n > 0 OR chat_n > 0 THEN {_share("up2", "(up2 + down2)")} END AS C2_F7_SocialOutgoingShareUp, diet_n AS C3_F4_DietSiteVisits, round(coalesce(sd_out, sd_all), 6) AS C3_F7_WeighInTimeVarMin, {_ratio("bn", "bd")} AS C4_F8_NightDayTrafficRatioBytes,
  round(dh / least(24.0, greatest(1.0, (t1 - t0) / 3600000000.0)), 6) AS C5_F1_DhcpPerHour, CASE WHEN dh >= 2 THEN round((d1 - d0) / 60000000.0 / (dh - 1), 6) END AS C5_F2_WifiDwellMin, round(up / (hours * 3600.0), 6) AS C6_F4_UpstreamBpsPerActiveHour, post AS C6_F5_PostChatCount,
  mh AS C7_F1_MentalHealthSiteVisitsDay, cr AS C7_F4_HelpTherapyLookupHits, {_share(_first("neg"), "n_x")} AS C7_F2_NegativeSelfSearchRatio, round(settings, 6) AS C7_F3_SelfAssessmentDwellSec, acc AS C7_F5_AccountDeleteUnsubCount, round(settings, 6) AS C7_F6_SettingsPrivacyDwellSec,
  CASE WHEN social_n > 0 THEN {_share("soc_up", "(soc_up + soc_down)")} END AS C7_F7_SocialOutgoingShareUp, CASE WHEN cloud_n = 0 THEN 0.0 ELSE cloud_up END AS C7_F8_CloudUploadBytesToday, cr AS C9_F1_CrisisLineHits, {_share(_first("met"), "n_x")} AS C9_F2_SuicideMethodQueryRatio,
  forum_n AS C9_F4_SelfHarmForumVisits, forum_up AS C9_F5_SelfHarmForumUpBytes, will_n AS C9_F7_WillInsuranceDownloads, CASE WHEN cloud_n = 0 THEN 0.0 ELSE cloud_up END AS C9_F8_CloudBackupUpBytesToday, acc AS C9_F9_AccountDeletionRequestsCount,
  CASE WHEN n_x > 0 THEN {_share(_first("nmet"), "night")} END AS C9_F11_NightNegativeSearchRatio, round((first_us % {DAY} // 1000000) / 60.0, 6) AS C6_F8_FirstActivityMin
FROM b)
SELECT {chosen} FROM o"""


def distinct() -> str:
    rep = lambda c: f"CASE WHEN count({c}) > 0 THEN (count({c}) - count(DISTINCT {c})) / CAST(count({c}) AS DOUBLE) END"
    null_if_0 = lambda x: f"nullif(CAST({x} AS DOUBLE), 0)"
    return f"""{_rows()}
SELECT "Date", {null_if_0("count(DISTINCT SLD) FILTER (WHERE chat)")} AS F1_DistinctSocial, {null_if_0("count(DISTINCT SLD)")} AS C2_F1_UniqueSLD, round(coalesce({rep("SLD")}, {rep("qname")}, {rep("ans_name")}, {rep("ResolvedHost")}), 6) AS F5_RevisitRatio,
  round(coalesce({rep("qname")}, {rep("ans_name")}, {rep("url")}), 6) AS C8_F4_RepeatedQueryRatio60m
FROM r GROUP BY "Date" HAVING count(SLD) + count(qname) + count(ans_name) + count(url) + count(ResolvedHost) > 0"""


def bursts(dense: bool = True) -> str:
    return f"""{_rows(dense)}, m AS (SELECT "Date", minute, count(DISTINCT SLD) AS n FROM r WHERE SLD IS NOT NULL GROUP BY ALL), d AS (
  SELECT "Date", round(count(*) FILTER (WHERE n >= 3) / greatest(1.0, (max(minute) - min(minute)) / 60.0), 6) AS C8_F2_DNSBurstRatePerHour FROM m GROUP BY ALL
), t AS (SELECT "Date", CAST(count(*) FILTER (WHERE n >= 3) AS DOUBLE) AS C3_F5_TrackerBurstCount FROM (SELECT "Date", SLD, us // 600000000 AS b, count(*) AS n FROM r WHERE diet GROUP BY ALL) GROUP BY ALL
), q AS (SELECT "Date", minute, count(qname) AS n_q, count(ans_name) AS n_a, count(url) AS n_u, {", ".join(f"count(*) FILTER (WHERE hour <= 5 AND {_match('method', c)}) AS h_{k}" for k, c in (("q", "qname"), ("a", "ans_name"), ("u", "url")))} FROM r GROUP BY ALL
), n AS (SELECT "Date", CASE WHEN sum(n_q) > 0 THEN CAST(count(*) FILTER (WHERE h_q >= 2) AS DOUBLE) WHEN sum(n_a) > 0 THEN CAST(count(*) FILTER (WHERE h_a >= 2) AS DOUBLE) WHEN sum(n_u) > 0 THEN CAST(count(*) FILTER (WHERE h_u >= 2) AS DOUBLE) END AS C9_F10_NightSuicideQueryBursts FROM q GROUP BY ALL)
SELECT n."Date", C9_F10_NightSuicideQueryBursts, C8_F2_DNSBurstRatePerHour, C3_F5_TrackerBurstCount FROM n LEFT JOIN d ON n."Date" = d."Date" LEFT JOIN t ON n."Date" = t."Date\""""


def whole_day() -> str:
    """Every metric of a day, without those that need earlier ones."""
    distinct_ = f'SELECT * REPLACE (coalesce(F1_DistinctSocial, 0) AS F1_DistinctSocial, coalesce(C2_F1_UniqueSLD, 0) AS C2_F1_UniqueSLD) FROM ({distinct()})'
    parts = {"s": session_metrics(), "g": gaps(False), "m": minute_series(), "d": distinct_, "b": bursts(False)}
    joins = " ".join(f'LEFT JOIN ({sql}) {k} ON c."Date" = {k}."Date"' for k, sql in parts.items())
    zero = {"b": "* EXCLUDE (\"Date\") REPLACE (coalesce(C3_F5_TrackerBurstCount, 0) AS C3_F5_TrackerBurstCount)"}
    return f"""SELECT c.*, {", ".join(f'{k}.{zero.get(k, "* EXCLUDE (" + chr(34) + "Date" + chr(34) + ")")}' for k in parts)}, {", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in UNDEFINED)} FROM ({counters()}) c {joins}"""


def minute_series() -> str:
    """Over the dense series: every minute from the first to the last active one, zeros included."""
    return f"""{_rows()}, c AS (SELECT "Date", minute, count(*) AS n FROM r GROUP BY ALL), e AS (SELECT "Date", min(minute) AS lo, max(minute) AS hi FROM c GROUP BY ALL), f AS (
  SELECT "Date", unnest(range(lo, hi + 1)) AS minute FROM e
), s AS (SELECT f."Date", f.minute, coalesce(c.n, 0) AS n, CASE WHEN c.n IS NULL THEN 0.0 ELSE 1.0 END AS x, f.minute // 60 % 24 AS hour, f.minute // 60 AS hours FROM f LEFT JOIN c ON f."Date" = c."Date" AND f.minute = c.minute
), l AS (SELECT *, x - lag(x) OVER (PARTITION BY "Date" ORDER BY minute) AS d FROM s
), t AS (SELECT "Date", count(*) AS nn, avg(x) AS p, sum(power(d, 2)) AS dd, avg(n) AS mn, var_pop(n) AS vn, {_count("hour <= 5 AND x = 1")} AS night, {_count("hour BETWEEN 8 AND 20 AND x = 1")} AS day,
  count(*) FILTER (WHERE hour BETWEEN 8 AND 17) AS n8, count(*) FILTER (WHERE hour BETWEEN 8 AND 17 AND x = 0) AS i8, count(*) FILTER (WHERE hour BETWEEN 9 AND 17) AS n9, count(*) FILTER (WHERE hour BETWEEN 9 AND 17 AND x = 0) AS i9 FROM l GROUP BY ALL
), v AS (SELECT s."Date", sum(power(x - p, 2)) AS ssd FROM s JOIN t ON s."Date" = t."Date" GROUP BY ALL
), k AS (SELECT "Date", hour, avg(x) AS m FROM s GROUP BY ALL), z AS (SELECT t."Date", sum(power(coalesce(k.m, 0) - t.p, 2)) AS between_h FROM t CROSS JOIN range(24) u(hour) LEFT JOIN k ON k."Date" = t."Date" AND k.hour = u.hour GROUP BY ALL
), y AS (SELECT "Date", avg(n) AS mh, stddev_pop(n) AS sh FROM (SELECT "Date", hours, sum(n) AS n FROM s GROUP BY ALL) GROUP BY ALL)
SELECT t."Date", CAST(night AS BIGINT) AS ActiveNightMinutes, CAST(day AS BIGINT) AS ActiveDayMinutes, {_share("night", "day")} AS ND_Ratio, CASE WHEN nn >= 2 AND ssd > 1e-12 THEN round(nn * between_h / (24 * ssd), 6) END AS "IS",
  CASE WHEN nn >= 2 AND ssd > 1e-12 THEN round(nn * dd / ((nn - 1) * ssd), 6) END AS IV, CASE WHEN mn > 0 THEN round(vn / mn, 6) END AS F6_Fano, CASE WHEN mh > 0 THEN round(sh / mh, 6) END AS F7_HourlyCV,
  CASE WHEN n8 > 0 THEN round(i8 / CAST(n8 AS DOUBLE), 6) END AS C4_F7_DaytimeIdleRatio0818, CASE WHEN n9 > 0 THEN round(i9 / 540.0, 6) END AS C6_F3_DayIdleRatio_09_18
FROM t JOIN v ON t."Date" = v."Date" JOIN z ON t."Date" = z."Date" JOIN y ON t."Date" = y."Date\""""


MASKS = {"chat": ("chat", 300), "streaming": ("streaming", 300), "food": ("food", 300), "scale": ("scale AND outbound", 600), "night": ("hour BETWEEN 1 AND 6", 300), "everything": ("true", 300), "brief": ("true", 120), "forum": ("forum", 300)}


def _sessions() -> str:
    """CTE w: all sessions of all masks, by comparing each row with the one before."""
    rows = " UNION ALL ".join(f"SELECT '{m}' AS mask, {g * 1000000} AS gap, \"Date\", us, tie, bytes, inbound, outbound FROM r WHERE {c}" for m, (c, g) in MASKS.items())
    return f"""x AS ({rows}), x2 AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY mask, "Date" ORDER BY us, tie) > gap THEN 1 ELSE 0 END AS new FROM x
), x3 AS (SELECT *, sum(new) OVER (PARTITION BY mask, "Date" ORDER BY us, tie) AS sn FROM x2
), w AS (SELECT mask, "Date", sn, min(us) AS a, max(us) AS b, (max(us) - min(us)) / 1000000.0 AS s, {_sum("outbound")} AS up, count(*) FILTER (WHERE inbound) AS n_in, count(*) FILTER (WHERE outbound) AS n_out, min(us) // 3600000000 % 24 AS h FROM x3 GROUP BY ALL)"""


def session_metrics() -> str:
    n = lambda m, c="true": f"CAST(count(*) FILTER (WHERE mask = '{m}' AND {c}) AS DOUBLE)"
    return f"""{_rows()}, {_sessions()}, v AS (SELECT *, (lead(a) OVER (PARTITION BY mask, "Date" ORDER BY a) - b) / 60000000.0 AS idle, lead(a // 1000000) OVER (PARTITION BY mask, "Date" ORDER BY a) - a // 1000000 AS next_start FROM w)
SELECT "Date", round(sum(b - a) FILTER (WHERE mask = 'chat') / count(*) FILTER (WHERE mask = 'chat') / 1000000.0, 6) AS F2_MeanSocialDurSec, {n("streaming", "s >= 7200")} AS F3_LongStreams, nullif({n("chat")}, 0) AS C2_F3_ChatSessionCount, round(avg(up / greatest(1.0, s)) FILTER (WHERE mask = 'chat'), 6) AS C2_F4_MeanUpstreamRateBps,
  {n("food")} AS C3_F1_FoodDeliveryHits, {_share(n("food", "(h >= 22 OR h < 6)"), n("food"))} AS C3_F2_LateNightDeliveryRatio, round(avg(next_start) FILTER (WHERE mask = 'food') / 86400.0, 6) AS C3_F3_MeanInterOrderDays, {n("scale")} AS C3_F6_SmartScaleUploads,
  {n("night", "s <= 300")} AS C4_F5_NocturnalMicroSessionCount0106, round(avg(idle) FILTER (WHERE mask = 'night'), 6) AS C4_F6_MeanInterAwakGapMin0106, {n("everything", "s < 30")} AS C5_F5_Sub30sSessions,
  CASE WHEN {n("everything")} >= 3 AND avg(s) FILTER (WHERE mask = 'everything') > 0 THEN round(var_samp(s) FILTER (WHERE mask = 'everything') / avg(s) FILTER (WHERE mask = 'everything'), 6) END AS C5_F6_SessionFano,
  {n("everything", "h BETWEEN 9 AND 17")} AS C6_F2_DayActiveSessionCount, {n("brief", "s < 30 AND n_in > 0 AND n_out > 0")} AS C8_F3_NotificationMicroSessionsCount, round(sum(b - a) FILTER (WHERE mask = 'forum') / count(*) FILTER (WHERE mask = 'forum') / 1000000.0, 6) AS C9_F6_SelfHarmForumMeanSessLenSec
FROM v GROUP BY "Date\""""


def gaps(dense: bool) -> str:
    lagged = lambda on: f'SELECT "Date", us, tie, inbound, outbound, us - lag(us) OVER (PARTITION BY "Date" ORDER BY us, tie) AS d, lag(us) OVER (PARTITION BY "Date" ORDER BY us, tie) AS p, lag(inbound) OVER (PARTITION BY "Date" ORDER BY us, tie) AS pi FROM r WHERE {on}'
    tod = f"(us % {DAY})"
    return f"""{_rows(dense)}, al AS ({lagged("true")}), ni AS ({lagged("hour >= 22 OR hour <= 4")}), mi AS ({lagged(f"{tod} BETWEEN 43200000000 AND 64800000000")}), ch AS ({lagged("chat AND src IS NOT NULL AND dst IS NOT NULL")}), ty AS ({lagged("chat AND outbound")}), rq AS ({lagged("outbound AND bytes <= 300")}),
a1 AS (SELECT "Date", round(max(d // 1000000) / 3600.0, 6) AS LongestInactivityHours FROM al GROUP BY ALL),
n1 AS (SELECT "Date", p, us FROM (SELECT *, row_number() OVER (PARTITION BY "Date" ORDER BY us, tie) AS rn FROM ni WHERE d >= 1800000000) WHERE rn = 1),
m1 AS (SELECT "Date", greatest(max(d), min({tod}) - 43200000000, 64800000000 - max({tod})) / 60000000.0 AS mid FROM mi GROUP BY ALL),
c1 AS (SELECT "Date", quantile_cont(d // 1000000, 0.5) AS reply FROM ch WHERE pi AND outbound AND d // 1000000 > 0 AND d // 1000000 <= 120 GROUP BY ALL),
t1 AS (SELECT "Date", quantile_cont(d / 1000000.0, 0.5) AS iks, CASE WHEN count(*) >= 3 THEN stddev_samp(d / 1000000.0) END AS sd FROM ty WHERE d > 0 AND d <= 3000000 GROUP BY ALL),
r1 AS (SELECT "Date", quantile_cont(d // 1000000, 0.5) AS req, CASE WHEN count(d) >= 2 AND avg(d // 1000000) > 0 THEN var_pop(d // 1000000) / avg(d // 1000000) END AS fano FROM rq GROUP BY ALL)
SELECT a1."Date", LongestInactivityHours, round((n1.p % {DAY} / 60000000.0 - 1320 + 1440) % 1440, 6) AS C4_F1_OnsetDelayFrom2200Min, round((n1.p % {DAY} // 1000000) / 60.0, 6) AS C4_F1_OnsetLocalMin, round(greatest(0, n1.us % {DAY} / 60000000.0 - 240), 6) AS C4_F2_WakeAfter0400Min,
  round(coalesce(mid, 360.0), 6) AS C6_F1_LongestMiddayIdleMin, CAST(reply AS DOUBLE) AS C2_F2_MedianReplyLatencySec, round(iks, 6) AS C5_F3_MedianIKS, round(sd, 6) AS C5_F4_IKSStd, round(iks, 6) AS C8_F8_MedianIKSsec, CAST(req AS DOUBLE) AS C6_F6_MedianInterReqSec, round(fano, 6) AS C6_F7_InterReqFano
FROM a1 LEFT JOIN n1 ON a1."Date" = n1."Date" LEFT JOIN m1 ON a1."Date" = m1."Date" LEFT JOIN c1 ON a1."Date" = c1."Date" LEFT JOIN t1 ON a1."Date" = t1."Date" LEFT JOIN r1 ON a1."Date" = r1."Date\""""


def tuned() -> str:
    """One-dimensional k-means by recursion: each round takes the means of what is nearest, until they stay."""
    from flowrhythm.operators.tune import LEAST, ROUNDS

    d = [f"power(value - c{i}, 2)" for i in (1, 2, 3)]
    own = f"CASE WHEN {d[0]} <= {d[1]} AND {d[0]} <= {d[2]} THEN 1 WHEN {d[1]} <= {d[2]} THEN 2 ELSE 3 END"
    far = [f"abs(value - q{i})" for i in (1, 2, 3)]
    near = f"CASE WHEN {far[0]} <= {far[1]} AND {far[0]} <= {far[2]} THEN 1 WHEN {far[1]} <= {far[2]} THEN 2 ELSE 3 END"
    mean = lambda i: f"coalesce(avg(value) FILTER (WHERE o = {i}), max(c{i}))"
    close = " AND ".join(f"abs({mean(i)} - max(c{i})) <= 1e-8 + 1e-5 * abs(max(c{i}))" for i in (1, 2, 3))
    q = lambda p: f"coalesce(quantile_cont(value, {p}), 0)"
    return f"""WITH RECURSIVE d AS ({DAILY_SQL}), {LONG}, v AS MATERIALIZED (SELECT entity, metric, value FROM lg WHERE value IS NOT NULL), z AS MATERIALIZED (
  SELECT entity, metric, count(value) AS n, {q(0.15)} AS s1, {q(0.5)} AS s2, {q(0.85)} AS s3, {q(0.2)} AS q1, {q(0.5)} AS q2, {q(0.8)} AS q3, {q(0.1)} AS p10, {q(0.5)} AS p50, {q(0.9)} AS p90 FROM lg GROUP BY ALL
), k AS (
  SELECT entity, metric, 0 AS r, CAST(s1 AS DOUBLE) AS c1, CAST(s2 AS DOUBLE) AS c2, CAST(s3 AS DOUBLE) AS c3, CAST(0 AS BIGINT) AS n1, CAST(0 AS BIGINT) AS n2, CAST(0 AS BIGINT) AS n3, false AS done FROM z WHERE n >= {LEAST}
  UNION ALL
  SELECT entity, metric, max(r) + 1, {mean(1)}, {mean(2)}, {mean(3)}, count(*) FILTER (WHERE o = 1), count(*) FILTER (WHERE o = 2), count(*) FILTER (WHERE o = 3), {close}
  FROM (SELECT k.*, value, {own} AS o FROM k JOIN v USING (entity, metric) WHERE NOT done AND r < {ROUNDS}) GROUP BY entity, metric
), f(entity, metric, c1, c2, c3, n1, n2, n3) AS (
  SELECT entity, metric, l[1].c, l[2].c, l[3].c, l[1].n, l[2].n, l[3].n FROM (
    SELECT entity, metric, list_sort([{{'c': c1, 'i': 1, 'n': n1}}, {{'c': c2, 'i': 2, 'n': n2}}, {{'c': c3, 'i': 3, 'n': n3}}]) AS l FROM (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY r DESC) AS last FROM k) WHERE last = 1)
  UNION ALL
  SELECT z.entity, z.metric, max(q1), max(q2), max(q3), count(*) FILTER (WHERE {near} = 1 AND value IS NOT NULL), count(*) FILTER (WHERE {near} = 2 AND value IS NOT NULL), count(*) FILTER (WHERE {near} = 3 AND value IS NOT NULL)
  FROM z LEFT JOIN v ON z.entity = v.entity AND z.metric = v.metric WHERE n < {LEAST} GROUP BY z.entity, z.metric
), o AS (
  SELECT f.*, p10, p50, p90, (c1 + c2) / 2 AS a, (c2 + c3) / 2 AS b, greatest(1e-9, 0.05 * (c3 - c1 + 1e-9)) AS eps, greatest(0, p90 - p10) AS measure FROM f JOIN z ON f.entity = z.entity AND f.metric = z.metric
)
SELECT entity, metric, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3, n1, n2, n3, round(CASE WHEN a < b THEN a ELSE c2 - eps END, 6) AS lo, round(CASE WHEN a < b THEN b ELSE c2 + eps END, 6) AS mid, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90,
  round(CASE WHEN sum(measure) OVER (PARTITION BY entity) > 0 THEN measure / sum(measure) OVER (PARTITION BY entity) ELSE 1.0 / count(*) OVER (PARTITION BY entity) END, 6) AS w, 'tri' AS type, CAST('inf' AS DOUBLE) AS hi, metric = 'm2' AS invert FROM o"""


def headline() -> str:
    ok = {m: v for ms in CATALOG.values() for m, v in ms.items()}
    one = lambda m: f"""SELECT "Date", '{m}' AS metric, CAST({m} AS DOUBLE) AS value, CASE WHEN {m} IS NULL OR NOT isfinite({m}) THEN 'N/A' WHEN {m} {'<=' if ok[m][1] else '>='} {ok[m][0]} THEN 'OK' ELSE 'Caution' END AS status FROM """
    first = f"SELECT * FROM ({counters()})"
    second = f"SELECT * FROM ({session_metrics()})"
    return f"WITH c AS ({first}), s AS ({second}) {one('LateNightShare')} c UNION ALL {one('F4_DownUpRatio')} c UNION ALL {one('F2_MeanSocialDurSec')} s UNION ALL {one('C2_F3_ChatSessionCount')} s"


FLAGS = ("outbound", "inbound", "chat", "streaming", "dhcp", "social", "food", "diet", "scale", "mental_health", "crisis", "productivity", "cloud", "forum")
PACKETS = f'WITH pk AS ({packet_sql(False, "ansi")})'
KIND = "CASE WHEN contains(lower(\"Dataset\"), 'onu') THEN 'ONU' WHEN contains(lower(\"Dataset\"), 'bras') THEN 'BRAS' ELSE 'Other' END"
PREFIX = "regexp_replace(\"Dataset\", '([_-]?\\d+)$', '')"
TOKEN = f"regexp_replace(regexp_replace(regexp_replace(lower({PREFIX}), '^(onu_|bras_|other_)', ''), '^capture_', ''), '^[_-]+', '')"
MONDAY = 'CAST("Date" - CAST(isodow("Date") - 1 AS INTEGER) AS DATE)'
BOTH = "SELECT src AS ip, \"Dataset\", \"Date\" FROM pk UNION ALL SELECT dst, \"Dataset\", \"Date\" FROM pk"
SLOTS = 'sl AS (SELECT "Date", count(*) AS slots FROM (SELECT DISTINCT "Dataset", "Date", us // 300000000 FROM pk) GROUP BY ALL), ad AS (SELECT CAST(unnest(generate_series(min("Date"), max("Date"), INTERVAL 1 DAY)) AS DATE) AS "Date" FROM sl), sp AS (SELECT ad."Date", coalesce(slots, 0) AS slots FROM ad LEFT JOIN sl ON ad."Date" = sl."Date")'
NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
DAILY = f"WITH d AS ({DAILY_SQL})"
LONG = "lg AS (" + " UNION ALL ".join(f"SELECT entity, day, '{m}' AS metric, {m} AS value FROM d" for m in ("m1", "m2", "m3", "m4")) + ")"


def _weekday(day: str) -> str:
    return f"[{', '.join(repr(x) for x in DAYS)}][CAST(isodow({day}) AS INTEGER)]"


def _status(overrides: bool) -> str:
    rules = {"m1": (1.0, True), "m2": (25.0 if overrides else 20.0, False), "m3": (0.05, True), "m4": (0.0, not overrides)}
    good = " ".join(f"WHEN metric = '{m}' THEN value {'<=' if up else '>='} {ok}" for m, (ok, up) in rules.items())
    return f"CASE WHEN value IS NULL THEN 'N/A' WHEN (CASE {good} END) THEN 'OK' ELSE 'Caution' END"


MU = {
    "m1": ("C1", 0.5, "CASE WHEN m1 IS NULL THEN 0 WHEN m1 <= 0 OR m1 >= 3 THEN 0 WHEN m1 = 1 THEN 1 WHEN m1 < 1 THEN m1 ELSE (3 - m1) / 2.0 END"),
    "m3": ("C1", 0.6, "coalesce(least(greatest(m3, 0), 1), 0)"),
    "m2": ("C2", 0.7, "CASE WHEN m2 IS NULL THEN 0 ELSE 1 - (CASE WHEN m2 >= 40 THEN 1 WHEN m2 <= 10 THEN 0 ELSE (m2 - 10) / 30.0 END) END"),
    "m4": ("C2", 0.3, "CASE WHEN m4 IS NULL THEN 0 WHEN m4 <= 0 THEN 1 WHEN m4 >= 2 THEN 0 ELSE (2 - m4) / 2.0 END"),
}
SCORES = f"sc AS (SELECT entity, day, " + ", ".join(f"least(greatest({' + '.join(f'{w} * ({mu})' for g, w, mu in MU.values() if g == c)}, 0), 1) AS L_{c}" for c in ("C1", "C2")) + " FROM d)"  # noqa: F541
GATED = "gt AS (SELECT *, " + ", ".join(f"sum(CASE WHEN L_{c} >= 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 2 AS present_{c}" for c in ("C1", "C2")) + " FROM sc), fl AS (SELECT entity, day, present_C1, present_C2, CAST(present_C1 AS INTEGER) + CAST(present_C2 AS INTEGER) AS n_present, present_C2 AS flag FROM gt)"


DELTA = f"""{DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day) AS rn FROM d), h AS (SELECT a.entity, a.day, quantile_cont(b.m2, 0.5) AS med FROM n a JOIN n b ON a.entity = b.entity AND b.rn BETWEEN a.rn - 28 AND a.rn - 1 GROUP BY ALL)
SELECT d.entity, d.day, round(m2 - med, 6) AS delta FROM d LEFT JOIN h ON d.entity = h.entity AND d.day = h.day"""
FILES = "fs AS (SELECT \"Date\", \"Dataset\" || '|' || CAST(sum(length) AS VARCHAR) || '|' || CAST(max(us) // 1000000 AS VARCHAR) AS x FROM pk GROUP BY \"Date\", \"Dataset\"), fp AS (SELECT \"Date\", md5(string_agg(x, '|' ORDER BY x)) AS \"Fingerprint\" FROM fs GROUP BY \"Date\")"


def _history(column: str, n: int, body: str, output: str) -> str:
    """The last n values before a day, found by comparing days."""
    return f"""h AS (SELECT a.entity, a.day, b.{column} AS v, row_number() OVER (PARTITION BY a.entity, a.day ORDER BY b.day DESC) AS rn FROM d a JOIN d b ON a.entity = b.entity AND b.day < a.day AND b.{column} IS NOT NULL
), s AS (SELECT entity, day, {body} FROM h WHERE rn <= {n} GROUP BY ALL) SELECT d.entity, d.day, {output} FROM d LEFT JOIN s ON d.entity = s.entity AND d.day = s.day"""


def all_oracles() -> dict[str, str]:
    hours = ", ".join(f"count(*) FILTER (WHERE hour = {h}) AS h{h:02d}" for h in range(24))
    cells = lambda n, at: f"(SELECT DISTINCT {n} FROM r) z CROSS JOIN range({at}) u(i)"
    return {
        "headline_status": headline(),
        "daily_counters": counters(),
        "daily_counters_by_dataset": counters('"Dataset", "Date"', '"Dataset", "Date", n_total_packets_today, down_bytes_today, up_bytes_today, LateNightShare, F4_DownUpRatio, C5_F1_DhcpPerHour, C6_F8_FirstActivityMin'),
        "daily_distinct": distinct(),
        "daily_bursts": bursts(),
        "daily_minute_series": minute_series(),
        "daily_sessions": session_metrics(),
        "daily_gaps": gaps(False),
        "daily_gaps_dense": gaps(True),
        "daily_from_states": whole_day(),
        "dns_names": f'{_rows()} SELECT "Date", ip, host FROM dm',
        "enriched_domains": f'{_rows()} SELECT "Date", SLD, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {f}) AS n_{f}" for f in FLAGS)} FROM r GROUP BY ALL',
        "session_table": f"""{_rows()}, x AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY "Dataset", "Date" ORDER BY us, tie) > 300000000 THEN 1 ELSE 0 END AS new FROM r), y AS (SELECT *, sum(new) OVER (PARTITION BY "Dataset", "Date" ORDER BY us, tie) AS sn FROM x)
SELECT "Dataset", "Date", min(us) AS first_us, max(us) AS last_us, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, round((max(us) - min(us)) / 1000000.0, 6) AS seconds FROM y GROUP BY "Dataset", "Date", sn""",
        "enriched_hot_addresses": f"""{_rows(view=HOT)}, us AS (SELECT src AS ip, arg_max('user_' || CAST(user_id % 20 AS VARCHAR), user_id) AS name FROM ({packet_sql(False, "ansi")}) WHERE src LIKE '192.168.%' GROUP BY src)
SELECT "Date", SLD, CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL AND a.name <> b.name THEN a.name || '/' || b.name ELSE coalesce(a.name, b.name, '') END AS "User", count(*) AS packets, count(*) FILTER (WHERE outbound) AS n_out
FROM r LEFT JOIN us a ON r.src = a.ip LEFT JOIN us b ON r.dst = b.ip GROUP BY ALL""",
        "dataset_catalog": f'{PACKETS} SELECT DISTINCT "Dataset", {KIND} AS type, {PREFIX} AS prefix, {TOKEN} AS token FROM pk',
        "dataset_selection": f"{PACKETS}, c AS (SELECT DISTINCT \"Dataset\", {KIND} AS type, {PREFIX} AS prefix, {TOKEN} AS token FROM pk) SELECT * FROM c WHERE type = 'ONU' OR token = 'home' OR \"Dataset\" = 'lab_03'",
        "slots_per_day": f"{PACKETS}, {SLOTS} SELECT * FROM sp",
        "slot_calendar": f'{PACKETS}, {SLOTS} SELECT CAST(isoyear("Date") AS INTEGER) AS year, CAST(weekofyear("Date") AS INTEGER) AS week, {", ".join(f"CAST(sum(slots) FILTER (WHERE isodow(\"Date\") = {i + 1}) AS BIGINT) AS {n}" for i, n in enumerate(NAMES))} FROM sp GROUP BY ALL',
        "week_starts": f'{PACKETS} SELECT DISTINCT {MONDAY} AS WeekStart FROM pk',
        "row_labels": f"{PACKETS} SELECT {KIND} || ' ' || {TOKEN} || ' ' || strftime(\"Date\", '%Y-%m-%d') AS Label, {KIND} AS Scope, {MONDAY} AS WeekStart, count(*) AS packets FROM pk GROUP BY ALL",
        "new_addresses": f"{PACKETS}, b AS ({BOTH}) SELECT DISTINCT ip FROM b WHERE ip NOT IN (SELECT ip FROM b WHERE \"Dataset\" = 'lab_03')",
        "merged_addresses": f"{PACKETS}, b AS ({BOTH}) SELECT DISTINCT ip FROM b",
        "addresses_in_urls": f"{PACKETS}, b AS ({BOTH}) SELECT DISTINCT ip FROM b",
        "packets_per_address": f"{PACKETS}, b AS ({BOTH}) SELECT ip, count(*) AS packets FROM b GROUP BY ip",
        "packets_by_user": f"""{PACKETS}, us AS (SELECT src AS ip, arg_max('user_' || CAST(user_id % 20 AS VARCHAR), user_id) AS name FROM pk WHERE src LIKE '192.168.%' GROUP BY src)
SELECT CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL AND a.name <> b.name THEN a.name || '/' || b.name ELSE coalesce(a.name, b.name, '') END AS "User", count(*) AS packets FROM pk LEFT JOIN us a ON pk.src = a.ip LEFT JOIN us b ON pk.dst = b.ip GROUP BY ALL""",
        "touching_addresses": f'{PACKETS}, b AS ({BOTH}), c AS (SELECT ip FROM b GROUP BY ip HAVING count(*) >= 100) SELECT "Date", count(*) AS packets FROM pk WHERE src IN (SELECT ip FROM c) OR dst IN (SELECT ip FROM c) GROUP BY "Date"',
        "preview_rows": f'{PACKETS} SELECT tie, "Date", src, dst, protocol, length FROM pk ORDER BY us, tie LIMIT 100',
        "delta_from_median": DELTA,
        "absolute_z": f"{DAILY}, {_history('m3', 30, 'count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd', 'CASE WHEN n >= 7 AND sd > 0 THEN round(abs((m3 - m) / sd), 6) END AS abs_z')}",
        "circular_spread": f"WITH d AS (SELECT *, CASE WHEN m3 IS NOT NULL THEN m2 * 37 % 1440 END AS clock FROM ({DAILY_SQL})), {_history('clock', 14, _circular('v') + ' AS sd', 'round(sd, 6) AS spread')}",
        "metric_status": f"{DAILY}, {LONG} SELECT entity, day, metric, round(value, 6) AS value, {_status(True)} AS status FROM lg",
        "status_counts": f"""{DAILY}, {LONG}, st AS (SELECT day, CASE WHEN metric IN ('m1', 'm2') THEN 'A' ELSE 'B' END AS "group", {_status(False)} AS status FROM lg)
SELECT day, "group", count(*) FILTER (WHERE status = 'OK') AS n_ok, count(*) FILTER (WHERE status = 'Caution') AS n_caution, count(*) FILTER (WHERE status = 'N/A') AS n_na FROM st GROUP BY ALL""",
        "score_contributions": f"{DAILY} " + " UNION ALL ".join(f"SELECT entity, day, '{g}' AS criterion, '{m}' AS metric, round({m}, 6) AS value, round(CAST({mu} AS DOUBLE), 6) AS mu, round(CAST({w} * ({mu}) AS DOUBLE), 6) AS contribution FROM d" for m, (g, w, mu) in MU.items()),
        "group_scores": f"{DAILY}, {SCORES} SELECT entity, day, round(L_C1, 6) AS L_C1, round(L_C2, 6) AS L_C2 FROM sc",
        "presence_flags": f"{DAILY}, {SCORES}, {GATED} SELECT * FROM fl",
        "latest_presence": f"{DAILY}, {SCORES}, {GATED} SELECT entity, day, present_C1, present_C2, n_present, flag FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS rn FROM fl) WHERE rn = 1",
        "top_groups": f"{DAILY}, {SCORES} SELECT 'C1' AS Code, round(avg(L_C1), 6) AS mean_score FROM sc UNION ALL SELECT 'C2', round(avg(L_C2), 6) FROM sc",
        "long_scores": f"{DAILY}, {SCORES} SELECT entity, day, 'C1' AS Code, 'Group 1' AS Display, round(L_C1, 6) AS Likelihood FROM sc UNION ALL SELECT entity, day, 'C2', 'Group 2', round(L_C2, 6) FROM sc",
        "tuned_weights": f"""{DAILY}, {LONG}, p AS (SELECT entity, metric, count(value) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, coalesce(greatest(0, quantile_cont(value, 0.9) - quantile_cont(value, 0.1)), 0) AS spread, var_pop(value) AS variance FROM lg GROUP BY ALL)
SELECT entity, metric, n, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, round(spread, 6) AS spread, round(variance, 6) AS variance, round(CASE WHEN sum(spread) OVER (PARTITION BY entity) > 0 THEN spread / sum(spread) OVER (PARTITION BY entity) ELSE 1.0 / count(*) OVER (PARTITION BY entity) END, 6) AS w FROM p""",
        "packets_per_minute": f"""{_rows()}, c AS (SELECT "Dataset", "Date", minute % 1440 AS m, count(*) AS n, sum(bytes) AS b FROM r GROUP BY ALL)
SELECT z."Dataset", z."Date", CAST(i AS INTEGER) AS minute_of_day, coalesce(n, 0) AS packets, CAST(coalesce(b, 0) AS BIGINT) AS bytes FROM {cells('"Dataset", "Date"', 1440)} LEFT JOIN c ON c."Dataset" = z."Dataset" AND c."Date" = z."Date" AND c.m = i""",
        "packets_per_week_minute": f"""{_rows()}, rw AS (SELECT *, {MONDAY} AS WeekStart FROM r), c AS (SELECT "Dataset", WeekStart, (isodow("Date") - 1) * 1440 + minute % 1440 AS m, count(*) AS n, sum(bytes) AS b FROM rw GROUP BY ALL)
SELECT z."Dataset", z.WeekStart, CAST(i AS INTEGER) AS minute_of_week, coalesce(n, 0) AS packets, CAST(coalesce(b, 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT "Dataset", WeekStart FROM rw) z CROSS JOIN range(10080) u(i) LEFT JOIN c ON c."Dataset" = z."Dataset" AND c.WeekStart = z.WeekStart AND c.m = i""",
        "protocol_mix": f'{_rows()} SELECT "Date", minute, protocol, count(*) AS packets FROM r GROUP BY ALL',
        "hourly_heatmap": f'{_rows()} SELECT "Date", {hours} FROM r GROUP BY ALL',
        "weekday_heatmap": f"{_rows()} SELECT {_weekday('\"Date\"')} AS weekday, {hours} FROM r GROUP BY ALL",
        "packets_by_group": f'{PACKETS} SELECT "Dataset", count(us) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM pk GROUP BY ALL',
        "metric_by_weekday": f"{DAILY} SELECT {_weekday('day')} AS weekday, round(sum(m2), 6) AS total FROM d GROUP BY ALL",
        "metric_week_by_weekday": f"{DAILY} SELECT CAST(day - CAST(isodow(day) - 1 AS INTEGER) AS DATE) AS WeekStart, {', '.join(f'round(sum(m1) FILTER (WHERE isodow(day) = {i + 1}), 6) AS {n}' for i, n in enumerate(DAYS))} FROM d GROUP BY ALL",
        "metric_distribution": f"{DAILY}, {LONG} SELECT metric, count(value) AS n, round(min(value), 6) AS least, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS greatest FROM lg GROUP BY metric HAVING count(value) > 0",
        "productivity_domains": f"{_rows()} SELECT SLD, count(*) AS hits FROM r WHERE productivity AND SLD IS NOT NULL GROUP BY SLD",
        "chat_session_list": f"{_rows()}, {_sessions()} SELECT \"Date\", a AS first_us, b AS last_us, round(s, 6) AS seconds FROM w WHERE mask = 'chat' ORDER BY a, \"Date\" LIMIT 20",
        "diet_bursts": f'{_rows(True)} SELECT "Date", SLD, us // 600000000 AS bin, count(*) AS n FROM r WHERE diet GROUP BY ALL HAVING count(*) >= 3',
        "cloud_providers": f'{_rows()} SELECT "Date", SLD, CAST(sum(bytes) AS BIGINT) AS up_bytes FROM r WHERE cloud AND outbound GROUP BY ALL',
        "normalised_packets": f"""{PACKETS} SELECT "Date", CAST(us // 3600000000 % 24 AS INTEGER) AS "Hour", protocol AS "Protocol", CASE WHEN protocol = 'TCP' THEN 'S' END AS flags, is_dns AS "IsDNS", qname AS "DNS_QNAME", CASE WHEN qname IS NOT NULL THEN 1 END AS "DNS_QTYPE",
  ans_name AS "DNS_ANS_NAME", replace(ans_ips, ', ', ',') AS "DNS_ANS_IPS", count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM pk GROUP BY ALL""",
        "packets_in_range": f"""{PACKETS}, t AS (SELECT *, CASE WHEN tie % 3 <> 0 THEN us ELSE us // 3600000000 * 3600000000 END AS own FROM pk WHERE us >= epoch_us(TIMESTAMP '2024-01-05 06:00:00') AND us < epoch_us(TIMESTAMP '2024-01-16 00:00:00') AND "Dataset" IN ('lab_03', 'onu_capture_home_1'))
SELECT "Dataset", "Date", CAST(own // 3600000000 % 24 AS INTEGER) AS "Hour", count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM t GROUP BY ALL""",
        "auto_tuned": tuned(),
        "tolerated_files": f'{PACKETS} SELECT "Dataset", "Date", count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM pk GROUP BY ALL',
        "rebuilt_days": f"""{PACKETS} SELECT "Date", count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, CASE WHEN "Date" >= DATE '2024-01-25' OR day("Date") % 7 = 0 THEN 2 ELSE 1 END AS built FROM pk GROUP BY "Date\"""",
        "daily_round_trip": f"{DAILY} SELECT entity, day, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3, round(m4, 6) AS m4 FROM d",
        "exported_addresses": f"""{PACKETS}, b AS ({BOTH}) SELECT ip, count(*) AS packets, coalesce(bool_or("Dataset" = 'lab_03'), false) AS known FROM b GROUP BY ip""",
        "metric_variation": f"{DAILY}, {LONG} SELECT entity, metric, CASE WHEN count(value) >= 2 AND avg(value) > 0 THEN round(stddev_samp(value) / avg(value), 6) END AS variation FROM lg GROUP BY ALL",
        "reply_gaps": f"""{_rows(True)}, x AS (SELECT "Date", us, outbound, us - lag(us) OVER w AS d, lag(inbound) OVER w AS pi FROM r WHERE chat AND src IS NOT NULL AND dst IS NOT NULL WINDOW w AS (PARTITION BY "Date" ORDER BY us, tie))
SELECT "Date", us, round(d / 1000000.0, 6) AS seconds FROM x WHERE pi AND outbound AND d // 1000000 > 0 AND d // 1000000 <= 120""",
        "typing_gaps": f"""{_rows(True)}, x AS (SELECT "Date", us, us - lag(us) OVER (PARTITION BY "Date" ORDER BY us, tie) AS d FROM r WHERE chat AND outbound) SELECT "Date", us, round(d / 1000000.0, 6) AS seconds FROM x WHERE d > 0 AND d <= 3000000""",
        "scale_events": f'{_rows()} SELECT "Date", us, SLD, bytes FROM r WHERE scale AND outbound',
        "compacted_packets": f"""{PACKETS} SELECT "Dataset", "Date", count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, count(DISTINCT us // 300000000) AS slots, "Date" < DATE '2024-01-15' AS few_files FROM pk
WHERE "Date" BETWEEN DATE '2024-01-10' AND DATE '2024-01-19' GROUP BY ALL""",
        "slots_from_names": f"{PACKETS} SELECT CASE WHEN tie % 10 <> 0 THEN us // 60000000 * 60000000 END AS slot_us, count(*) AS files FROM pk GROUP BY ALL",
        "day_fingerprints": f"{PACKETS}, {FILES} SELECT * FROM fp",
        "days_to_rebuild": f"{PACKETS}, {FILES} SELECT \"Date\" FROM fp WHERE \"Date\" < DATE '2024-01-04' OR day(\"Date\") % 7 = 0",
        "ingest_report": f'{PACKETS} SELECT "Dataset", count(DISTINCT us // 300000000) AS slots, count(*) AS rows, min(us) AS first_us, max(us) AS last_us FROM pk GROUP BY "Dataset"',
        "history_metrics": f"""WITH z AS ({DAILY}, {_history('m3', 30, 'count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd', 'CASE WHEN n >= 7 AND sd > 0 THEN round(abs((m3 - m) / sd), 6) END AS z')}),
c AS (WITH d AS (SELECT *, CASE WHEN m3 IS NOT NULL THEN m2 * 37 % 1440 END AS clock FROM ({DAILY_SQL})), {_history('clock', 14, _circular('v') + ' AS sd', 'round(sd, 6) AS spread')}), m AS ({DELTA})
SELECT entity, day, spread AS C4_F3_OnsetVar14dMin, z AS C4_F4_SleepDurationZAbs30d, delta AS C6_F9_ActivationDelayVsBase28d FROM z JOIN c USING (entity, day) JOIN m USING (entity, day)""",
        "value_references": f"SELECT d.entity, d.day, m1 AS today, CAST(2.5 AS DOUBLE) AS constant, CAST(7 AS DOUBLE) AS aux, round(m2, 6) AS column, delta, CAST(NULL AS DOUBLE) AS unknown FROM ({DAILY_SQL}) d JOIN ({DELTA}) m ON d.entity = m.entity AND d.day = m.day",
        "cached_or_computed": f"{DAILY} SELECT entity, day, round(coalesce(CASE WHEN day(day) > 10 THEN m3 END, m4 / m1), 6) AS m3 FROM d",
        "membership_distribution": f"{DAILY}, mu AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({mu} AS DOUBLE) AS value FROM d" for m, (_, _, mu) in MU.items()) + ") SELECT metric, count(value) AS n, round(min(value), 6) AS least, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS greatest FROM mu GROUP BY metric",
        "streamed_slot_counts": f'{PACKETS}, s AS (SELECT "Dataset", us // 300000000 * 300000000 AS slot_us, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM pk GROUP BY ALL) SELECT * FROM s WHERE slot_us + 300000000 <= (SELECT max(slot_us) FROM s) - 600000000',
        "corrected_slot_counts": f'{PACKETS} SELECT "Dataset", us // 300000000 * 300000000 AS slot_us, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM pk GROUP BY ALL',
        "streamed_addresses": f"{PACKETS}, b AS ({BOTH}) SELECT DISTINCT ip FROM b",
        "streamed_sessions": f"""{PACKETS}, x AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY "Dataset" ORDER BY us, tie) > 300000000 THEN 1 ELSE 0 END AS new FROM pk), y AS (SELECT *, sum(new) OVER (PARTITION BY "Dataset" ORDER BY us, tie) AS sn FROM x)
SELECT "Dataset", min(us) AS first_us, max(us) AS last_us, count(*) AS packets FROM y GROUP BY "Dataset", sn HAVING max(us) + 300000000 <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM pk)""",
        "streamed_minutes": f"""{PACKETS}, s AS (SELECT "Dataset", min(us // 60000000) AS lo FROM pk GROUP BY ALL), m AS (SELECT "Dataset", unnest(range(lo, (SELECT (max(us) // 1000 - 600000) // 60000 FROM pk))) AS minute FROM s),
c AS (SELECT "Dataset", us // 60000000 AS minute, count(*) AS n, sum(length) AS b FROM pk GROUP BY ALL)
SELECT m."Dataset", m.minute, coalesce(n, 0) AS packets, CAST(coalesce(b, 0) AS BIGINT) AS bytes FROM m LEFT JOIN c ON m."Dataset" = c."Dataset" AND m.minute = c.minute""",
        "ingested_slot_counts": f'{PACKETS} SELECT "Dataset", us // 300000000 * 300000000 AS slot_us, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM pk GROUP BY ALL',
    }
