"""Packet and daily views over the test tables: the same expressions in Spark SQL and in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Host names and paths of the view: two of each category, a name of three labels, one of one label, and neutral ones.
HOSTS = (
    "www.facebook.com", "m.reddit.com", "cdn.netflix.com", "www.youtube.com", "app.notion.so", "www.github.com", "www.ubereats.com", "api.wolt.com", "www.fitbit.com", "sync.yazio.com", "up.withings.com", "connect.garmin.com",
    "www.mind.org.uk", "www.psy.ch", "www.samaritans.org", "www.143.ch", "www.therapie.de", "www.doctolib.de", "www.dropbox.com", "box.com", "drive.google.com", "localhost", "news.example.org", "static.example.net",
)
PATHS = ("/", "/q=am+i+worthless", "/q=suicide+methods", "/r/selfharm/new", "/delete-account", "/settings/a", "/insurance/plan.pdf", "/privacy", "/index.html", "/unsubscribe?id=1", "/watch", "/q=weather")


def _case(values: tuple[str, ...], on: str) -> str:
    return f"CASE {on} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def packet_sql(dense: bool = False, dialect: str = "spark") -> str:
    """Packets from events, under the short names of the operators."""
    if dialect == "spark":
        k, us = "CAST(get_json_object(props, '$.k') AS INT)", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
        date = "CAST(date_add(DATE'1970-01-01', CAST(floor(us / 86400000000) AS INT)) AS DATE)"
        text = "CAST({} AS STRING)"
    else:
        k, us = "CAST(json_extract_string(props, '$.k') AS INTEGER)", "epoch_us(ts)"
        date = "CAST(DATE '1970-01-01' + CAST(us // 86400000000 AS INTEGER) AS DATE)"
        text = "CAST({} AS VARCHAR)"
    start = 1704067200000000
    time = f"CAST({start} + floor(({us} - {start}) / 10) AS BIGINT)" if dense else us
    h, u, kk = "((k + u) % 24)", text.format("(u % 4)"), text.format("(u % 250 + 1)")
    ob, ib, lo = "t IN ('click', 'purchase', 'signup')", "t = 'view'", "t = 'error'"
    private, public = f"('192.168.' || {u} || '.' || {kk})", f"('93.184.216.' || {text.format(h)})"
    host = _case(HOSTS, h)
    return f"""
WITH e AS (SELECT event_id, {k} AS k, user_id AS u, event_type AS t, value AS v, {time} AS us FROM events WHERE ts IS NOT NULL)
SELECT us, event_id AS tie, {date} AS {'`Date`' if dialect == 'spark' else '"Date"'},
  CASE u % 3 WHEN 0 THEN 'onu_capture_home_1' WHEN 1 THEN 'bras_capture_edge-2' ELSE 'lab_03' END AS {'`Dataset`' if dialect == 'spark' else '"Dataset"'},
  CASE WHEN {lo} OR k % 7 = 0 THEN 'UDP' WHEN k % 11 = 0 THEN 'OTHER' ELSE 'TCP' END AS protocol,
  CASE WHEN {ib} THEN {public} ELSE {private} END AS src,
  CASE WHEN {ob} THEN {public} WHEN {ib} THEN {private} WHEN k % 3 = 0 THEN '255.255.255.255' ELSE '192.168.0.254' END AS dst,
  CASE WHEN {ib} THEN 443 WHEN {lo} AND k % 3 = 0 THEN 68 ELSE 40000 + k END AS sport,
  CASE WHEN {lo} AND k % 3 = 0 THEN 67 WHEN {lo} THEN 53 WHEN {ib} THEN 40000 + k WHEN k % 5 = 0 THEN 443 WHEN k % 5 = 1 THEN 5222 ELSE 80 END AS dport,
  60 + CAST(floor(v * 10) AS BIGINT) AS length, ({lo} AND k % 3 <> 0) AS is_dns,
  CASE WHEN {lo} AND k % 3 = 1 THEN {host} END AS qname, CASE WHEN {lo} AND k % 3 = 2 THEN {host} END AS ans_name,
  CASE WHEN {lo} AND k % 3 = 2 THEN '93.184.216.' || {text.format(h)} || ', 93.184.217.' || {text.format(h)} END AS ans_ips,
  CASE WHEN {ob} THEN 'https://' || {host} || {_case(PATHS, '(k % 12)')} END AS url, CASE WHEN {ob} THEN v END AS flow_sec, u AS user_id
FROM e"""


PRESENT = ("src", "dst", "sport", "dport", "length", "protocol", "is_dns", "qname", "ans_name", "url", "flow_sec")


def packets(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """The packet view in the form that `enrich` takes."""
    rows = spark.sql(packet_sql(dense).replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.withColumns({"http_path": F.lit(None).cast("string"), "path": F.lit(None).cast("string"), "present": F.array(*map(F.lit, PRESENT)), "Timestamp": F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(us / 1000000 AS DECIMAL(20, 6)))")})


DAILY_SQL = """
SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS m1, CAST(sum(l_quantity) AS DOUBLE) AS m2,
  CASE WHEN count(*) % 2 = 1 AND sum(l_quantity) < 20 THEN NULL ELSE CAST(avg(l_discount) AS DOUBLE) END AS m3,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS m4
FROM lineitem WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY l_suppkey, CAST(l_shipdate AS DATE)"""


#: Rows of the table that one task takes.
ROWS = 100_000


def daily_view(spark: SparkSession, sf_dir: str, by_entity: bool = False) -> DataFrame:
    """The daily view; tasks grow in number with the table and not in size.

    Rows are dealt by entity and day, or by entity alone for what then looks along its days, and
    each day's sums are taken in the order of the files, so that doubles come out the same however the table is split.
    """
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = rows.select("l_suppkey", F.col("l_shipdate").cast("date").alias("l_shipdate"), "l_quantity", "l_discount", "l_returnflag", *place).where("l_suppkey is not null and l_shipdate is not null")
    keys = ["l_suppkey"] if by_entity else ["l_suppkey", "l_shipdate"]
    rows = rows.repartition(parts, *keys).sortWithinPartitions("l_suppkey", "l_shipdate", "file", "row")
    return spark.sql(DAILY_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=rows)
