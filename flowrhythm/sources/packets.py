"""Packet rows: schema, normalisation, slots of five minutes, tables of days, users."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrhythm.functions.network import micros
from flowrhythm.sources.scratch import written

#: The packet schema. The columns after DNS_ANS_IPS are optional.
SCHEMA = """Timestamp timestamp_ntz, Date date, Hour int, Protocol string, `Source IP` string, `Destination IP` string, `Source Port` int, `Destination Port` int,
`TCP Flags` string, Length bigint, IsDNS boolean, DNS_QNAME string, DNS_QTYPE int, DNS_ANS_NAME string, DNS_ANS_IPS string, URL string, HTTP_Path string, Path string, FlowDurationSec double"""
#: Names used by the operators.
SHORT = {
    "Source IP": "src", "Destination IP": "dst", "Source Port": "sport", "Destination Port": "dport", "TCP Flags": "flags", "Length": "length", "Protocol": "protocol", "IsDNS": "is_dns",
    "DNS_QNAME": "qname", "DNS_QTYPE": "qtype", "DNS_ANS_NAME": "ans_name", "DNS_ANS_IPS": "ans_ips", "URL": "url", "HTTP_Path": "http_path", "Path": "path", "FlowDurationSec": "flow_sec",
}
TYPES = {"src": "string", "dst": "string", "sport": "int", "dport": "int", "length": "bigint", "protocol": "string", "is_dns": "boolean", "qname": "string", "ans_name": "string", "url": "string", "http_path": "string", "path": "string", "flow_sec": "double"}
SLOT_MINUTES = 5


def normalise(decoded: DataFrame, dataset: str | None = None) -> DataFrame:
    """Decoded records to packet rows: protocol by port layer, trimmed query name, joined answers, date and hour.

    decoded: ts, ip_src, ip_dst, has_tcp, has_udp, sport, dport, flags, length, has_dns, dns_qr, qname,
    qtype, answers array<struct<name, rdata>>. Only queries (dns_qr 0) have a query name, only rows with
    answers an answer name.
    """
    query = F.coalesce(F.col("has_dns") & (F.col("dns_qr") == 0), F.lit(False))
    answered = F.col("has_dns") & (F.size("answers") > 0)
    out = decoded.select(
        F.col("ts").cast("timestamp_ntz").alias("Timestamp"), F.to_date("ts").alias("Date"), F.hour("ts").alias("Hour"),
        F.when(F.col("has_tcp"), "TCP").when(F.col("has_udp"), "UDP").otherwise("OTHER").alias("Protocol"),
        F.col("ip_src").alias("Source IP"), F.col("ip_dst").alias("Destination IP"), F.col("sport").cast("int").alias("Source Port"), F.col("dport").cast("int").alias("Destination Port"),
        F.when(F.col("has_tcp"), F.col("flags")).alias("TCP Flags"), F.col("length").cast("bigint").alias("Length"), F.coalesce("has_dns", F.lit(False)).alias("IsDNS"),
        F.when(query, F.rtrim(F.col("qname"), F.lit("."))).alias("DNS_QNAME"), F.when(query, F.col("qtype")).cast("int").alias("DNS_QTYPE"),
        F.when(answered, F.rtrim(F.try_element_at("answers", F.lit(1))["name"], F.lit("."))).alias("DNS_ANS_NAME"),
        F.when(answered, F.array_join(F.transform("answers", lambda a: a["rdata"].cast("string")), ",")).alias("DNS_ANS_IPS"),
    )
    return out.withColumn("Dataset", F.lit(dataset)) if dataset else out


def with_time(df: DataFrame) -> DataFrame:
    """A timestamp in every row: its own, else the date and hour; Date and Hour follow it. What can't be read is null."""
    own = F.expr("try_cast(Timestamp AS timestamp_ntz)") if "Timestamp" in df.columns else F.lit(None).cast("timestamp_ntz")
    if {"Date", "Hour"} <= {*df.columns}:
        own = F.coalesce(own, F.expr("CAST(try_cast(Date AS date) AS timestamp_ntz) + make_dt_interval(0, try_cast(Hour AS int))"))
    return df.withColumn("Timestamp", own).withColumns({"Date": F.to_date("Timestamp"), "Hour": F.hour("Timestamp")})


def standard(df: DataFrame) -> DataFrame:
    """Packet rows under short names, with absent columns as nulls; `present` lists the columns there were."""
    rows = df.select(*(F.col(f"`{c}`").alias(SHORT.get(c, c)) for c in df.columns))
    have = [c for c in SHORT.values() if c in rows.columns]
    for c, kind in TYPES.items():
        rows = rows.withColumn(c, F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind))
    if "ans_ips" not in rows.columns:
        rows = rows.withColumn("ans_ips", F.lit(None).cast("string"))
    if "tie" not in rows.columns:
        rows = rows.withColumn("tie", F.xxhash64(*[c for c in rows.columns if c != "ans_ips"]))
    return rows.withColumns({"us": micros(), "present": F.array(*map(F.lit, have)) if have else F.array().cast("array<string>")})


def slot(ts: str = "Timestamp", minutes: int = SLOT_MINUTES) -> Column:
    """The start of the slot of a row."""
    return F.window(ts, f"{minutes} minutes")["start"]


#: Rows of a packet file, on average; files of a day below which it is left as it is.
FILE_ROWS, FEW_FILES = 2_000_000, 2


def _in_files(rows: DataFrame, n: int, file_rows: int) -> DataFrame:
    """rows in ranges of even size by dataset and time, each in order: a file of one dataset holds a stretch of time of its own."""
    order = ["Dataset", "Date", "Timestamp"]
    return rows.repartitionByRange(max(1, math.ceil(n / file_rows)), *order).sortWithinPartitions(*order)


def write_slots(packets: DataFrame, path: str, mode: str = "append", file_rows: int = FILE_ROWS) -> None:
    """Packets by dataset and day, a slot being a column. Files hold even stretches of time, however many rows an hour has; rows are counted first."""
    rows = packets.withColumn("slot_start", slot())
    _in_files(rows, packets.count(), file_rows).write.mode(mode).partitionBy("Dataset", "Date").parquet(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(Dataset, Date, name, size, mtime) of the files below a packet folder; no data is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("Dataset").cast("string").alias("Dataset"), F.col("Date").cast("date").alias("Date"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))


def scattered_days(spark: SparkSession, path: str, before: str, few: int = FEW_FILES, file_bytes: int = 64 << 20) -> DataFrame:
    """(Dataset, Date) of closed days, those before a date, in more files than their bytes need."""
    by_day = list_files(spark, path).where(F.col("Date") < F.to_date(F.lit(before))).groupBy("Dataset", "Date").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return by_day.where((F.col("files") > few) & (F.col("files") > 2 * F.ceil(F.col("bytes") / file_bytes))).select("Dataset", "Date")


def compact(spark: SparkSession, path: str, days: DataFrame, file_rows: int = FILE_ROWS) -> None:
    """Rewrite these (Dataset, Date) in even, ordered files; the folders of other days are not touched.

    The rows are written to the shared folder first, and take the place of the old files once all are there.
    Days must be closed: rows that are added meanwhile are lost.
    """
    rows = spark.read.schema(spark.read.option("mergeSchema", "true").parquet(path).schema).parquet(path)
    aside = written(rows.join(days.select("Dataset", "Date").distinct(), ["Dataset", "Date"], "left_semi"), "compacted")
    _in_files(aside, aside.count(), file_rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("Dataset", "Date").parquet(path)


def slot_of_file(name: Column) -> Column:
    """The start of a slot from a file name that ends in __YYYYMMDD_HHMM.parquet, else null."""
    found = F.regexp_extract(name, r"__(\d{8}_\d{4})\.parquet$", 1)
    return F.try_to_timestamp(F.when(found != "", found), F.lit("yyyyMMdd_HHmm")).cast("timestamp_ntz")


def list_slots(spark: SparkSession, path: str) -> DataFrame:
    """(file, slot_start) of the files of a dataset whose name tells a slot; no data is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.withColumn("slot_start", slot_of_file(F.col("file"))).where("slot_start is not null")


def read_range(spark: SparkSession, path: str, start: str, stop: str, datasets: list[str] | None = None, tolerant: bool = True, schema: str | None = None) -> DataFrame:
    """Packets of [start, stop): partitions by date first, then rows. Unreadable and missing files are passed over if tolerant.

    With a schema, such as SCHEMA with Dataset, columns that a file lacks are null; without one the schemas of all files are
    merged, for which each is opened before the read.
    """
    reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(schema)
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    rows = reader.parquet(path)
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz")
    rows = rows.where(F.col("Date").between(F.to_date(first), F.to_date(last)))
    if rows.schema["Timestamp"].dataType.typeName().startswith("timestamp") if "Timestamp" in rows.columns else False:
        rows = rows.where(F.col("Timestamp").isNull() | ((F.col("Timestamp") >= first) & (F.col("Timestamp") < last)))  # as the files have it, so that row groups are passed over
    if datasets is not None:
        rows = rows.where(F.col("Dataset").isin(*datasets) if datasets else F.lit(False))
    return with_time(rows).where((F.col("Timestamp") >= first) & (F.col("Timestamp") < last))


def read_day(spark: SparkSession, path: str, day: str, datasets: list[str] | None = None) -> DataFrame:
    return read_range(spark, path, day, str(date.fromisoformat(day) + timedelta(days=1)), datasets)


def selection_key(datasets: list[str]) -> str:
    """The name under which the daily table of a selection of datasets is kept."""
    import hashlib

    return hashlib.md5("|".join(sorted(datasets)).encode()).hexdigest()


def write_daily(daily: DataFrame, folder: str, datasets: list[str], format: str = "parquet") -> str:
    path = f"{folder}/features_{selection_key(datasets)}.{format}"
    writer = daily.write.mode("overwrite")
    (writer.option("header", "true") if format == "csv" else writer).format(format).save(path)
    return path


def read_daily(spark: SparkSession, folder: str, datasets: list[str], format: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(format)
    reader = reader.option("header", "true") if format == "csv" else reader
    return (reader.schema(schema) if schema else reader).load(f"{folder}/features_{selection_key(datasets)}.{format}")


def fingerprints(files: DataFrame, day: str = "Date") -> DataFrame:
    """(Date, Fingerprint): md5 of the sorted name|size|mtime of a day's files. files: Date, name, size, mtime."""
    each = F.concat_ws("|", "name", F.col("size").cast("string"), F.col("mtime").cast("string"))
    return files.groupBy(day).agg(F.md5(F.array_join(F.array_sort(F.collect_set(each)), "|")).alias("Fingerprint"))


def file_table(packets: DataFrame) -> DataFrame:
    """Date, name, size and mtime of the files that a parquet read of packets consists of; `list_files` lists a folder without reading it."""
    m = F.col("_metadata")
    return packets.select("Date", m["file_name"].alias("name"), m["file_size"].alias("size"), m["file_modification_time"].cast("long").alias("mtime")).distinct()


def stale_days(current: DataFrame, cached: DataFrame, keys: tuple[str, ...] = ("Date",)) -> DataFrame:
    """Days to build: those of current (keys, Fingerprint) that cached lacks or has with another fingerprint."""
    return current.join(cached.select(*keys, "Fingerprint").distinct(), [*keys, "Fingerprint"], "left_anti")


def rebuilt(cached: DataFrame, fresh: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("Date",)) -> DataFrame:
    """The cached rows that are still right, and the fresh ones."""
    kept = cached.join(current.select(*keys, "Fingerprint"), [*keys, "Fingerprint"], "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True)


def rebuild_daily(path: str, current: DataFrame, cached: DataFrame | None, build: Callable[[DataFrame], DataFrame], day: str = "Date") -> None:
    """Write the daily table below path, partitioned by day, where it is missing or out of date; other days' files stay.

    current: (Date, Fingerprint) of the days there are. cached: the table at path, None if there is none yet.
    build gives the rows of the days it is handed, which get their fingerprints. A day that is built again
    replaces its partition alone.
    """
    stale = current if cached is None else stale_days(current, cached, (day,))
    fresh = build(stale.select(day)).drop("Fingerprint").join(stale, day)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """(username, ip, place) of a JSON table of profiles with ip_addresses; place orders the profiles."""
    users = spark.read.option("multiLine", "true").schema("username string, ip_addresses array<string>").json(path)
    return explode_users(users)


def explode_users(users: DataFrame) -> DataFrame:
    return users.withColumn("place", F.monotonically_increasing_id()).select("username", F.explode("ip_addresses").alias("ip"), "place").withColumn("ip", F.trim("ip")).where("ip <> ''")


def read_known_ips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("ip")).where("ip <> ''").distinct()
