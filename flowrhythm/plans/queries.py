"""The registered queries of the library, each with its SQL.

All read the test tables through the packet view over events or the daily view over
lineitem, whole. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrhythm.functions import network as N
from flowrhythm.operators import baseline, catalog, overview, score, status, tune
from flowrhythm.operators.enrich import enrich
from flowrhythm.operators.series import minute_measures, minutes
from flowrhythm.operators.sessions import seconds, sessions
from flowrhythm.plans import daily as D
from flowrhythm.plans import metrics as M
from flowrhythm.plans.registry import with_precedence, with_value
from flowrhythm.sources import packets as S
from flowrhythm.sources.scratch import shared_folder, written
from flowrhythm.sources.views import daily_view, packets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = ("Date",)
BY_DATASET = ("Dataset", "Date")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rows_of(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    return enrich(packets(spark, sf_dir, dense), KEY)


def _without_helpers(df: DataFrame) -> DataFrame:
    return rounded(df.drop(*[c for c in df.columns if c.startswith("__")]))


@query
def headline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.headline(packets(spark, sf_dir))


@query
def daily_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_helpers(M.counters(rows_of(spark, sf_dir), KEY))


@query
def daily_counters_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.counters(rows_of(spark, sf_dir), BY_DATASET)
    return rounded(found.select(*BY_DATASET, "n_total_packets_today", "down_bytes_today", "up_bytes_today", "LateNightShare", "F4_DownUpRatio", "C5_F1_DhcpPerHour", "C6_F8_FirstActivityMin"))


@query
def daily_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.distinct_counts(rows_of(spark, sf_dir), KEY))


@query
def daily_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.bins(rows_of(spark, sf_dir, True), KEY))


@query
def daily_minute_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(minute_measures(minutes(rows_of(spark, sf_dir), KEY), KEY))


@query
def daily_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.session_metrics(M.session_table(rows_of(spark, sf_dir), KEY), KEY)
    return rounded(found.withColumnsRenamed({"__rate": "C2_F4_MeanUpstreamRateBps", "__micro": "C8_F3_NotificationMicroSessionsCount"}))


@query
def daily_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.gap_metrics(rows_of(spark, sf_dir), KEY))


@query
def daily_gaps_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.gap_metrics(rows_of(spark, sf_dir, True), KEY))


@query
def daily_from_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of each day from slot states: most slots first, then the late ones, each of which is reduced once."""
    from flowrhythm.plans.states import SlotStates, slot_number

    p = packets(spark, sf_dir)
    states = SlotStates(spark, shared_folder(spark, "states"))
    late = F.pmod(slot_number(), F.lit(17)) == 3
    for rows, which in ((p.where(~late | (F.col("tie") % 2 == 0)), ~late | (F.col("tie") % 2 == 0)), (p, late)):
        states.update(rows.where(which).select("Date", slot_number().alias("slot")), lambda slots, rows=rows: rows)
    return rounded(states.daily())


@query
def daily_all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of every dataset and day, in one frame with its history (the parts have the SQL)."""
    return rounded(D.daily_table(packets(spark, sf_dir), BY_DATASET))


@query
def all_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.statuses(D.daily_table(packets(spark, sf_dir))))


@query
def dns_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowrhythm.operators.enrich import dns_map

    return dns_map(packets(spark, sf_dir), KEY)


@query
def enriched_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ("outbound", "inbound", "chat", "streaming", "dhcp", "social", "food", "diet", "scale", "mental_health", "crisis", "productivity", "cloud", "forum")
    return rows_of(spark, sf_dir).groupBy("Date", "SLD").agg(F.count("*").alias("n"), *(F.count_if(f).alias(f"n_{f}") for f in flags))


@query
def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(rows_of(spark, sf_dir), BY_DATASET, 300, {"packets": F.lit(1), "bytes": F.col("bytes")})
    return found.select(*BY_DATASET, "first_us", "last_us", "packets", "bytes", F.round(seconds(), 6).alias("seconds"))


@query
def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.datasets(packets(spark, sf_dir))


@query
def dataset_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.select_datasets(catalog.datasets(packets(spark, sf_dir)), ("ONU",), ("home",), ("lab_03",))


@query
def slots_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.slots_per_day(packets(spark, sf_dir))


@query
def slot_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.calendar(catalog.slots_per_day(packets(spark, sf_dir)))


@query
def week_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.week_starts(packets(spark, sf_dir))


@query
def row_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_labels(packets(spark, sf_dir)).groupBy("Label", "Scope", "WeekStart").agg(F.count("*").alias("packets"))


@query
def new_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    return catalog.new_addresses(p, catalog.addresses(p.where(F.col("Dataset") == "lab_03")))


@query
def merged_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    return catalog.merged_addresses(p.where(F.col("Dataset") == "lab_03"), catalog.addresses(p.where(F.col("Dataset") != "lab_03")))


@query
def addresses_in_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = packets(spark, sf_dir).select(F.concat_ws(" to ", "src", "dst").alias("value"))
    return catalog.addresses_in_text(lines)


@query
def packets_per_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.packets_per_address(packets(spark, sf_dir))


def _users(p: DataFrame) -> DataFrame:
    who = p.where(F.col("src").startswith("192.168.")).select(F.col("user_id").alias("place"), F.concat(F.lit("user_"), (F.col("user_id") % 20).cast("string")).alias("username"), F.col("src").alias("ip"))
    return who.distinct()


@query
def packets_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    return catalog.with_user(p, _users(p)).groupBy("User").agg(F.count("*").alias("packets"))


@query
def touching_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    busy = catalog.packets_per_address(p).where("packets >= 100")
    return catalog.touching(p, busy).groupBy("Date").agg(F.count("*").alias("packets"))


@query
def enriched_hot_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched rows, nine of ten packets having one of two destinations, with the user of their source."""
    p = packets(spark, sf_dir)
    p = p.withColumn("dst", F.when(F.col("tie") % 10 != 0, F.when(F.col("tie") % 2 == 0, "93.184.216.3").otherwise("93.184.216.200")).otherwise(F.col("dst")))
    found = catalog.with_user(enrich(p, KEY, skewed=True), _users(packets(spark, sf_dir)), skewed=True)
    return found.groupBy("Date", "SLD", "User").agg(F.count("*").alias("packets"), F.count_if("outbound").alias("n_out"))


@query
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.preview(packets(spark, sf_dir), ["tie", "Date", "src", "dst", "protocol", "length"], 100)


@query
def delta_from_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = baseline.delta_from_median(daily_view(spark, sf_dir), "m2", ("entity",), "day", 28)
    return rounded(found.select("entity", "day", "delta"))


@query
def absolute_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline.absolute_z(daily_view(spark, sf_dir), "m3", ("entity",), "day").select("entity", "day", "abs_z"))


@query
def circular_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_view(spark, sf_dir).withColumn("clock", F.when(F.col("m3").isNotNull(), F.pmod(F.col("m2") * 37, F.lit(1440.0))))
    return rounded(baseline.circular_spread(d, "clock", ("entity",), "day").select("entity", "day", "spread"))


def _catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A", "m1", 1.0, True), ("A", "m2", 20.0, False), ("B", "m3", 0.05, True), ("B", "m4", 0.0, True)], "group string, metric string, ok double, higher_is_worse boolean")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.melt(daily_view(spark, sf_dir), ("entity", "day"), ["m1", "m2", "m3", "m4"])


@query
def metric_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = spark.createDataFrame([("m2", 25.0, None), ("m4", None, False)], "metric string, ok double, higher_is_worse boolean")
    return rounded(status.with_status(_long(spark, sf_dir), _catalog(spark), over).select("entity", "day", "metric", "value", "status"))


@query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.status_counts(status.with_status(_long(spark, sf_dir), _catalog(spark)), ("day",))


def _spec(spark: SparkSession) -> DataFrame:
    inf = float("inf")
    return spark.createDataFrame([("C1", "m1", 0.5, "tri", 0.0, 1.0, 3.0, False), ("C1", "m3", 0.6, "clip", 0.0, 0.0, 0.0, False), ("C2", "m2", 0.7, "tri", 10.0, 40.0, inf, True), ("C2", "m4", 0.3, "tri", -inf, 0.0, 2.0, False)], score.SPEC)


@query
def score_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.contributions(daily_view(spark, sf_dir), _spec(spark), ("entity", "day")))


GROUPS = ("C1", "C2")


@query
def group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.group_scores(daily_view(spark, sf_dir), _spec(spark), ("entity", "day"), GROUPS))


@query
def presence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score.group_scores(daily_view(spark, sf_dir, by_entity=True), _spec(spark), ("entity", "day"), GROUPS)
    gated = score.presence(scores, ("entity",), "day", {"M": 5, "N": 2, "theta": 0.4}, GROUPS)
    return score.overall(gated, ["C2"], 1, GROUPS).select("entity", "day", "present_C1", "present_C2", "n_present", "flag")


@query
def latest_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.latest(presence_flags(spark, sf_dir), ("entity",), "day")


@query
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score.group_scores(daily_view(spark, sf_dir), _spec(spark), ("entity", "day"), GROUPS)
    return rounded(score.top_groups(scores, ("entity", "day"), 6, GROUPS))


@query
def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score.group_scores(daily_view(spark, sf_dir), _spec(spark), ("entity", "day"), GROUPS)
    return rounded(score.long_scores(scores, ("entity", "day"), GROUPS))


@query
def default_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in specification over all metrics of each dataset, with presence and flag."""
    return rounded(D.flags(D.daily_table(packets(spark, sf_dir), BY_DATASET), score.default_spec(spark), BY_DATASET))


@query
def tuned_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tune.quantile_summary(daily_view(spark, sf_dir), ["m1", "m2", "m3", "m4"], ("entity",)))


@query
def auto_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tune.auto_tune(daily_view(spark, sf_dir), {"m1": True, "m2": False, "m3": True, "m4": True}, ("entity",)))


@query
def packets_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.per_minute(rows_of(spark, sf_dir), BY_DATASET)


@query
def packets_per_week_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.per_week_minute(rows_of(spark, sf_dir), ("Dataset",))


@query
def protocol_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.protocol_mix(rows_of(spark, sf_dir), KEY)


@query
def hourly_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.hourly_heatmap(rows_of(spark, sf_dir), KEY)


@query
def weekday_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.weekday_heatmap(rows_of(spark, sf_dir))


@query
def packets_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.by_group(packets(spark, sf_dir))


@query
def metric_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overview.by_weekday(daily_view(spark, sf_dir), "m2", "day"))


@query
def metric_week_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overview.week_by_weekday(daily_view(spark, sf_dir), "m1", "day"))


@query
def metric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overview.distribution(_long(spark, sf_dir)))


@query
def productivity_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.domains(rows_of(spark, sf_dir), "productivity")


@query
def chat_session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overview.session_list(rows_of(spark, sf_dir), KEY, "chat"))


@query
def diet_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.diet_bursts(rows_of(spark, sf_dir, True), KEY)


@query
def cloud_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.cloud_providers(rows_of(spark, sf_dir), KEY)


@query
def reply_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overview.reply_gaps(rows_of(spark, sf_dir, True), KEY))


@query
def typing_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overview.typing_gaps(rows_of(spark, sf_dir, True), KEY))


@query
def scale_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.scale_events(rows_of(spark, sf_dir), KEY)


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The packet view written out, and the counts of a stream that reads it."""
    from flowrhythm.streaming.slots import write_counts

    folder = shared_folder(spark, "stream")
    p = packets(spark, sf_dir).select("Timestamp", "Dataset", "length")
    p.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(p.schema).parquet(f"{folder}/in")
    write_counts(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(p.schema).parquet(f"{folder}/in"), spark.read.parquet(f"{folder}/out")


def _slots(counts: DataFrame) -> DataFrame:
    return counts.select("Dataset", N.micros("slot_start").alias("slot_us"), "packets", "bytes")


@query
def streamed_slot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of closed slots as a stream gives them."""
    return _slots(_streamed(spark, sf_dir)[1])


@query
def ingested_slot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all slots once a stream has ended: the closed ones as it gives them, the open ones from its packets."""
    from flowrhythm.streaming.slots import with_open_slots

    packets_in, counts = _streamed(spark, sf_dir)
    return _slots(with_open_slots(counts, packets_in))


def _stream_of(spark: SparkSession, sf_dir: str, columns: tuple[str, ...], parts: list[str]) -> tuple[DataFrame, str]:
    """A stream of the packet view, a batch for each of these conditions in their order, and a folder for what it writes."""
    folder = shared_folder(spark, "stream")
    p = packets(spark, sf_dir).select(*columns)
    for k, part in enumerate(parts):
        p.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k:03d}")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    return stream, folder


@query
def corrected_slot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all slots by a stream in which every fiftieth packet comes days late."""
    from flowrhythm.streaming.slots import corrected_counts, write_corrected

    stream, folder = _stream_of(spark, sf_dir, ("Timestamp", "Dataset", "length", "tie"), ["tie % 50 <> 0", "tie % 50 = 0"])
    write_corrected(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return _slots(corrected_counts(spark, f"{folder}/out"))


@query
def streamed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as a stream sees them first."""
    from flowrhythm.streaming.slots import watch_addresses

    stream, folder = _stream_of(spark, sf_dir, ("src", "dst", "Dataset"), ["Dataset = 'lab_03'", "Dataset <> 'lab_03'"])
    watch_addresses(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("ip string").parquet(f"{folder}/out")


#: Ten days at a time, and rows in any order within them.
TEN_DAYS = [f"Timestamp >= TIMESTAMP_NTZ'2024-01-{a:02d} 00:00:00' AND Timestamp < TIMESTAMP_NTZ'{b} 00:00:00'" for a, b in ((1, "2024-01-11"), (11, "2024-01-21"), (21, "2024-03-01"))]


@query
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each dataset that a stream has closed."""
    from flowrhythm.streaming.activity import closed_sessions, write_stream

    stream, folder = _stream_of(spark, sf_dir, ("Timestamp", "Dataset"), TEN_DAYS)
    write_stream(closed_sessions(stream), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("Dataset", N.micros("first").alias("first_us"), N.micros("last").alias("last_us"), F.col("rows").alias("packets"))


@query
def streamed_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and bytes of every minute that a stream has closed, empty ones too."""
    from flowrhythm.streaming.activity import closed_minutes, write_stream

    stream, folder = _stream_of(spark, sf_dir, ("Timestamp", "Dataset", "length"), TEN_DAYS)
    write_stream(closed_minutes(stream), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query
def normalised_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded records, made of the packet view, as packet rows; counted by what normalisation gives."""
    dotted = lambda c: F.concat(F.col(c), F.lit("."))
    answers = F.when(F.col("ans_name").isNotNull(), F.transform(F.split("ans_ips", ", "), lambda x: F.struct(F.concat(F.col("ans_name"), F.lit(".")).alias("name"), x.alias("rdata")))).otherwise(F.array().cast("array<struct<name:string,rdata:string>>"))
    decoded = packets(spark, sf_dir).select(
        F.col("Timestamp").alias("ts"), F.col("src").alias("ip_src"), F.col("dst").alias("ip_dst"), (F.col("protocol") == "TCP").alias("has_tcp"), (F.col("protocol") == "UDP").alias("has_udp"), "sport", "dport", F.lit("S").alias("flags"), "length",
        F.col("is_dns").alias("has_dns"), F.when(F.col("qname").isNotNull(), 0).otherwise(1).alias("dns_qr"), dotted("qname").alias("qname"), F.lit(1).alias("qtype"), answers.alias("answers"),
    )
    rows = S.normalise(decoded)
    return rows.groupBy("Date", "Hour", "Protocol", F.col("TCP Flags").alias("flags"), "IsDNS", "DNS_QNAME", "DNS_QTYPE", "DNS_ANS_NAME", "DNS_ANS_IPS").agg(F.count("*").alias("n"), F.sum("Length").alias("bytes"))


@query
def packets_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by dataset and day, a third of the rows without a time of their own, and read back for eleven days of two datasets."""
    path = shared_folder(spark, "slots")
    p = packets(spark, sf_dir).select("Timestamp", "Dataset", "Date", F.hour("Timestamp").alias("Hour"), "tie", "length")
    S.write_slots(p.withColumn("kept", F.when(F.col("tie") % 3 != 0, F.col("Timestamp"))).where("Timestamp is not null"), path)
    spark_rows = S.read_range(spark, path, "2024-01-05 06:00:00", "2024-01-16", ["lab_03", "onu_capture_home_1"]).drop("Timestamp").withColumnRenamed("kept", "Timestamp")
    return S.with_time(spark_rows).groupBy("Dataset", "Date", "Hour").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


@query
def compacted_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that came in six portions, the closed days compacted, read back for ten days; and the files of each of these days."""
    path = shared_folder(spark, "slots")
    p = packets(spark, sf_dir).select("Timestamp", "Dataset", "Date", "tie", "length")
    for k in range(6):
        S.write_slots(p.where(F.pmod(F.floor(F.hour("Timestamp") / 4), F.lit(6)) == k), path)
    S.compact(spark, path, S.scattered_days(spark, path, "2024-01-15"))
    rows = S.read_range(spark, path, "2024-01-10", "2024-01-20").groupBy("Dataset", "Date").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.countDistinct("slot_start").alias("slots"))
    files = S.list_files(spark, path).groupBy("Dataset", "Date").agg(F.count("*").alias("files"))
    return rows.join(files, ["Dataset", "Date"]).withColumn("few_files", F.col("files") <= 2).drop("files")


@query
def tolerated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets read back from folders in which some files are no Parquet."""
    path = shared_folder(spark, "slots")
    S.write_slots(packets(spark, sf_dir).select("Timestamp", "Dataset", "Date", "tie", "length"), path)
    for day in ("2024-01-03", "2024-01-09"):
        packets(spark, sf_dir).select("src").limit(5).write.mode("append").text(f"{path}/Dataset=lab_03/Date={day}")
    return S.read_range(spark, path, "2024-01-01", "2024-03-01").groupBy("Dataset", "Date").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


@query
def rebuilt_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily table built twice: the second time only days whose fingerprint changed, every seventh, and the last ones, which are new."""
    p, path = packets(spark, sf_dir), shared_folder(spark, "daily")
    current = S.fingerprints(_files(spark, sf_dir))
    first = current.where("Date < DATE'2024-01-25'").withColumn("Fingerprint", F.when(F.dayofmonth("Date") % 7 == 0, F.lit("old")).otherwise(F.col("Fingerprint")))

    def build(number: int) -> Callable[[DataFrame], DataFrame]:
        return lambda days: p.join(days, "Date", "left_semi").groupBy("Date").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes")).withColumn("built", F.lit(number))

    S.rebuild_daily(path, first, None, build(1))
    S.rebuild_daily(path, current, written(spark.read.parquet(path), "cached"), build(2))
    return spark.read.parquet(path).drop("Fingerprint")


@query
def daily_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily table written under the name of a selection of datasets, as CSV, and read back."""
    d, folder, names = daily_view(spark, sf_dir), shared_folder(spark, "daily"), ["lab_03", "onu_capture_home_1"]
    S.write_daily(d, folder, names, "csv")
    return rounded(S.read_daily(spark, folder, names[::-1], "csv", "entity long, day date, m1 double, m2 double, m3 double, m4 double"))


@query
def exported_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of each address, exported as CSV and read back, with whether a list of known addresses, kept as text, has it."""
    p, folder = packets(spark, sf_dir), shared_folder(spark, "export")
    S.export_csv(catalog.packets_per_address(p), f"{folder}/csv")
    catalog.addresses(p.where("Dataset = 'lab_03'")).select(F.concat(F.lit(" "), "ip").alias("value")).write.text(f"{folder}/known")
    known = S.read_known_ips(spark, f"{folder}/known").withColumn("known", F.lit(True))
    rows = spark.read.option("header", "true").schema("ip string, packets long").csv(f"{folder}/csv")
    return rows.join(known, "ip", "left").withColumn("known", F.coalesce("known", F.lit(False)))


@query
def metric_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficient of variation of each metric of each entity."""
    return rounded(_long(spark, sf_dir).groupBy("entity", "metric").agg(N.variation(F.col("value")).alias("variation")))


@query
def slots_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("Dataset", F.lit("__"), F.date_format("Timestamp", "yyyyMMdd_HHmm"), F.when(F.col("tie") % 10 == 0, F.lit(".tmp")).otherwise(F.lit(".parquet")))
    return packets(spark, sf_dir).select(S.slot_of_file(name).alias("slot")).groupBy(N.micros("slot").alias("slot_us")).agg(F.count("*").alias("files"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).groupBy("Date", F.col("Dataset").alias("name")).agg(F.sum("length").alias("size"), F.floor(F.max("us") / 1000000).alias("mtime"))


@query
def day_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fingerprints(_files(spark, sf_dir))


@query
def days_to_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a cache that lacks the first days and has another fingerprint for every seventh."""
    current = S.fingerprints(_files(spark, sf_dir))
    cached = current.where("Date >= DATE'2024-01-04'").withColumn("Fingerprint", F.when(F.dayofmonth("Date") % 7 == 0, F.lit("old")).otherwise(F.col("Fingerprint")))
    return S.stale_days(current, cached).select("Date")


@query
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowrhythm.streaming import slots

    found = slots.ingest_report(slots.slot_counts(packets(spark, sf_dir)))
    return found.select("Dataset", "slots", "rows", N.micros("first").alias("first_us"), N.micros("last").alias("last_us"))


@query
def history_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three measures that look at earlier days, as columns of one frame."""
    d = daily_view(spark, sf_dir, by_entity=True).withColumns({"C4_F1_OnsetLocalMin": F.when(F.col("m3").isNotNull(), F.pmod(F.col("m2") * 37, F.lit(1440.0))), "LongestInactivityHours": F.col("m3"), "C6_F8_FirstActivityMin": F.col("m2")})
    return rounded(baseline.with_history(d, ("entity",), "day").select("entity", "day", "C4_F3_OnsetVar14dMin", "C4_F4_SleepDurationZAbs30d", "C6_F9_ActivationDelayVsBase28d"))


@query
def value_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_view(spark, sf_dir).withColumnRenamed("m2", "C6_F8_FirstActivityMin")
    said = {"today": "TODAY:m1", "constant": "CONST:2.5", "aux": "AUX:limit", "column": "FUNC:FirstActivityMin", "delta": "FUNC:DELTA_FROM_MEDIAN(window=28)", "unknown": "FUNC:Nothing"}
    for name, reference in said.items():
        d = with_value(d, reference, name, ("entity",), "day", {"limit": 7.0})
    return rounded(d.select("entity", "day", *said))


@query
def cached_or_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """m3 of a cache, where it has any, else the share of returns."""
    d = daily_view(spark, sf_dir)
    computed = d.select("entity", "day", (F.col("m4") / F.col("m1")).alias("m3"))
    return rounded(with_precedence(computed, d.select("entity", "day", "m3").where(F.dayofmonth("day") > 10), ("entity", "day")))


@query
def membership_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score.contributions(daily_view(spark, sf_dir), _spec(spark), ("entity", "day"))
    return rounded(overview.distribution(found.select("entity", "day", "metric", F.col("mu").alias("value"))))


def all_queries() -> dict[str, Any]:
    return dict(QUERIES)
