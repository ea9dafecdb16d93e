"""Ingestion as a stream: packets to Parquet, counts per five-minute slot, seen addresses.

A slot is counted once the watermark, ten minutes behind the newest slot, has passed
its end. Rows that come later are left out of these counts; the packet sink keeps them.
Slots that are still open when a run ends are counted from the packet sink. Corrected
counts take late rows in: every batch adds its part to the slots that it has rows of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LAG = "10 minutes"


def slot_counts(packets: DataFrame, minutes: int = 5, lag: str = LAG) -> DataFrame:
    """(Dataset, slot_start, packets, bytes, first, last) of closed slots; batch or stream. packets: Timestamp, Dataset, length."""
    rows = packets.withColumn("__slot", F.window("Timestamp", f"{minutes} minutes")["start"].cast("timestamp"))
    if packets.isStreaming:
        rows = rows.withWatermark("__slot", lag)
    w = F.window("__slot", f"{minutes} minutes")
    return rows.groupBy("Dataset", w.alias("w")).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.min("Timestamp").alias("first"), F.max("Timestamp").alias("last")).select("Dataset", F.col("w.start").cast("timestamp_ntz").alias("slot_start"), "packets", "bytes", "first", "last")


def write_packets(packets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All packets, late ones too, by dataset and day; ends when everything there is has been taken."""
    rows = packets.withColumns({"slot_start": F.window("Timestamp", "5 minutes")["start"], "Date": F.to_date("Timestamp")})
    return rows.writeStream.format("parquet").partitionBy("Dataset", "Date").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_counts(packets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return slot_counts(packets).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def with_open_slots(counts: DataFrame, packets: DataFrame) -> DataFrame:
    """The counts of a finished run and, from its packets, those of the slots after the last one that it closed.

    The watermark holds for all datasets, so no later slot has been counted. Only days and row groups from there on
    are read. Without any counts all packets are counted. Nothing is written: the next run closes these slots itself.
    """
    last = counts.agg(F.max(F.col("slot_start") + F.expr("INTERVAL 5 MINUTES")).cast("string")).first()[0]
    if last is not None:
        packets = packets.where(F.col("Timestamp") >= F.lit(last).cast("timestamp_ntz"))
        if "Date" in packets.columns:
            packets = packets.where(F.col("Date") >= F.to_date(F.lit(last)))
    return counts.unionByName(slot_counts(packets))


def write_corrected(packets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts that late rows correct, however late: each batch writes its part of every slot that it touches.

    A batch that is repeated replaces what it wrote, so nothing counts twice. `corrected_counts` adds the parts up.
    """

    def put(batch: DataFrame, number: int) -> None:
        slot_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return packets.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def corrected_counts(spark: SparkSession, path: str) -> DataFrame:
    """(Dataset, slot_start, packets, bytes, first, last, batches) of all slots that any batch had rows of."""
    parts = spark.read.parquet(path)
    return parts.groupBy("Dataset", "slot_start").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("batches"))


def merge_corrected(spark: SparkSession, path: str, into: str) -> None:
    """The parts of a stream that has ended, added up in one table in the place of one file or more for each batch."""
    corrected_counts(spark, path).drop("batches").write.mode("overwrite").parquet(into)


def watch_addresses(packets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """(ip): each address once, when it is first seen. The stream's own state knows the seen ones: nothing that was written is read again."""
    seen = packets.select(F.explode(F.array("src", "dst")).alias("ip")).where("ip is not null").dropDuplicates(["ip"])
    return seen.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest_report(counts: DataFrame) -> DataFrame:
    """Slots, rows, first and last time of each dataset, from slot counts."""
    return counts.groupBy("Dataset").agg(F.count("*").alias("slots"), F.sum("packets").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))
