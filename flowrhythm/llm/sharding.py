"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

The ring has a fixed number of cells. Every shard owns many points of it; a key goes to
its cell and from there clockwise to the first shard with room. No shard takes more than
its bound, so the balance is guaranteed, and what a full shard turns away moves on to the
next, so little else moves.

All keys of a cell meet the shards in the same order. What each shard takes from each
cell therefore follows from the number of rows per cell, a table of fixed size, and rows
are dealt by their rank in the cell. Ranks are counted in salted parts of a cell, of about
PART_ROWS rows each, so a key that holds a third of all rows is still dealt by many tasks.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowrhythm.llm.common import fresh, materialise

#: Cells of the ring, points of a shard on it, rows of a salted part of a cell, about.
CELLS, POINTS, PART_ROWS = 4096, 64, 1 << 18


def ring(shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """(cell, shard) of all points, clockwise. A point depends on its shard and number alone."""

    def place(shard: int, k: int) -> tuple[int, str]:
        h = hashlib.sha256(f"{shard}:{k}".encode()).hexdigest()
        return int(h[:8], 16) % CELLS, h

    return [(cell, s) for (cell, _), s in sorted((place(s, k), s) for s in range(shards) for k in range(points))]


def clockwise(shards: int, points: int = POINTS) -> list[list[int]]:
    """For each cell the shards in the order in which they are met."""
    at = ring(shards, points)
    out, i = [], 0
    for cell in range(CELLS):
        while i < len(at) and at[i][0] < cell:
            i += 1
        out.append(list(dict.fromkeys(s for _, s in at[i:] + at[:i])))
    return out


def deal(counts: dict[int, int], capacity: list[int], points: int = POINTS) -> list[tuple[int, int, int, int]]:
    """(cell, first rank, shard, first slot) of the runs of ranks that each shard takes; counts holds CELLS entries at most."""
    room, taken, out = list(capacity), [0] * len(capacity), []
    for cell, order in enumerate(clockwise(len(capacity), points)):
        left, rank = counts.get(cell, 0), 0
        for s in order:
            if not left:
                break
            if n := min(left, room[s]):
                out.append((cell, rank, s, taken[s]))
                left, rank, room[s], taken[s] = left - n, rank + n, room[s] - n, taken[s] + n
        if left:
            raise ValueError("the bounds leave no room for all rows")
    return out


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """The most rows of each shard: an equal share, and so much more as a part of it. Without slack, at most one apart."""
    return [int((rows // shards + (s < rows % shards)) * (1 + slack)) for s in range(shards)]


def cell_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")


def assign(keyed: DataFrame, key: str, shards: int, slack: float = 0.0, points: int = POINTS, part_rows: int = PART_ROWS) -> DataFrame:
    """keyed with two more columns, shard and slot; slots of a shard are gapless from 0.

    keyed must be a written table, whose rows keep their places when a task is repeated. Rows with
    equal keys share a cell; which of them is dealt first is settled by their place in the table.
    A null key is a key like any other. Columns shard and slot that keyed has are replaced, all others
    stay. An empty table stays empty.
    """
    spark = keyed.sparkSession
    cell, place, part, parts, rank, before, first, end, at = (fresh(keyed, n) for n in ("cell", "place", "part", "parts", "rank", "before", "first", "end", "at"))
    rows = keyed.withColumns({cell: cell_of(F.col(key)), place: F.monotonically_increasing_id()}).drop("shard", "slot")
    cols = rows.drop(cell, place).columns

    def table(fields: str, data: list[tuple]) -> DataFrame:
        names = [f.split(":")[0] for f in fields.split(",")]
        said = json.dumps([dict(zip(names, r)) for r in data])
        return spark.range(1).select(F.inline(F.from_json(F.lit(said), f"array<struct<{fields}>>")))

    counts = {r[cell]: r["n"] for r in rows.groupBy(cell).agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
    runs = deal(counts, bounds(sum(counts.values()), shards, slack), points)
    cut = table(f"{cell}:int,{parts}:long", [(c, math.ceil(n / part_rows)) for c, n in counts.items()])
    rows = rows.join(F.broadcast(cut), cell).withColumn(part, F.pmod(F.xxhash64(place), F.col(parts)))
    sizes = rows.groupBy(cell, part).agg(F.count("*").alias(rank))  # a row for each part
    w = Window.partitionBy(cell).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(cell, part, F.coalesce(F.sum(rank).over(w), F.lit(0)).alias(before))
    # CELLS * shards runs at most
    dealt = table(f"{cell}:int,{first}:long,shard:int,{at}:long", runs)
    dealt = dealt.withColumn(end, F.coalesce(F.lead(first).over(Window.partitionBy(cell).orderBy(first)), F.lit((1 << 63) - 1)))
    local = Window.partitionBy(cell, part).orderBy(place)
    ranked = rows.withColumn(rank, F.row_number().over(local) - 1).join(starts, [cell, part]).withColumn(rank, F.col(rank) + F.col(before))
    out = ranked.join(F.broadcast(dealt), cell).where((F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(end)))
    return out.select(*cols, "shard", (F.col(at) + F.col(rank) - F.col(first)).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, slack: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; the key is the id.

    Size is the bytes of the text in UTF-8 and one more; a null text has none, and the checksum of
    nothing. Without slack the shards' counts differ by one at most. Repeated rows count each.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return assign(materialise(rows, "keys"), "doc_id", shards, slack)


def moved(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows between each pair of shards, for two assignments of unique keys: from, to, n."""
    a, b = before.select(key, F.col("shard").alias("from")), after.select(key, F.col("shard").alias("to"))
    return a.join(b, key).groupBy("from", "to").agg(F.count("*").alias("n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_documents(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
