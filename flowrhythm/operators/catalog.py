"""The catalog of datasets, days, addresses and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrhythm.functions.network import MICROS
from flowrhythm.operators.joins import frequent, look_up


def dataset_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("onu")), "ONU").when(F.contains(low, F.lit("bras")), "BRAS").otherwise("Other")


def group_prefix(name: Column) -> Column:
    """The name without a number at its end."""
    return F.regexp_replace(name, r"([_-]?\d+)$", "")


def group_token(prefix: Column) -> Column:
    """Lower case, without the type, "capture_" and separators in front."""
    s = F.regexp_replace(F.lower(prefix), r"^(onu_|bras_|other_)", "")
    return F.regexp_replace(F.regexp_replace(s, r"^capture_", ""), r"^[_-]+", "")


def datasets(packets: DataFrame) -> DataFrame:
    """(Dataset, type, prefix, token) of the datasets there are."""
    d = packets.select("Dataset").distinct()
    prefix = group_prefix(F.col("Dataset"))
    return d.select("Dataset", dataset_type(F.col("Dataset")).alias("type"), prefix.alias("prefix"), group_token(prefix).alias("token"))


def select_datasets(catalog: DataFrame, types: tuple[str, ...] = (), tokens: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> DataFrame:
    """Datasets of any of these types ("ALL" for every one), tokens or names, each once."""
    none = F.lit(False)
    by = [none if not v else (F.lit(True) if c == "type" and "ALL" in v else F.col(c).isin(*v)) for c, v in (("type", types), ("token", tokens), ("Dataset", names))]
    return catalog.where(by[0]).union(catalog.where(by[1])).union(catalog.where(by[2])).distinct()


def slots_per_day(packets: DataFrame) -> DataFrame:
    """(Date, slots): five-minute slots with packets over all datasets, with days in between as 0."""
    slot = F.floor(F.col("us") / F.lit(300 * MICROS))
    days = packets.groupBy("Dataset", "Date", slot.alias("slot")).agg(F.lit(1).alias("x")).groupBy("Date").agg(F.count("*").alias("slots"))
    all_days = days.agg(F.min("Date").alias("a"), F.max("Date").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("Date"))
    return all_days.join(days, "Date", "left").select("Date", F.coalesce("slots", F.lit(0)).alias("slots"))


def calendar(per_day: DataFrame) -> DataFrame:
    """Slots per day as weeks (ISO year and week) by weekdays."""
    day = F.date_add(F.col("Date"), 3 - F.weekday("Date"))  # the Thursday of its week
    rows = per_day.select(F.year(day).alias("year"), F.weekofyear("Date").alias("week"), F.weekday("Date").alias("d"), "slots")
    names = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
    return rows.groupBy("year", "week").agg(*(F.sum(F.when(F.col("d") == i, F.col("slots"))).alias(n) for i, n in enumerate(names)))


def days(packets: DataFrame) -> DataFrame:
    return packets.select("Date").where("Date is not null").distinct()


def week_starts(packets: DataFrame) -> DataFrame:
    """The Mondays of the weeks with packets."""
    return days(packets).select(F.date_sub("Date", F.weekday("Date")).alias("WeekStart")).distinct()


def with_labels(rows: DataFrame) -> DataFrame:
    """Label (type, group and day), Scope and WeekStart of each row."""
    kind = dataset_type(F.col("Dataset"))
    return rows.withColumns({"Scope": kind, "WeekStart": F.date_sub("Date", F.weekday("Date")), "Label": F.concat_ws(" ", kind, group_token(group_prefix(F.col("Dataset"))), F.date_format("Date", "yyyy-MM-dd"))})


def addresses(packets: DataFrame) -> DataFrame:
    """(ip): every address that sends or receives."""
    return packets.select(F.explode(F.array("src", "dst")).alias("ip")).where("ip is not null").distinct()


def new_addresses(packets: DataFrame, known: DataFrame) -> DataFrame:
    return addresses(packets).join(known.select("ip"), "ip", "left_anti")


def merged_addresses(packets: DataFrame, known: DataFrame) -> DataFrame:
    return addresses(packets).union(known.select("ip")).distinct()


def addresses_in_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """IPv4 tokens of text lines, each once."""
    return lines.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), F.lit(0))).alias("ip")).distinct()


def packets_per_address(packets: DataFrame) -> DataFrame:
    """(ip, packets): as a source and as a destination, added."""
    return packets.select(F.explode(F.array("src", "dst")).alias("ip")).where("ip is not null").groupBy("ip").agg(F.count("*").alias("packets"))


def touching(packets: DataFrame, chosen: DataFrame | list[str], skewed: bool = False) -> DataFrame:
    """Rows whose source or destination is chosen; a table of addresses is joined, a list becomes literals.

    If skewed, addresses that many packets have are looked for first, in one more pass over each side.
    """
    if isinstance(chosen, list):
        return packets.where(F.coalesce(F.col("src").isin(*chosen) | F.col("dst").isin(*chosen), F.lit(False))) if chosen else packets.limit(0)
    ips = chosen.select("ip").distinct()
    sides = {side: ips.select(F.col("ip").alias(side), F.lit(True).alias(f"__{side}")) for side in ("src", "dst")}
    return _both_sides(packets, sides, skewed).where("__src or __dst").select(*packets.columns)


def _both_sides(packets: DataFrame, sides: dict[str, DataFrame], skewed: bool) -> DataFrame:
    out = packets
    for side, table in sides.items():
        out = look_up(out, table, (side,), frequent(packets, (side,)) if skewed else [], F.col("tie"))
    return out


def with_user(packets: DataFrame, users: DataFrame, skewed: bool = False) -> DataFrame:
    """User: both sides' names as "src/dst" where they differ, the one known, or nothing. Of profiles that share an address the last has it."""
    last = users.groupBy("ip").agg(F.max_by("username", "place").alias("user"))
    sides = {side: last.select(F.col("ip").alias(side), F.col("user").alias(name)) for side, name in (("src", "__a"), ("dst", "__b"))}
    name = F.when((F.col("__a") != "") & (F.col("__b") != "") & (F.col("__a") != F.col("__b")), F.concat_ws("/", "__a", "__b")).otherwise(F.coalesce("__a", "__b", F.lit("")))
    return _both_sides(packets, sides, skewed).withColumn("User", name).drop("__a", "__b")


def preview(rows: DataFrame, columns: list[str], n: int = 100) -> DataFrame:
    """The first n rows by time, for a look."""
    return rows.orderBy("us", "tie").limit(n).select(*columns)
