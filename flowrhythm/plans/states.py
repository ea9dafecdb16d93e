"""Daily metrics from mergeable states of five-minute slots.

A slot of a key is reduced to what merges: sums, least and greatest values, counts of
different values, active minutes, islands of activity, the first and last ordered row of
each mask, and counts of gap lengths. A day is the merge of its slots. States are rows of
tables that are only ever appended to; a manifest says which version of a slot holds, and
is written last, so an update that fails changes nothing. A slot that comes late or again
is reduced alone. Its answers may name addresses anew, though: other slots of its scope
that send to those are reduced again too, and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowrhythm.functions.network import MICROS
from flowrhythm.operators.enrich import with_host, with_masks
from flowrhythm.operators.gaps import busiest_slot, with_previous
from flowrhythm.operators.series import minute_measures, minutes
from flowrhythm.operators.sessions import masked, sessions
from flowrhythm.plans import metrics as M
from flowrhythm.sources.packets import TYPES
from flowrhythm.sources.scratch import written

SLOT = 300
TABLES = ("sums", "values", "domain_minutes", "diet_bins", "query_minutes", "minutes", "islands", "ends", "gaps")


def slot_number() -> Column:
    return F.floor(F.col("us") / F.lit(SLOT * MICROS))


def reduced(rows: DataFrame, keys: tuple[str, ...], busiest: int | None = None) -> dict[str, DataFrame]:
    """The states of enriched rows by key and slot, a table for each kind. keys hold Date, in which hours of the day are counted."""
    if "Date" not in keys:
        raise ValueError("keys must hold Date")
    rows = rows.withColumn("slot", slot_number())
    by = (*keys, "slot")
    domains, diet, queries = M.burst_counts(rows, by)
    base = M.gap_masks(rows, by)
    gaps = with_previous(base, (*by, "mask"), ("us", "inbound"), busiest=busiest_slot(rows, keys) if busiest is None else busiest)
    edge = F.struct("us", "tie", "inbound", "outbound")
    ends = base.groupBy(*by, "mask").agg(F.min(edge).alias("first"), F.max(edge).alias("last")).join(gaps.groupBy(*by, "mask").agg(*M.gap_ends()), [*by, "mask"])
    return {
        "sums": M.counter_sums(rows, by, F.bit_or(F.expr("shiftleft(1L, hour)"))),
        "values": M.value_counts(rows, by),
        "domain_minutes": domains,
        "diet_bins": diet,
        "query_minutes": queries,
        "minutes": minutes(rows, by),
        "islands": sessions(masked(rows, M.session_masks()), by, M.SESSION_GAPS, M.session_sums(), by=("mask",)).drop("session"),
        "ends": ends,
        "gaps": _lengths(gaps, by),
    }


def _lengths(gaps: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, kind, value, n): how often each length of a reply, key stroke and request gap occurs."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("long").alias("value")) for k, v in M.gap_values().items()))
    return gaps.select(*by, F.explode(F.filter(kinds, lambda x: x["value"].isNotNull())).alias("x")).groupBy(*by, "x.kind", "x.value").agg(F.count("*").alias("n"))


def merged(states: dict[str, DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """All metrics of each key from the states of its slots: what `metrics.daily` gives for their rows."""
    by = [*keys]
    sums = states["sums"]
    how = lambda c: F.min(c) if c in M.LEAST_OF else F.max(c) if c in M.MOST_OF else F.bit_or(c) if c == "__hours" else F.sum(c)
    whole = sums.groupBy(*by).agg(*(how(c).alias(c) for c in sums.columns if c not in (*keys, "slot"))).withColumn("__hours", F.bit_count("__hours"))
    added = lambda t, *on: states[t].groupBy(*by, *on).agg(*(F.sum(c).alias(c) for c in states[t].columns if c not in (*keys, "slot", *on)))
    return M.joined_parts(
        [
            M.counter_metrics(whole, keys), M.distinct_metrics(added("values", "which", "value"), keys),
            M.burst_metrics(states["domain_minutes"], added("diet_bins", "SLD", "bin"), states["query_minutes"], keys),
            minute_measures(states["minutes"].drop("slot"), keys), M.session_metrics(_chained(states["islands"], keys), keys), _ordered(states["ends"], states["gaps"], keys),
        ],
        keys,
    )


def _chained(islands: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sessions from the islands of slots: a few for each slot and mask, ordered by key and mask."""
    w = Window.partitionBy(*keys, "mask").orderBy("first_us")
    gap = F.create_map(*(F.lit(x) for k, g in M.SESSION_GAPS.items() for x in (k, g * MICROS)))[F.col("mask")]
    new = F.coalesce(F.col("first_us") - F.lag("last_us").over(w) > gap, F.lit(True)).cast("int")
    numbered = islands.withColumn("__new", new).withColumn("session", F.sum("__new").over(w))
    return numbered.groupBy(*keys, "mask", "session").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *(F.sum(c).alias(c) for c in M.session_sums()))


def _ordered(ends: DataFrame, gaps: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Measures of ordered rows: those inside slots, and the gaps from a slot's last row to the next slot's first."""
    w = Window.partitionBy(*keys, "mask").orderBy("slot")
    edge = ends.withColumn("before", F.lag("last").over(w)).select(*keys, "mask", "first.us", "first.inbound", "first.outbound", F.col("before.us").alias("prev_us"), F.col("before.inbound").alias("prev_inbound"))
    inside = ends.groupBy(*keys).agg(F.max("__longest").alias("__longest"), F.min("__onset").alias("__onset"), F.max("__mid").alias("__mid"), F.min("__mid0").alias("__mid0"), F.min("__mid1").alias("__mid1"))
    both = inside.unionByName(edge.groupBy(*keys).agg(*M.gap_ends())).groupBy(*keys).agg(F.max("__longest").alias("__longest"), F.min("__onset").alias("__onset"), F.max("__mid").alias("__mid"), F.min("__mid0").alias("__mid0"), F.min("__mid1").alias("__mid1"))
    lengths = gaps.select(*keys, "kind", "value", "n").unionByName(_lengths(edge, keys)).groupBy(*keys, "kind", "value").agg(F.sum("n").alias("n"))
    value, n = F.col("value").cast("decimal(38,0)"), F.col("n").cast("decimal(38,0)")
    of = lengths.groupBy(*keys, "kind").agg(F.percentile("value", 0.5, F.col("n")).alias("median"), F.sum(n).alias("n"), F.sum((value * n).cast("decimal(38,0)")).alias("s"), F.sum((value * value * n).cast("decimal(38,0)")).alias("ss"))
    # whole numbers: the squares around the mean without loss
    of = of.withColumn("around", ((F.col("n") * F.col("ss")).cast("decimal(38,0)") - (F.col("s") * F.col("s")).cast("decimal(38,0)")).cast("double"))
    on = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    of = of.groupBy(*keys).agg(*(on(k, c).alias(f"{c}_{k}") for k in ("reply", "typing", "request") for c in ("median", "n", "s", "around")))
    d = lambda c: F.col(c).cast("double")
    micros = F.lit(float(MICROS))
    wide = both.join(of, [*keys], "left").withColumns(
        {
            "C2_F2_MedianReplyLatencySec": F.col("median_reply"), "C5_F3_MedianIKS": F.col("median_typing") / micros,
            "C5_F4_IKSStd": F.when(d("n_typing") >= 3, F.sqrt(F.col("around_typing") / (d("n_typing") * (d("n_typing") - 1))) / micros), "C6_F6_MedianInterReqSec": F.col("median_request"),
            "C6_F7_InterReqFano": F.when((d("n_request") >= 2) & (d("s_request") > 0), F.col("around_request") / d("n_request") / d("s_request")),
        }
    )
    return M.finish_gaps(wide, keys)


class SlotStates:
    """The state tables of a folder. keys hold Date, and other keys are strings; they are also the scope in which answers name addresses."""

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...] = ("Date",)) -> None:
        self.spark, self.folder, self.keys = spark, folder, keys
        self.by = (*keys, "slot")

    @cached_property
    def schemas(self) -> dict[str, str]:
        """The columns of each table, for those that have no rows yet."""
        kinds = {"us": "long", "tie": "long", "ans_ips": "string", "present": "array<string>"} | TYPES | {k: "date" if k == "Date" else "string" for k in self.keys}
        none = self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in kinds.items())).withColumn("slot", slot_number())
        rows = with_masks(none.withColumns({"ResolvedHost": F.lit(""), "SLD": F.lit("")}))
        found = reduced(rows, self.keys, 0) | {"answers": self._answers(none), "targets": none.select(*self.by, "dst"), "manifest": none.select(*self.by, F.lit(0).cast("long").alias("number"))}
        return {name: df.withColumn("version", F.lit("")).schema for name, df in found.items()}

    def _append(self, name: str, df: DataFrame, version: str) -> None:
        df.withColumn("version", F.lit(version)).write.mode("append").partitionBy("Date").parquet(f"{self.folder}/{name}")

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schemas[name])

    def current(self, pending: DataFrame | None = None) -> DataFrame:
        """(keys, slot, version) that holds of each slot; pending is an update that no manifest has yet."""
        rows = self._read("manifest")
        rows = rows if pending is None else rows.unionByName(pending)
        return rows.groupBy(*self.by).agg(F.max_by("version", "number").alias("version"))

    def table(self, name: str, days: DataFrame | None = None, pending: DataFrame | None = None) -> DataFrame:
        """A table's rows that hold, of some days (a table with Date) or all; other days' folders are not read."""
        rows, current = self._read(name), self.current(pending)
        if days is not None:
            some = F.broadcast(days.select("Date").distinct())  # a row for each day
            rows, current = rows.join(some, "Date", "left_semi"), current.join(some, "Date", "left_semi")
        return rows.join(current, [*self.by, "version"], "left_semi").drop("version")

    def names(self, days: DataFrame | None = None, pending: DataFrame | None = None) -> DataFrame:
        """(keys, ip, host): the first host that the slots' answers give for an address, as `enrich.dns_map` of all their rows."""
        each = self.table("answers", days, pending)
        first = lambda c: F.min(c)[c]  # noqa: E731  the struct begins with time, tie and place
        answered = each.groupBy(*self.keys).agg(F.max("answered").alias("answered"))
        by_ip = each.where("ip is not null").groupBy(*self.keys, "ip").agg(first("ans_name").alias("a"), first("qname").alias("q"))
        return by_ip.join(answered, [*self.keys]).select(*self.keys, "ip", F.when(F.col("answered"), F.col("a")).otherwise(F.col("q")).alias("host")).where("host is not null")

    def _answers(self, rows: DataFrame) -> DataFrame:
        """(keys, slot, ip, ans_name, qname, answered): first answer and question of each address; without an ip, whether there is an answer at all."""
        dns = rows.where(F.coalesce("is_dns", F.lit(False)))
        ips = F.col("ans_ips") if dict(rows.dtypes)["ans_ips"].startswith("array") else F.split("ans_ips", ",")
        each = dns.select(*self.by, "us", "tie", "ans_name", "qname", F.posexplode(ips).alias("pos", "ip")).withColumn("ip", F.trim("ip")).where("ip <> ''")
        first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("us", "tie", "pos", c))).alias(c)
        named = each.groupBy(*self.by, "ip").agg(first("ans_name"), first("qname")).withColumn("answered", F.lit(False))
        return named.unionByName(dns.groupBy(*self.by).agg(F.max(F.col("ans_name").isNotNull()).alias("answered")), allowMissingColumns=True)

    def update(self, changed: DataFrame, packets: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Reduce slots that are new, changed or gone, and return all that were reduced, as (keys, slot).

        changed: (keys, slot). packets gives the standard packet rows of the slots it is handed; rows of others
        that it returns are passed over. It is called for the changed slots, and once more for those that send
        to addresses which have another name now. What a failed update has written is in no manifest.
        """
        version = uuid.uuid4().hex
        number = self._read("manifest").agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
        stamp = lambda slots: slots.select(*self.by, F.lit(number).cast("long").alias("number"), F.lit(version).alias("version"))
        held = lambda slots: packets(slots).withColumn("slot", slot_number()).join(slots, [*self.by], "left_semi")

        def note(slots: DataFrame) -> None:
            rows = held(slots)
            self._append("answers", self._answers(rows), version)
            self._append("targets", rows.where("dst is not null").select(*self.by, "dst").distinct(), version)

        changed = written(changed.select(*self.by).distinct(), "changed")
        old = written(self.names(changed), "names")
        note(changed)
        new = written(self.names(changed, stamp(changed)), "names")
        moved = new.exceptAll(old).unionByName(old.exceptAll(new)).select(*self.keys, F.col("ip").alias("dst")).distinct()
        others = self.table("targets", changed, stamp(changed)).join(moved, [*self.keys, "dst"], "left_semi").select(*self.by).distinct().join(changed, [*self.by], "left_anti")
        others = written(others, "others")
        note(others)
        todo = changed.unionByName(others)
        rows = with_masks(with_host(held(todo), self.keys, new))
        rows = written(rows.select(*dict.fromkeys((*self.keys, *M.COLUMNS))), "enriched")
        for name, state in reduced(rows, self.keys).items():
            self._append(name, state, version)
        self._append("manifest", stamp(todo).drop("version"), version)
        return todo

    def daily(self, days: DataFrame | None = None) -> DataFrame:
        """All metrics of each key, from states alone; of some days, or of all."""
        return merged({name: self.table(name, days) for name in TABLES}, self.keys)
