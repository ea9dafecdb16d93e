"""Host names, domains, directions and masks of packet rows, each computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrhythm.functions import network as N
from flowrhythm.operators.joins import frequent, look_up


#: Bytecode of a method above which the JVM interprets it for good.
METHOD_BYTES = 8000


def compiled(df: DataFrame) -> DataFrame:
    """df, whose session from now on runs a stage whose generated method would pass METHOD_BYTES operator by operator."""
    conf, key = df.sparkSession.conf, "spark.sql.codegen.hugeMethodLimit"
    if int(conf.get(key)) > METHOD_BYTES:
        conf.set(key, str(METHOD_BYTES))
    return df


def dns_map(packets: DataFrame, scope: tuple[str, ...] = ("Date",)) -> DataFrame:
    """(scope, ip, host): the first host that DNS rows give for an address, by time, tie and place in the answer.

    Names come from the answer if any DNS row of the scope has one there, else from the question. Answers
    are a text with commas or an array.
    """
    rows = packets.where(F.coalesce("is_dns", F.lit(False)))
    kind = dict(packets.dtypes)["ans_ips"]
    ips = F.col("ans_ips") if kind.startswith("array") else F.split("ans_ips", ",")
    each = rows.select(*scope, "us", "tie", "ans_name", "qname", F.posexplode_outer(ips).alias("pos", "ip")).withColumn("ip", F.nullif(F.trim("ip"), F.lit("")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("us", "tie", "pos")))
    # one pass: a row without addresses tells only whether its scope has an answer's name, under no address
    by_ip = each.groupBy(*scope, "ip").agg(first("ans_name").alias("a"), first("qname").alias("q"), F.max(F.col("ans_name").isNotNull()).alias("answered"))
    answered = F.max("answered").over(Window.partitionBy(*scope))
    return by_ip.withColumn("answered", answered).where("ip is not null").select(*scope, "ip", F.when(F.col("answered"), F.col("a")).otherwise(F.col("q")).alias("host")).where("host is not null")


def with_host(packets: DataFrame, scope: tuple[str, ...] = ("Date",), mapping: DataFrame | None = None, skewed: bool = False) -> DataFrame:
    """ResolvedHost and SLD: the mapped destination, else the row's own answer or question.

    If skewed, destinations that many packets have are looked for first, in one more pass over them.
    """
    found = (dns_map(packets, scope) if mapping is None else mapping).withColumnsRenamed({"ip": "dst", "host": "__host"})
    on = (*scope, "dst")
    out = look_up(packets, found, on, frequent(packets, on) if skewed else [], F.col("tie"))
    return out.withColumn("ResolvedHost", F.coalesce("__host", "ans_name", "qname")).drop("__host").withColumn("SLD", N.sld(F.col("ResolvedHost")))


def with_masks(rows: DataFrame, ipv6: bool = False) -> DataFrame:
    """Direction and category columns, time parts, and which optional columns there were."""
    src, dst = N.is_private(F.col("src"), ipv6), N.is_private(F.col("dst"), ipv6)
    rows = rows.withColumns({"__s": src, "__d": dst})
    sld = F.col("SLD")
    rows = rows.withColumns({"outbound": F.col("__s") & ~F.col("__d"), "inbound": ~F.col("__s") & F.col("__d"), "hour": N.hour_of(F.col("us")), "minute": N.minute_of(F.col("us")), "bytes": F.coalesce("length", F.lit(0))}).drop("__s", "__d")
    masks: dict[str, Column] = {name: N.in_category(name, sld) for name in ("social", "food", "diet", "scale", "mental_health", "crisis", "productivity", "cloud")}
    masks |= {"chat": N.chat_row(sld, F.col("dport")), "streaming": N.in_category("streaming", sld) & F.col("inbound"), "dhcp": N.dhcp_row(F.col("protocol"), F.col("sport"), F.col("dport")), "forum": N.matches("forum", F.col("url"))}
    return rows.withColumns(masks)


def enrich(packets: DataFrame, scope: tuple[str, ...] = ("Date",), ipv6: bool = False, skewed: bool = False) -> DataFrame:
    """Standard packet rows with hosts, domains, directions and masks."""
    return with_masks(with_host(compiled(packets), scope, skewed=skewed), ipv6)
