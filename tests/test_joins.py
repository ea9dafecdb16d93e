"""Joins with frequent keys against plain ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowrhythm.operators import catalog, joins


def made(spark):
    """Half of all rows have one key, a tenth another, which the table lacks, and some have none."""
    dst = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 == 1, "gone").when(F.col("id") % 10 == 3, F.lit(None)).otherwise(F.concat(F.lit("a"), (F.col("id") * 7919 % 9000).cast("string")))
    return spark.range(40_000).select(F.col("id").alias("tie"), (F.col("id") % 3).cast("string").alias("Date"), dst.alias("dst"), F.lit("10.0.0.1").alias("src")).repartition(6)


def test_frequent_keys_are_found(spark):
    rows = made(spark)
    found = set(joins.frequent(rows, ("dst",), 20))
    want = {r.h for r in spark.sql("SELECT xxhash64('hot') AS h UNION ALL SELECT xxhash64('gone')").collect()}
    assert found == want
    assert joins.frequent(rows.limit(0), ("dst",)) == [] and joins.frequent(rows.where("dst is null"), ("dst",)) == []
    assert len(joins.frequent(rows.where("dst like 'a%'"), ("dst",), 20)) == 0


def test_look_up_is_a_left_join(spark):
    rows = made(spark)
    table = spark.range(9000).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("dst"), F.explode(F.array(*map(F.lit, "01"))).alias("Date"), F.col("id").alias("host")).where("host % 4 <> 0")
    table = table.unionByName(spark.createDataFrame([("hot", "0", -1), ("hot", "2", None)], "dst string, Date string, host long"))
    on = ("Date", "dst")
    hot = joins.frequent(rows, on, 40)
    assert len(hot) >= 3
    key = lambda df: sorted(map(str, df.select("tie", "Date", "dst", "src", "host").collect()))
    assert key(joins.look_up(rows, table, on, hot, F.col("tie"))) == key(rows.join(table, [*on], "left"))


def test_no_task_has_more_than_twice_the_mean(spark):
    rows = made(spark).where("dst is not null")
    table = rows.where("dst like 'a%'").select("dst").distinct().withColumn("host", F.length("dst"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sizes = lambda df: [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("host")).collect()]
        plain = sizes(rows.join(table, "dst", "left"))
        dealt = sizes(joins.look_up(rows, table, ("dst",), joins.frequent(rows, ("dst",), 20), F.col("tie")))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(plain) == sum(dealt) and max(plain) > sum(plain) / 2
    assert max(dealt) <= 2 * sum(dealt) / len(dealt) and len(dealt) == 8


def test_touching_and_users_with_a_hot_address(spark):
    rows = made(spark)
    chosen = spark.createDataFrame([("hot",), ("a5",), ("a5",), ("10.9.9.9",)], "ip string")
    assert catalog.touching(rows, chosen, True).exceptAll(catalog.touching(rows, chosen)).count() == 0
    assert catalog.touching(rows, chosen, True).count() == catalog.touching(rows, chosen).count() > 20_000
    users = spark.createDataFrame([("x", "hot", 1), ("y", "hot", 2), ("z", "10.0.0.1", 3)], "username string, ip string, place long")
    key = lambda df: {r.User: r["count"] for r in df.groupBy("User").count().collect()}
    assert key(catalog.with_user(rows, users, True)) == key(catalog.with_user(rows, users)) and "z/y" in key(catalog.with_user(rows, users, True))


def test_frequent_keys_take_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = made(spark)
    found = joins.frequent(rows.mapInArrow(through, rows.schema), ("dst",), 20)
    assert sorted(found) == sorted(joins.frequent(rows, ("dst",), 20)) and seen.value == 40_000


def test_enriched_rows_are_compiled(spark):
    """Packets of the view and their masks make one method that the JVM would never compile: it runs by operators instead."""
    from flowrhythm.operators.enrich import METHOD_BYTES, enrich
    from flowrhythm.sources.views import packets

    enrich(packets(spark, "/root/testdata/sf0.001"))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= METHOD_BYTES
