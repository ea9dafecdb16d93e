"""Centroid clustering with an incremental matrix of exact products.

A vector's squared distance to a centroid is |x|^2 - 2 x.c + |c|^2. The products x.c of
every vector with every centroid are whole numbers, kept in a table from round to round.
When a centroid moves, only its components that changed count: their differences times
the vector's components are added to the product, and the nearest centroid is chosen
anew from the products. Nothing is ever computed twice or rounded.

Rounds read one table of the shared folder and write the other of two, so that a round
that loses executors repeats its own tasks only, and disk holds two tables at most.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrhythm.llm.common import bounded, materialise, shared_dir

K, ROUNDS, DIM, SEED = 40, 5, 64, 2
SCALE = 256
#: Components up to this have distances and products that a long holds; beyond it, whole numbers go as text.
NARROW = 1 << 26
MOST = (1 << 63) - 1
_STATE = {False: "array<long>", True: "array<string>"}


def whole(v: np.ndarray) -> list[int]:
    """Components times SCALE, rounded down, without error."""
    return [int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(SCALE * x) for x in v.tolist()]


def _ints(column: pa.Array, wide: bool) -> np.ndarray:
    """A row for each list: longs, or Python integers from their text."""
    flat = column.flatten()
    own = np.array([int(x) for x in flat.to_pylist()], object) if wide else flat.to_numpy(zero_copy_only=False)
    return own.reshape(len(column), -1)


def _lists(x: np.ndarray, wide: bool) -> pa.Array:
    flat = pa.array([str(v) for v in x.ravel()], pa.string()) if wide else pa.array(x.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0)), flat)


def moved(products: np.ndarray, x: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The products after centroids changed by these vectors, a row for each: only nonzero components take part."""
    out = products.copy()
    for c in np.flatnonzero((change != 0).any(1)):
        at = np.flatnonzero(change[c] != 0)
        out[:, c] += x[:, at] @ change[c, at]
    return out


def nearest(products: np.ndarray, square: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the number of its nearest centroid, the smaller one of equals, and the squared distance."""
    far = square[:, None] - 2 * products + (centroids * centroids).sum(1)[None, :]
    at = far.argmin(1)
    return at, far[np.arange(len(at)), at]


def kept(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """(vec_id, v): the vectors of exactly dim components, none of them null or non-finite, as doubles."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) == dim) & ~bad).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))


def _whole_numbers(rows: DataFrame, wide: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy().reshape(len(b), -1) if len(b) else np.zeros((0, DIM))
            x = np.array([whole(r) for r in v], object).reshape(v.shape) if wide else np.floor(SCALE * v).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _lists(x, wide)], names=["vec_id", "x"])

    return rows.mapInArrow(run, f"vec_id long, x {_STATE[wide]}")


def _round(state: DataFrame, change: np.ndarray, centroids: np.ndarray, wide: bool) -> DataFrame:
    """The state after a change of centroids: x, products, nearest centroid, distance."""
    kind = _STATE[wide]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _ints(b.column("x"), wide)
            dots = _ints(b.column("dots"), wide) if "dots" in b.schema.names else np.zeros((len(x), len(centroids)), x.dtype)
            dots = moved(dots, x, change) if len(x) else dots
            at, far = nearest(dots, (x * x).sum(1), centroids) if len(x) else (np.zeros(0, int), np.zeros(0, np.int64))
            far = pa.array([min(int(d), MOST) for d in far], pa.int64()) if wide else pa.array(far)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), _lists(dots, wide), pa.array(at.astype(np.int32)), far], names=["vec_id", "x", "dots", "cluster", "distance"])

    return state.mapInArrow(run, f"vec_id long, x {kind}, dots {kind}, cluster int, distance long")


def _sums(state: DataFrame, k: int, dim: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Number of vectors and sum of their components, for each cluster; a task hands on k rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for b in batches:
            at, x = b.column("cluster").to_numpy(), _ints(b.column("x"), wide)
            n += np.bincount(at, minlength=k)
            for c in np.unique(at):
                total[c] += x[at == c].sum(0)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full]), _lists(total[full], True)], names=["cluster", "n", "total"])

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, n long, total array<string>")
    counts, total = np.zeros(k, object), np.zeros((k, dim), object)
    # one place of one cluster is a few rows for each task; k * dim rows reach the driver
    pairs = parts.select("cluster", "n", F.posexplode("total").alias("place", "part"))
    if wide:  # sums of any length: their decimal digits in limbs of 15, each of which a decimal sums up
        found = _limbs(pairs)
    else:
        found = [(r.cluster, r.place, r.n, int(r.total)) for r in pairs.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()]
    for c, p, n, s in found:
        counts[c], total[c, p] = n, s
    return counts, total


def _limbs(pairs: DataFrame) -> list[tuple[int, int, int, int]]:
    """Sums of whole numbers written as text, by limbs of 15 digits."""
    negative = F.col("part").startswith("-")
    digits = F.ltrim(F.col("part"), F.lit("-"))
    digits = F.lpad(digits, (F.ceil(F.length(digits) / 15) * 15).cast("int"), F.lit("0"))
    limb = F.transform(F.sequence(F.lit(1), (F.length(digits) / 15).cast("int")), lambda i: F.substring(digits, F.length(digits) - i * 15 + 1, F.lit(15)).cast("decimal(38,0)"))
    cut = pairs.select("cluster", "place", "n", F.when(negative, -1).otherwise(1).alias("sign"), F.posexplode(limb).alias("limb", "value"))
    rows = cut.groupBy("cluster", "place", "limb").agg(F.sum(F.when(F.col("limb") == 0, F.col("n"))).alias("n"), F.sum(F.col("sign") * F.col("value")).alias("value")).collect()
    out: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        own = out.setdefault((r.cluster, r.place), [0, 0])
        own[0] += r.n or 0
        own[1] += int(r.value) * 10 ** (15 * r.limb)
    return [(c, p, n, s) for (c, p), (n, s) in out.items()]


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): where each vector belongs after the last round.

    Vectors are whole numbers floor(256 * x). Centroids start as the k vectors of least sha256 of
    `seed:vec_id`, those without an id last and equal ids by their components; fewer than k vectors are
    as many centroids. A round assigns all vectors, ties to the smaller number, and replaces each
    centroid that has some by the floor of their mean; an empty one stays. Sums are exact at any
    size; only a distance or inertia beyond a long's range is cut to its end. A row whose vector is
    null, has another number of components or one that is null or not finite is no vector and has no row
    here; one whose id is null has. Repeated rows count each, columns other than the two named play no
    part, and an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, vec_id, vector, dim)
    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()[0] or 0.0
    wide = most * SCALE >= NARROW
    rows = materialise(_whole_numbers(bounded(rows), wide), "vectors")
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([[int(c) for c in r.x] for r in first], object).reshape(len(first), dim)
    n, folder = len(first), shared_dir(spark)
    if not wide:
        centroids = centroids.astype(np.int64)
    change, state = centroids, rows
    for r in range(rounds + 1 if n else 0):
        path = f"{folder}/products-{r % 2}"
        new = _round(state, change, centroids, wide)
        new.write.mode("overwrite").parquet(path)
        state = spark.read.schema(new.schema).parquet(path)
        if r < rounds:
            counts, total = _sums(state, n, dim, wide)
            moved_to = centroids.copy()
            for c in np.flatnonzero(counts):
                moved_to[c] = [int(s) // int(counts[c]) for s in total[c]]
            change, centroids = moved_to - centroids, moved_to
    if not n:
        state = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    # k rows at most
    inertia = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    every = min(sum(inertia.values()), MOST)
    told = [(c, min(inertia.get(c, 0), MOST), every, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> str:
    """The rounds one after another: assign, then take the floor of each component's mean."""
    steps = [
        f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST({SCALE} AS DOUBLE) * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(n - 1 AS INTEGER) AS cluster, e AS c FROM (
    SELECT e, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) AS n FROM v) WHERE n <= {k}
)"""
    ]
    far = "list_sum(list_transform(list_zip(v.e, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT i, vec_id, e, cluster, d FROM (
    SELECT v.i, v.vec_id, v.e, c.cluster, CAST({far} AS BIGINT) AS d, row_number() OVER (PARTITION BY v.i ORDER BY {far}, c.cluster) AS n FROM v, c{r} c) WHERE n = 1
)""")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (
  SELECT cluster, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, unnest(range(1, {dim + 1})) AS place FROM a{r}) GROUP BY ALL
), m{r} AS MATERIALIZED (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY place) AS m FROM s{r} GROUP BY cluster
), c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.m, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster
)""")
    return ", ".join(steps) + f"""
SELECT a.vec_id, a.cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""


SQL = _sql()
