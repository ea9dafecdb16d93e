"""Centroid clustering against a plain restatement in Python integers."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

from flowrhythm.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, cluster string, x int, dots int"


def plain(rows, k, rounds, dim, seed=2):
    own = [(i, [math.floor(Fraction(c) * 256) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(x) for _, x in order[:k]]

    def assign():
        out = []
        for i, x in own:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in cents]
            out.append((i, x, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(cents)):
            mine = [x for _, x, at, _ in found if at == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine)]
    found, most = assign(), (1 << 63) - 1
    cut = lambda d: min(d, most)
    by = {c: sum(cut(d) for _, _, at, d in found if at == c) for c in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, at, cut(d), cut(by[at]), cut(sum(by.values())), sha[at]) for i, _, at, d in found), key=str)


def run(spark, rows, k, rounds, dim):
    docs = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, C.clusters(docs, k, rounds, dim).collect()), key=str)


def test_rounds_equal_plain_ones(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(m, 0.1) for m in r.choice(((0, 1, 0, -1), (1, 0, 0, 2), (-1, -1, 3, 0)))]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, [0.5, 0.5, 0.5, 0.5]), (400, None), (401, [1.0, None, 1.0, 1.0]), (402, [1.0, float("nan"), 1.0, 1.0]), (403, [float("inf")] * 4), (404, [1.0] * 3)]
    rows += [(i, [0.25, 0.25, -0.25, 0.0]) for i in range(500, 600)]  # a hot vector
    assert run(spark, rows, 12, 4, 4) == plain(rows, 12, 4, 4)


def test_ties_and_empty_centroids(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(60)]  # equal starting centroids: all but the first get nothing
    assert run(spark, rows, 10, 3, 2) == plain(rows, 10, 3, 2)


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [1.0, 2.0]), (2, [-1.0, 0.125])]
    assert run(spark, rows, 40, 2, 2) == plain(rows, 40, 2, 2)


def test_components_of_any_size(spark):
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) * 10 ** r.randint(-3, 300), r.uniform(-1, 1), r.choice((1e308, -1e308, 0.0))]) for i in range(40)]
    assert run(spark, rows, 6, 3, 3) == plain(rows, 6, 3, 3)


def test_no_vectors(spark):
    assert run(spark, [], 4, 2, 2) == []
    assert run(spark, [(1, None), (2, [])], 4, 2, 2) == []
