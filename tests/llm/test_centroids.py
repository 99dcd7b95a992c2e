"""Centroid clustering against plain loops over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from duoclass.llm.centroids import assign, centroid_digests, cluster_vectors, occurring

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def brute(rows, dims, k, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(256 * x) < 1 << 27 for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        new = []
        for j, c in enumerate(cents):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            new.append([sum(x) // len(own) for x in zip(*own)] if own else c)
        cents = new
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, a, d in out if a == j) for j in range(len(cents))]
    return sorted(((i, a, d, inertia[a], sum(inertia)) for i, a, d in out), key=str), cents


def rows_of(seed, n, dims, spread=1.0):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.gauss(0, spread))) for _ in range(dims)]) for i in range(n)]
    rows += [rows[0], rows[1], (None, rows[2][1]), (n, None), (n + 1, []), (n + 2, [1.0] * (dims - 1)), (n + 3, [None] + [1.0] * (dims - 1)),
             (n + 4, [float("nan")] * dims), (n + 5, [float("inf")] + [0.0] * (dims - 1)), (n + 6, [0.0] * dims), (n + 7, [3e38] * dims), (n, [0.5] * dims)]
    return rows


@pytest.mark.parametrize("dims,k,n,spread", [(3, 5, 200, 1.0), (64, 40, 300, 0.1), (4, 40, 10, 900.0), (2, 7, 400, 0.01)])
def test_equals_brute_force(spark, dims, k, n, spread):
    rows = rows_of(dims, n, dims, spread)
    want, cents = brute(rows, dims, k, 5)
    df = spark.createDataFrame([(*x, "own") for x in rows], SCHEMA).repartition(3)
    out, got = cluster_vectors(df, dims=dims, clusters=k)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    assert got.tolist() == cents
    assert centroid_digests(got)[0] == hashlib.sha256(",".join(map(str, cents[0])).encode()).hexdigest()


def test_empty_table(spark):
    out, cents = cluster_vectors(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and len(cents) == 0
    out, cents = cluster_vectors(spark.createDataFrame([(1, None, "x")], SCHEMA))
    assert out.count() == 0 and out.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia"]


def test_tables_of_wide_and_narrow_columns():
    r = np.random.default_rng(1)
    for high in (3, 500, 1 << 26):
        col = r.integers(-high, high, 700)
        values, place = occurring(col)
        assert (values[place] == col).all() and (np.diff(values) > 0).all() and set(values) == set(col.tolist())
    v, c = r.integers(-99, 99, (50, 8)), r.integers(-99, 99, (6, 8))
    d = ((v[:, None] - c[None]) ** 2).sum(2)
    best, dist = assign(v, c)
    assert (best == d.argmin(1)).all() and (dist == d.min(1)).all()
