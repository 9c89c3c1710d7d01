"""Centroid clustering: exact against plain Lloyd rounds in Python's integers, bounds that never exceed the distance, defined cases."""

import collections
import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from parlance.llm import centroids as C

KIND = "vec_id long, embedding array<double>, label int, v string, cluster int"


def plain_clusters(rows, k=8, rounds=10, size=64, scale=1024):
    """The contract, read off directly: a row per kept vector."""
    kept = [(i, x) for i, x in rows if x is not None and len(x) == size and all(y is not None and math.isfinite(y) for y in x)]
    draw = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    ints = lambda x: [math.floor(Fraction(y) * scale) for y in x]
    centre = [ints(x) for _, x in sorted(kept, key=draw)[:k]]
    points = [ints(x) for _, x in kept]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        own = [near(p)[1] for p in points]
        for j in range(len(centre)):
            mine = [p for p, o in zip(points, own, strict=True) if o == j]
            if mine:
                centre[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [near(p) for p in points]
    sums = collections.Counter()
    for d, j in last:
        sums[j] += d
    fits = lambda v: v if v < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    every = all(d < 2**63 for d, _ in last)
    whole_cluster = {j: all(d < 2**63 for d, o in last if o == j) for j in sums}
    return [(i, j, fits(d), fits(sums[j]) if whole_cluster[j] else None, fits(sum(sums.values())) if every else None, sha[j]) for (i, _), (d, j) in zip(kept, last, strict=True)]


def got(spark, rows):
    df = spark.createDataFrame([(i, x, 1, "clash", 9) for i, x in rows], KIND).repartition(3)
    return collections.Counter(tuple(r)[:6] for r in C.clustered(df).collect())


def made(n, seed, spread=1.0):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    return [(i, [spread * (a + r.gauss(0, 0.3)) for a in r.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize(("spread", "dtype"), [(1.0, np.int64), (1e-6, np.int64), (60_000.0, np.int64), (1e12, object), (1e-3, object)])
def test_bounds_and_nearest(spread, dtype):
    x = C.whole(np.array([v for _, v in made(300, 5, spread)]), 1024).astype(dtype)
    c = x[:8].copy()
    c[5] = c[2]  # a tie
    full = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
    assert (C.bounds(*C.compress(x), c) <= full).all()
    who, best, tried = C.nearest(x, C.compress(x), c)
    assert (who == full.argmin(1)).all() and (best == full.min(1)).all()
    assert tried.mean() < 4 or spread < 1e-5


def test_query_equals_plain_rounds(spark):
    from parlance.llm.queries import op13_centroids

    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = op13_centroids(spark, sf)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(plain_clusters(rows))


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [nan] + [1.0] * 63), (906, [-inf] + [1.0] * 63), (907, [0.0] * 64), (907, [-0.0] * 64), (None, [0.5] * 64), (None, [0.25] * 64)]
    hot = [(1000 + i, [0.1, -0.2] * 32) for i in range(60)] + [(5, [1.5] * 64)] * 7
    rows = made(80, 1) + odd + hot
    assert got(spark, rows) == collections.Counter(plain_clusters(rows))
    # ties: all vectors equal, so all but the first centroid are empty and stay
    same = [(i, [0.3] * 64) for i in range(20)]
    assert got(spark, same) == collections.Counter(plain_clusters(same))
    few = made(3, 2)
    assert got(spark, few) == collections.Counter(plain_clusters(few))
    assert got(spark, odd[:7]) == collections.Counter() and got(spark, []) == collections.Counter()


def test_wide_components(spark):
    rows = made(30, 3) + [(100 + i, [v * 10.0 ** (4 + i) for v in x]) for i, x in made(12, 4)] + [(200, [1e300] * 64), (201, [-1e300, 1e-300] * 32)]
    assert got(spark, rows) == collections.Counter(plain_clusters(rows))
