"""Centroid clustering in whole numbers: Lloyd's rounds in which norms of segments screen the centroids of each vector.

A vector's components become integers floor(scale * x). Its compressed form is a code of 7 bits a component (the component shifted by a number of bits that the
vector shares) and the norm of what the codes leave out, for each of `SEGMENTS` runs of components, rounded up. For a vector x with codes y, shift s and rest r, and
a centroid c, the product r c is at most the sum of |r_i| |c_i| over the segments (Cauchy-Schwarz), so
|x|^2 + |c|^2 - 2 (2^s y c + sum_i |r_i| |c_i|) is at most their squared distance. Centroids are taken in the order of that bound, and one whose bound exceeds the best distance
so far (or equals it under a larger number) is out, with all that follow; only the others get an exact distance, in integers. (Norms of whole segments without codes
screen next to nothing where components have mixed signs: 7.8 to 8 of 8 centroids were left on the test tables.)

The vectors' integers and compressed forms are computed once and written to the shared folder; each round is one pass over that table. A task
adds up its vectors by cluster, and Spark adds up the tasks' sums (by cluster, component and 32-bit limb), so k x components numbers reach the driver, however
many vectors there are, and no cluster meets in one task, however large it is. Components of 2^26 and more, of vectors or centroids, are worked out in Python's unbounded integers
by the same code.

Defined cases: vectors that are null, of another size, or hold null or non-finite components are left out; a null vec_id draws as the empty string would; vectors
whose ids draw alike start in the order of their components; with fewer vectors than k there are as many centroids as vectors; repeated
rows are vectors of their own; distances and sums that no long can hold are null; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialize

SEGMENTS = 16
#: Below this, squared distances of 64 components and sums of norms' products fit in 64 bits with room to spare.
NARROW = 1 << 26
_LONG = (1 << 63) - 1


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: int64, or Python's integers if one is wide."""
    if not x.size or np.abs(x).max() < NARROW / scale:
        return np.floor(scale * x).astype(np.int64)
    return np.frompyfunc(lambda v: math.floor(Fraction(v) * scale), 1, 1)(x).astype(object)


_root_up = np.frompyfunc(lambda s: math.isqrt(s - 1) + 1 if s > 0 else 0, 1, 1)


def segment_norms(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Norm of each segment of integer rows, rounded up."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)[:-1]
    squares = np.add.reduceat(x * x, cuts, axis=1)
    if x.dtype == object:
        return _root_up(squares).astype(object)
    norms = np.ceil(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    return norms + (norms * norms < squares)


def compress(x: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, shift, norms of the rests' segments, squared length) of integer rows: x = (codes << shift) + rest."""
    most = np.abs(x).max(axis=1, initial=0)
    bits = np.array([int(m).bit_length() for m in most]) if x.dtype == object else np.frexp(most.astype(np.float64))[1]
    shift = np.maximum(bits - 6, 0).astype(x.dtype)[:, None]
    half = (1 << shift) >> 1
    codes = (x + half) >> shift
    return codes, shift, segment_norms(x - (codes << shift), segments), (x * x).sum(1)


def bounds(codes: np.ndarray, shift: np.ndarray, norms: np.ndarray, square: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """A lower bound of the squared distance of each compressed row to each centroid."""
    c_norms, c_square = segment_norms(centroids, norms.shape[1]), (centroids * centroids).sum(1)
    if codes.dtype == object:
        return square[:, None] + c_square - 2 * (((codes @ centroids.T) << shift) + norms @ c_norms.T)
    product = lambda a, b: (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)  # noqa: E731  all sums are below 2^53, so exact
    return square[:, None] + c_square - 2 * ((product(codes, centroids) << shift) + product(norms, c_norms))


def nearest(x: np.ndarray, packed: tuple, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance, exact distances computed) of each row; ties go to the smaller number. packed: of compress()."""
    if x.dtype == object or centroids.dtype == object:
        x, centroids, *packed = (a.astype(object) for a in (x, centroids, *packed))
    bound = bounds(*packed, centroids)
    order = np.argsort(bound, axis=1, kind="stable")

    def exact(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = x[rows] - centroids[c]
        return (d * d).sum(1)

    rows = np.arange(len(x))
    who = order[:, 0].copy()
    best = exact(rows, who)
    tried = np.ones(len(x), np.int64)
    for j in range(1, len(centroids)):
        c = order[rows, j]
        low = bound[rows, c]
        left = (low < best[rows]) | ((low == best[rows]) & (c < who[rows]))
        rows, c = rows[left], c[left]  # bounds only grow from here on: a row that is out stays out
        if not len(rows):
            break
        d = exact(rows, c)
        tried[rows] += 1
        better = (d < best[rows]) | ((d == best[rows]) & (c < who[rows]))
        who[rows[better]], best[rows[better]] = c[better], d[better]
    return who, best, tried


def _limbs(v: int) -> Iterator[tuple[int, int]]:
    sign, v, k = (-1 if v < 0 else 1), abs(v), 0
    while v:
        yield k, sign * (v & 0xFFFFFFFF)
        v, k = v >> 32, k + 1


def _compress(scale: int, size: int, segments: int):
    """Batches of (vec_id, array<double>) to (vec_id, integers, norms, square), wide rows as text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, size)
            fits = np.abs(x).max(axis=1, initial=0) < NARROW / scale
            for narrow, rows in ((True, np.flatnonzero(fits)), (False, np.flatnonzero(~fits))):
                if not len(rows):
                    continue
                ids = b.column("vec_id").take(pa.array(rows))
                v = whole(x[rows], scale)
                if narrow:
                    codes, shift, norms, square = compress(v, segments)
                    cells = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (v.astype("<i4"), codes.astype("i1"), norms.astype("<i4"))]
                    yield pa.RecordBatch.from_arrays([ids, *cells, pa.array(shift[:, 0], pa.int64()), pa.array(square, pa.int64()), pa.nulls(len(rows), pa.string())], _TABLE)
                else:
                    text = [",".join(map(str, r)) for r in v]
                    yield pa.RecordBatch.from_arrays([ids, *(pa.nulls(len(rows), k) for k in 3 * [pa.binary()] + 2 * [pa.int64()]), pa.array(text, pa.string())], _TABLE)

    return run


_TABLE = ["vec_id", "v", "codes", "norms", "shift", "square", "wide"]


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, tuple]]:
    """(vec_ids, integers, compressed form) of the narrow and the wide rows of a batch of the table."""
    is_wide = np.array(b.column("wide").is_valid())
    for wide in (False, True):
        rows = np.flatnonzero(is_wide == wide)
        if not len(rows):
            continue
        part = b.take(pa.array(rows)) if is_wide.any() else b
        if wide:
            x = np.array([list(map(int, t.split(","))) for t in part.column("wide").to_pylist()], dtype=object)
            yield part.column("vec_id"), x, compress(x)
        else:
            x, codes, norms = (np.frombuffer(b"".join(part.column(k).to_pylist()), kind).reshape(len(rows), -1).astype(np.int64) for k, kind in (("v", "<i4"), ("codes", "i1"), ("norms", "<i4")))
            yield part.column("vec_id"), x, (codes, part.column("shift").to_numpy()[:, None], norms, part.column("square").to_numpy())


def _sums(centroids: np.ndarray):
    """Per task: the sum of its vectors by cluster and component in limbs, and at component -1 their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        total, count = np.zeros((k, size), dtype=object), [0] * k
        for b in batches:
            for _, x, packed in _vectors(b):
                who, _, _ = nearest(x, packed, centroids)
                for c in np.unique(who):
                    mine = x[who == c]
                    total[c] += mine.sum(0).astype(object)
                    count[c] += len(mine)
        out = [(c, at, limb, v) for c in range(k) if count[c] for at, whole_sum in enumerate([*total[c], count[c]]) for limb, v in _limbs(int(whole_sum))]
        cells = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(a, kind) for a, kind in zip(cells, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c", "at", "limb", "v"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, packed in _vectors(b):
                who, best, tried = nearest(x, packed, centroids)
                far = [d if d <= _LONG else None for d in best.tolist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(who, pa.int32()), pa.array(far, pa.int64()), pa.array(tried, pa.int64())], ["vec_id", "cluster", "distance", "tried"])

    return run


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, segments: int = SEGMENTS) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, tried for every kept vector; the final centroids). tried: how many centroids got an exact distance."""
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.select("vec_id", x.alias("x")).where((F.size("x") == size) & ~odd)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = [r["x"] for r in kept.orderBy(draw, "x").limit(k).collect()]
    kind = vectors.select("vec_id").schema["vec_id"].dataType.simpleString()
    if not start:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, tried bigint"), []
    centroids = whole(np.array(start, np.float64), scale)
    table = materialize(kept.mapInArrow(_compress(scale, size, segments), f"vec_id {kind}, v binary, codes binary, norms binary, shift bigint, square bigint, wide string"), "vectors")
    for _ in range(rounds):
        sums: dict[tuple[int, int], int] = {}
        for c, at, limb, v in table.mapInArrow(_sums(centroids), "c int, at int, limb int, v bigint").groupBy("c", "at", "limb").agg(F.sum("v")).collect():
            sums[c, at] = sums.get((c, at), 0) + (v << 32 * limb)
        moved = [[sums.get((c, at), 0) // n for at in range(size)] if (n := sums.get((c, size))) else list(map(int, old)) for c, old in enumerate(centroids)]
        wide = any(abs(v) >= NARROW for row in moved for v in row)
        now = np.array(moved, dtype=object if wide else np.int64)
        same, centroids = bool((now == centroids).all()), now
        if same:  # no later round would change anything
            break
    found = table.mapInArrow(_assign(centroids), f"vec_id {kind}, cluster int, distance bigint, tried bigint")
    return materialize(found, "clusters"), [list(map(int, c)) for c in centroids]


def clustered(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, tried of every kept vector."""
    import hashlib

    found, centroids = cluster(vectors)
    spark = found.sparkSession
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(total.alias("d")).collect()}
    fits = lambda v: int(v) if v is not None and v <= _LONG else None
    inertia = fits(sum(sums.values())) if all(v is not None for v in sums.values()) else None
    rows = [(c, fits(sums[c]), inertia, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids) if c in sums]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")  # k rows at most
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "tried")
