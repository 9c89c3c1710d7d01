"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Values (vectors times their length) that a task turns into a matrix at once: 2 MB.
PART_VALUES = 1 << 18


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def unit(x: Column) -> Column:
    """x over its norm; null for a zero vector."""
    # the norm is handed on as an element, or it would be worked out again for every component
    return F.transform(F.array(norm(x)), lambda n: F.when(n > 0, F.transform(x, lambda v: v / n)))[0]


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def vector_parts(vectors):
    """(at, part, x) for short runs of an Arrow column of vectors of one length: where a run begins, the run, and those of it that aren't null as the rows of a matrix of doubles.

    A task then holds an Arrow batch and a few runs' matrices, however wide the vectors are.
    """
    import pyarrow.compute as pc

    ends = pc.min_max(pc.list_value_length(vectors)).as_py()
    if ends["min"] != ends["max"]:
        raise ValueError(f"vectors of {ends['min']} and of {ends['max']} components")
    width = ends["max"] or 0
    step = max(1, PART_VALUES // max(width, 1))
    for at in range(0, len(vectors), step):
        part = vectors.slice(at, step)
        yield at, part, part.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(part) - part.null_count, width)


def mean_vectors(rows: DataFrame, keys: list[str], vector: str, out: str = "centroid", as_unit: bool = True, held: int = 4096) -> DataFrame:
    """Mean vector per key, made a unit vector unless told otherwise: tasks add up whole vectors, so a key's vectors never meet in one place.

    A task holds the sums of at most `held` keys and hands them on beyond that. Vectors of a key that differ in length are averaged component by component, each over those that have it.
    """
    import numpy as np

    kind = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def add(batches):
        import pandas as pd

        sums: dict = {}

        def told():
            table = pd.DataFrame([(*k[:-1], n, v.tolist()) for k, (n, v) in sums.items()], columns=[*keys, "n", "v"])
            for k in keys:
                if pd.api.types.is_float_dtype(table[k]) and table[k].isna().any():
                    table[k] = table[k].astype(object).where(table[k].notna(), None)
            return table

        for b in batches:
            b = b[b["_v"].notna()]
            lengths = b["_v"].map(len)
            for key, part in b.groupby([*(b[k] for k in keys), lengths], dropna=False, sort=False):
                key = tuple(None if x is None or x != x else x for x in key)
                x = np.stack(part["_v"].to_numpy())
                n, v = sums.get(key, (0, 0.0))
                sums[key] = n + len(x), v + x.sum(0)
            if len(sums) > held:
                yield told()
                sums.clear()
        if sums:
            yield told()

    parts = rows.select(*keys, doubles(F.col(vector)).alias("_v")).mapInPandas(add, f"{kind}, n long, v array<double>")
    by = parts.select(*keys, "n", F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    whole = by.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(out))
    return whole.withColumn(out, F.coalesce(unit(F.col(out)), F.col(out))) if as_unit else whole
