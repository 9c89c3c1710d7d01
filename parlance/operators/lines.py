"""Rows of a key as a line in order: what stands beside a row, and sums and extremes up to it, for keys of any length.

While no key has more than `HOT` rows (counted first) these are plain windows. Beyond that a key's rows are numbered in parts, dealt into stretches of `STRETCH` places, and
worked out stretch by stretch: neighbours come from a rim of rows that both stretches get, running values from those within the stretch and those of all stretches
before it, which are few. The rows are the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.sequences import numbered
from parlance.tables import materialize

#: Rows of one key that one task may hold, and places of a stretch.
HOT = 1_000_000
STRETCH = 100_000


def largest(rows: DataFrame, keys: list[str]) -> int:
    """Rows of the commonest key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


class Line:
    """rows by keys in order. The columns _i (place from 0) and _b come along; done() takes them off. most: rows that a key may have, if the caller knows a bound."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], places: bool = False, most: int | None = None):
        self.keys = keys
        self.hot = (largest(rows, keys) if most is None else most) > HOT
        if self.hot:
            self.rows = materialize(numbered(rows, keys, order).drop("_n").withColumn("_b", F.floor(F.col("_i") / STRETCH)), "line")
            self.window = Window.partitionBy(*keys, "_b").orderBy("_i")
        else:
            self.window = Window.partitionBy(*keys).orderBy(*order)
            self.rows = rows.withColumn("_i", F.row_number().over(self.window) - 1) if places else rows

    def beside(self, df: DataFrame, **columns: tuple[Column, int]) -> DataFrame:
        """df with each name the value of its column so many rows before (after, if negative); null where there is no row."""
        if not self.hot:
            return df.withColumns({name: F.lag(c, n).over(self.window) for name, (c, n) in columns.items()})
        rim = max(abs(n) for _, n in columns.values())
        home, start = F.col("_b"), F.col("_b") * STRETCH
        before, after = F.when((F.col("_i") - start < rim) & (home > 0), home - 1), F.when(start + STRETCH - F.col("_i") <= rim, home + 1)
        wide = df.withColumn("_home", home).withColumn("_b", F.explode(F.filter(F.array(home, before, after), lambda b: b.isNotNull())))
        return wide.withColumns({name: F.lag(c, n).over(self.window) for name, (c, n) in columns.items()}).where("_b = _home").drop("_home")

    def running(self, df: DataFrame, name: str, value: Column, how: str, own: bool = True) -> DataFrame:
        """df with the sum, max or min of value over all rows up to this one (without it, unless own)."""
        f = {"sum": F.sum, "max": F.max, "min": F.min}[how]
        frame = self.window.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        if not self.hot:
            return df.withColumn(name, f(value).over(frame))
        key = [*self.keys, "_b"]
        inside = df.withColumn("_v", value).withColumn("_w", f("_v").over(frame))
        stretches = inside.groupBy(*key).agg(f("_v").alias("_s"))
        stretches = stretches.withColumn("_before", f("_s").over(Window.partitionBy(*self.keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_s")
        same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in key]
        both = inside.alias("x").join(stretches.alias("y"), same).select("x.*", "y._before")
        w, b = F.col("_w"), F.col("_before")
        if how == "sum":
            joined = w + b
        else:  # structs too
            joined = F.when(w >= b if how == "max" else w <= b, w).otherwise(b)
        return both.withColumn(name, F.when(w.isNull(), b).when(b.isNull(), w).otherwise(joined)).drop("_v", "_w", "_before")

    def done(self, df: DataFrame) -> DataFrame:
        return df.drop("_i", "_b")
