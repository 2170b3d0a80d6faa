"""Exact linear quantiles without a buffer of all distinct values.

A mergeable sketch of fixed size gives, for each share, two values between which the exact one must lie. Rows beside the band are only counted, in the map
tasks; of rows between, values are counted and ordered. So a task orders the distinct values of a share's band, some BAND of a group's, and nothing
grows with the rest. Shares of a group of few rows have a band of all its values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Half the width of a band in shares of the rows, and the sketch's accuracy, whose error is half of that.
BAND, ACCURACY = 0.002, 1000


def melted(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """by, column_name, value: one row for each value that isn't null."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")
    return df.select(*by, each).select(*by, "x.*").filter("value is not null and not isnan(value)")


def quantiles(df: DataFrame, columns: list[str], shares: list[float], by: list[str] = ()) -> DataFrame:
    """by, column_name, q0, q1, ...: the shares' quantiles, interpolated, of values that aren't null; no row for a group without any."""
    by, rows = list(by), melted(df, columns, by)
    keys = [*by, "column_name"]
    edge = lambda d: F.array(*(F.lit(min(1.0, max(0.0, s + d))) for s in shares))
    sketch = lambda d: F.percentile_approx("value", edge(d), ACCURACY)
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), sketch(-BAND).alias("low"), sketch(BAND).alias("high"))
    each = F.transform(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: F.struct(i.alias("i"), F.get("low", i).alias("low"), F.get("high", i).alias("high")))
    bands = found.select(*(F.col(k).alias(f"__{k}") for k in keys), "n", each.alias("bands"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    # One row for each column where there are no groups; groups meet their rows by a keyed join.
    met = rows.join(bands if by else F.broadcast(bands), same)
    each = met.select(*keys, "n", "value", F.explode("bands").alias("b"))
    side = F.when(F.col("value") < F.col("b.low"), -1).when(F.col("value") > F.col("b.high"), 1).otherwise(0)
    # Beside a band only the count and the value next to it are kept: a rank may lie between a band's end and that value.
    placed = each.select(*keys, "n", "value", F.col("b.i").alias("i"), side.alias("side"), F.when(side == 0, F.col("value")).alias("own"))
    counts = placed.groupBy(*keys, "n", "i", "side", "own").agg(F.count("*").alias("m"), F.when(F.col("side") < 0, F.max("value")).otherwise(F.min("value")).alias("value"))
    order = Window.partitionBy(*keys, "n", "i").orderBy("side", "own")
    upto = counts.withColumn("upto", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.element_at(F.array(*(F.lit(float(s)) for s in shares)), F.col("i") + 1) * (F.col("n") - 1)
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("value")))
    picked = upto.withColumn("rank", rank).groupBy(*keys, "i", "rank").agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    return picked.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, value)).alias(f"q{i}") for i in range(len(shares))))


def quantile_row(df: DataFrame, column: str, shares: list[float], prefix: str = "q") -> DataFrame:
    """One row of quantiles, nulls of a column without values."""
    got = quantiles(df, [column], shares)
    return got.agg(*(F.max(f"q{i}").alias(f"{prefix}{i}") for i in range(len(shares))))


def group_quantiles(df: DataFrame, by: list[str], column: str, names: dict[str, float]) -> DataFrame:
    """by and a column for each named share, one row for each group that has values."""
    return quantiles(df, [column], list(names.values()), by).select(*by, *(F.col(f"q{i}").alias(n) for i, n in enumerate(names)))
