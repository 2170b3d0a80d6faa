"""Roll-ups, profiles, duplicates, outliers, samples and tests as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import group_quantiles, quantile_row


def weighted_rollup(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Per key: rows, sum of weights, weighted mean (null without weight), median, largest value."""
    return rows.groupBy(key).agg(
        F.count("*").alias("n_rows"), F.sum(weight).alias("weight_sum"),
        F.round(F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0)), 4).alias("weighted_mean"),
        F.round(F.median(value), 4).alias("median_value"), F.max(value).alias("max_value"),
    )


def ranked(rows: DataFrame, partition: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def first_by(rows: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    return ranked(rows, partition, order, "__rn").filter("__rn = 1").drop("__rn")


def value_counts(rows: DataFrame, key: str) -> DataFrame:
    """Counts of values and their share in percent. The total is one broadcast row."""
    counts = rows.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("value", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("pct"))


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, share, distinct values and severity of each column: values are counted in the map tasks, then the counts."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    counts = rows.select(each).select("x.*").groupBy("column_name", "value").agg(F.count("*").alias("m"))
    one = counts.groupBy("column_name").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("m"))), F.lit(0)).alias("n_null"), F.count("value").alias("n_distinct"), F.sum("m").alias("n"))
    share = F.col("n_null") * 100.0 / F.col("n")
    severity = F.when(share < 1, "minimal").when(share < 10, "moderate").when(share < 50, "significant").otherwise("extensive")
    return one.select("column_name", "n_null", "n_distinct", F.round(share, 2).alias("pct_null"), severity.alias("severity"))


def outliers(rows: DataFrame, column: str, z: float = 3.0, fence: float = 1.5) -> DataFrame:
    """Rows with flags for |z|, quartile fences and P1-P99, and their union. Bounds are one broadcast row."""
    bounds = rows.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s")).join(F.broadcast(quantile_row(rows, column, [0.25, 0.75, 0.01, 0.99], "__q")))
    x, iqr = F.col(column), F.col("__q1") - F.col("__q0")
    flags = rows.join(F.broadcast(bounds)).withColumn("by_z", F.abs((x - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))) > z)
    flags = flags.withColumn("by_iqr", (x < F.col("__q0") - fence * iqr) | (x > F.col("__q1") + fence * iqr)).withColumn("by_pct", (x < F.col("__q2")) | (x > F.col("__q3")))
    return flags.withColumn("by_any", F.col("by_z") | F.col("by_iqr") | F.col("by_pct")).drop("__m", "__s", "__q0", "__q1", "__q2", "__q3")


def box(rows: DataFrame, group: str, value: str, fence: float = 1.5) -> DataFrame:
    """Per group: count, quartiles, whiskers (the outermost values within the fences) and values beyond them."""
    edges = group_quantiles(rows, [group], value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - fence * iqr, F.col("q3") + fence * iqr)
    kept = F.when(inside, F.col(value))
    out = rows.join(edges, group).groupBy(group).agg(F.count("*").alias("n"), F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("q3").alias("q3"), F.min(kept).alias("low"), F.max(kept).alias("high"), F.count_if(~inside).alias("beyond"))
    return out.select(group, "n", *(F.round(c, 4).alias(c) for c in ("q1", "q2", "q3", "low", "high")), "beyond")


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (from 0), low, high, n: bins of equal width between the least and the greatest value, the last one closed. Empty bins aren't there."""
    edges = rows.agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("a")) / width), F.lit(bins - 1).cast("long"))).otherwise(0)
    counts = rows.filter(F.col(value).isNotNull()).join(F.broadcast(edges)).groupBy(place.alias("bin"), "a", "b").agg(F.count("*").alias("n"))
    return counts.select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), "n")


def log_histogram(rows: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """bin, low, high, n, density (share of all by width) over positive values: edges are evenly spaced in logarithms."""
    logs = rows.filter(F.col(value) > 0).select(F.log10(value).alias("x"))
    counts = histogram(logs, "x", bins)
    total = counts.agg(F.sum("n").alias("total"))
    low, high = F.pow(F.lit(10.0), F.col("low")), F.pow(F.lit(10.0), F.col("high"))
    return counts.join(F.broadcast(total)).select("bin", low.alias("low"), high.alias("high"), "n", (F.col("n") / F.col("total") / (high - low)).alias("density"))
