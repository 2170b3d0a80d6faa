"""Fixed, decade and quantile bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import quantile_row


def fixed_bins(c: Column, edges: list[float], names: list[str]) -> Column:
    """Right-closed bins, the lowest edge included; the last edge may be infinite. Outside: null."""
    out = None
    for low, high, name, first in zip(edges, edges[1:], names, [True] + [False] * len(names)):
        inside = ((c >= low) if first else (c > low)) & ((c <= high) if high != float("inf") else F.lit(True))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("long")


def quantiles(df: DataFrame, column: str, shares: list[float], prefix: str = "q") -> DataFrame:
    """One row of exact linear quantiles."""
    return quantile_row(df, column, shares, prefix)


def with_quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Rows beside the quantiles q0, q1, ... of a column (one broadcast row)."""
    return df.join(F.broadcast(quantiles(df, column, shares)))


def quantile_bins(df: DataFrame, column: str, names: list[str], out: str) -> DataFrame:
    """df with the name of each value's bin of equal shares, right-closed; null for all where two edges are equal, as no bins can be told apart then."""
    k = len(names)
    edges = quantile_row(df, column, [i / k for i in range(k + 1)], "__e")
    distinct = reduce(lambda x, y: x & y, (F.col(f"__e{i}") < F.col(f"__e{i + 1}") for i in range(k)))
    named = F.coalesce(*(F.when(F.col(column) <= F.col(f"__e{i + 1}"), name) for i, name in enumerate(names)))
    return df.join(F.broadcast(edges)).withColumn(out, F.when(distinct, named)).drop(*(f"__e{i}" for i in range(k + 1)))


def tiers(df: DataFrame, column: str, out: str, names: tuple[str, str, str] = ("thrash", "mid", "top")) -> DataFrame:
    """df with the first name below the first quartile, the last above the third, else the middle one; null stays null."""
    x, (low, mid, top) = F.col(column), names
    edges = quantile_row(df, column, [0.25, 0.75], "__e")
    named = F.when(x.isNull(), None).when(x < F.col("__e0"), low).when(x > F.col("__e1"), top).otherwise(mid)
    return df.join(F.broadcast(edges)).withColumn(out, named).drop("__e0", "__e1")
