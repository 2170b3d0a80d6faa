"""Column expressions on text: cleaning, keys, parsing. Every one stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for a missing value.
NULL_TOKENS = ["", "nan", "none", "null", "unknown", "n/a"]


def coerce_number(c: Column, default: float | None = None) -> Column:
    """Null tokens and text that is no number become the default."""
    clean = F.when(F.lower(F.trim(c)).isin(NULL_TOKENS), None).otherwise(F.trim(c))
    number = clean.try_cast("double")
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def sentences(c: Column) -> Column:
    """Split after runs of . ! ? that white space follows."""
    marked = F.regexp_replace(c, r"([.!?]+)\s+", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda s: F.trim(s)), lambda s: s != "")
