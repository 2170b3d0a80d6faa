"""Audits, gates and repairs of a table's quality. Results are long tables of a few rows; each reads its input once unless it says so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import clean as C
from .quantiles import quantiles

#: What to do about missing values of named columns.
STRATEGIES = {
    "series_id": "flag_for_analysis", "series_title": "flag_for_analysis", "series_works_count": "flag_for_analysis", "average_rating_weighted_mean": "exclude_from_analysis",
    "disambiguation_notes": "flag_for_investigation", "num_pages_median": "exclude_from_analysis", "description": "exclude_from_analysis",
}

#: Gates in percent, the component each looks at, the components' weights, certificates by least score.
GATES = {"completeness": (95.0, "step1_3"), "consistency": (90.0, "step4"), "integrity": (98.0, "step5"), "optimization": (95.0, "step5"), "overall": (90.0, None)}
WEIGHTS = {"step1_3": 0.4, "step4": 0.3, "step5": 0.3}
LEVELS = [(95, "Excellent", "Certified"), (85, "Good", "Certified"), (75, "Acceptable", "Conditionally Certified"), (0, "Needs Improvement", "Not Certified")]

#: Narrower types for the work table's columns.
NARROW = {"publication_year": "short", "work_id": "int", "author_id": "int", "ratings_count_sum": "int", "text_reviews_count_sum": "int", "author_ratings_count": "int", "num_pages_median": "float", "average_rating_weighted_mean": "float", "author_average_rating": "float"}


def metrics(df: DataFrame, /, **values: Column) -> DataFrame:
    """metric, value (double): a row for each aggregate, all computed in one pass."""
    one = df.agg(*(v.cast("double").alias(k) for k, v in values.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in values))).alias("x")).select("x.*")


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


# Columns


def column_check(df: DataFrame, required: list[str]) -> dict[str, list[str]]:
    """Names that are required and missing, and names that are there and not required."""
    return {"missing": [c for c in required if c not in df.columns], "extra": [c for c in df.columns if c not in required]}


def require(df: DataFrame, required: list[str]) -> DataFrame:
    """The table itself; ValueError where a column is missing."""
    if missing := column_check(df, required)["missing"]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def type_audit(rows: DataFrame, most: float = 0.5) -> DataFrame:
    """column_name, dtype, n_rows, n_distinct (by sketch), opportunity: text of few distinct values is a category; longs and doubles whose range allows it are narrower."""
    cols = rows.columns
    numeric = [f.name for f in rows.schema if isinstance(f.dataType, (T.LongType, T.IntegerType, T.DoubleType))]
    aggs = [F.count("*").alias("__n")] + [F.approx_count_distinct(c).alias(f"d_{c}") for c in cols] + [x for c in numeric for x in (F.min(c).cast("double").alias(f"l_{c}"), F.max(c).cast("double").alias(f"h_{c}"))]
    one = rows.agg(*aggs)

    def of(f) -> Column:
        kind, better = f.dataType.simpleString(), F.lit(None).cast("string")
        if kind == "string":
            better = F.when(F.col(f"d_{f.name}") / F.col("__n") < most, "category")
        elif kind in ("bigint", "int"):
            low, high = F.col(f"l_{f.name}"), F.col(f"h_{f.name}")
            better = F.when((low >= -(2**15)) & (high < 2**15), "smallint").when((low >= -(2**31)) & (high < 2**31) & F.lit(kind == "bigint"), "int")
        elif kind == "double":
            better = F.lit("float")
        return F.struct(F.lit(f.name).alias("column_name"), F.lit(kind).alias("dtype"), F.col("__n").alias("n_rows"), F.col(f"d_{f.name}").alias("n_distinct"), better.alias("opportunity"))

    return one.select(F.explode(F.array(*map(of, rows.schema))).alias("x")).select("x.*")


def narrowed(rows: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Columns cast to narrower types; a value that doesn't fit becomes null, see narrowing_report()."""
    types = types or NARROW
    return rows.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in rows.columns})


WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1}


def narrowing_report(rows: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """column_name, before, after, lost (values that don't fit), saved_bytes (by widths of the types)."""
    types = {c: t for c, t in (types or NARROW).items() if c in rows.columns}
    lost = {c: F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()) for c, t in types.items()}
    one = rows.agg(F.count("*").alias("__n"), *(v.alias(f"x_{c}") for c, v in lost.items()))
    before, short = dict(rows.dtypes), {"short": "smallint"}
    each = [F.struct(F.lit(c).alias("column_name"), F.lit(before[c]).alias("before"), F.lit(short.get(t, t)).alias("after"), F.col(f"x_{c}").alias("lost"), (F.col("__n") * (WIDTHS.get(before[c], 8) - WIDTHS[short.get(t, t)])).alias("saved_bytes")) for c, t in types.items()]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def range_checks(rows: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """column_name, low, high, n_outside: values outside a closed range; nulls aren't."""
    return metrics(rows, **{c: count_if(~F.col(c).between(*r)) for c, r in ranges.items()}).select(F.col("metric").alias("column_name"), *(F.element_at(F.create_map(*(F.lit(x) for c, r in ranges.items() for x in (c, float(r[k])))), F.col("metric")).alias(n) for k, n in enumerate(("low", "high"))), F.col("value").cast("long").alias("n_outside"))


# Missing values


def missingness(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_null, pct_null, n_blank (blank texts), severity (below 1, 10, 50 percent or more), strategy, most_missing (rank, from 1). Columns
    without nulls have neither severity nor strategy."""
    cols = columns or rows.columns
    text = {f.name for f in rows.schema if isinstance(f.dataType, T.StringType)}
    one = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols), *(count_if(F.trim(F.col(c)) == "").alias(f"b_{c}") for c in cols if c in text))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("n_null"), (F.col(f"b_{c}") if c in text else F.lit(0).cast("long")).alias("n_blank"), F.col("n")) for c in cols))).alias("x")
    out = one.select(each).select("x.*").withColumn("share", F.col("n_null") * 100.0 / F.col("n"))
    share = F.col("share")
    severity = F.when(share == 0, None).when(share < 1, "minimal").when(share < 10, "moderate").when(share < 50, "significant").otherwise("extensive")
    named = F.element_at(F.create_map(*(F.lit(x) for p in STRATEGIES.items() for x in p)), F.col("column_name"))
    strategy = F.when(share > 0, F.coalesce(named, F.when(share < 10, "flag_for_analysis").when(share < 50, "flag_for_investigation").otherwise("exclude_from_analysis")))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n_null"), "column_name"))  # one row a column
    return out.select("column_name", "n_null", F.round(share, 2).alias("pct_null"), "n_blank", severity.alias("severity"), strategy.alias("strategy"), rank.alias("most_missing"))


def missing_flags(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({f"{c}_missing_flag": F.col(c).isNull().cast("int") for c in columns})


def dropped_nulls(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without nulls in the columns, and (column_name, n_dropped): what each column takes of the rows that those before it leave."""
    left, counts = F.lit(True), {}
    for c in columns:
        counts[c] = F.count_if(left & F.col(c).isNull())
        left = left & F.col(c).isNotNull()
    return rows.na.drop(subset=columns), metrics(rows, **counts).select(F.col("metric").alias("column_name"), F.col("value").cast("long").alias("n_dropped"))


def completeness(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, complete_before, complete_after, gain, in percent of the rows of each."""
    of = lambda df, name: metrics(df, **{c: F.count(c) * 100.0 / F.count("*") for c in columns}).select(F.col("metric").alias("column_name"), F.round("value", 4).alias(name))
    both = of(before, "complete_before").join(of(after, "complete_after"), "column_name")
    return both.withColumn("gain", F.round(F.col("complete_after") - F.col("complete_before"), 4))


# Duplicates


def duplicate_groups(rows: DataFrame, keys: list[str], order: str, most: int = 20) -> DataFrame:
    """keys, n, first_row (least `order`), members (the `most` least, a preview) of keys that occur more than once; null keys are equal."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first_row")).filter("n > 1")
    shown = Window.partitionBy(*keys).orderBy(order)
    preview = rows.select(*keys, order).withColumn("__rn", F.row_number().over(shown)).filter(F.col("__rn") <= most).groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("members"))
    same = reduce(lambda a, b: a & b, (counts[k].eqNullSafe(preview[k]) for k in keys))
    return counts.join(preview, same).select(*(counts[k] for k in keys), "n", "first_row", "members")


def title_groups(rows: DataFrame, keys: list[str], year: str, series: str) -> DataFrame:
    """keys, n, kind, confidence, action of groups with one title and author: by the span of their years; unknown with fewer than two years; several series
    names are for review by hand."""
    span = F.max(year) - F.min(year)
    known = F.count(year) > 1
    kind = F.when(~known, "unknown").when(span <= 1, "same_edition").when(span <= 5, "reprint").otherwise("different_editions")
    sure = F.when(~known, "low").when(span <= 1, "high").otherwise("medium")
    action = F.when((F.min(series) != F.max(series)) | ~known, "manual_review").when(span <= 1, "keep_most_recent").when(span <= 5, "keep_original").otherwise("keep_all")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), kind.alias("kind"), sure.alias("confidence"), action.alias("action")).filter("n > 1")


def resolved(rows: DataFrame, exact: list[str], order: str, title: list[str], author: list[str]) -> DataFrame:
    """Without later rows (by `order`) of equal `exact` keys, with flags for rows whose title or author keys occur more than once among the rest. Flagged rows stay."""
    kept = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*exact).orderBy(order))).filter("__rn = 1").drop("__rn")
    more = lambda keys: (F.count("*").over(Window.partitionBy(*keys)) > 1).cast("int")
    return kept.withColumn("title_duplicate_flag", more(title)).withColumn("author_id_duplicate_flag", more(author))


def resolution_stats(before: DataFrame, after: DataFrame, exact: list[str]) -> DataFrame:
    """Rows before and after, what went, and the rows in excess of their keys that are left: 0 where the resolution holds."""
    b = metrics(before, rows_before=F.count("*"))
    keys = after.groupBy(*exact).agg(F.count("*").alias("n"), F.max("title_duplicate_flag").alias("t"))
    a = metrics(keys, rows_after=F.coalesce(F.sum("n"), F.lit(0)), duplicates_left=F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), flagged_keys=F.coalesce(F.sum("t"), F.lit(0)))
    return b.unionByName(a)


def surplus(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows beyond the first of each combination of keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


# Anomalies


def rating_anomalies(rows: DataFrame, rating: str, counts: list[str]) -> DataFrame:
    """Ratings outside 0 to 5 and negative counts."""
    return metrics(rows, **{f"{rating}_impossible": count_if((F.col(rating) < 0) | (F.col(rating) > 5)), f"{rating}_missing": F.count_if(F.col(rating).isNull())}, **{f"{c}_negative": count_if(F.col(c) < 0) for c in counts})


def page_anomalies(rows: DataFrame, pages: str = "num_pages_median") -> DataFrame:
    """Pages of 0 or less, under 10 and over 2000, missing ones."""
    p = F.col(pages)
    return metrics(rows, not_positive=count_if(p <= 0), short=count_if((p > 0) & (p < 10)), long=count_if(p > 2000), missing=F.count_if(p.isNull()))


def year_anomalies(rows: DataFrame, year: str, low: int = 1900, high: int = 2020) -> DataFrame:
    """Years outside [low, high] and in its last three, missing ones, the least and the greatest."""
    y = F.col(year)
    return metrics(rows, before=count_if(y < low), after=count_if(y > high), last_three=count_if(y.between(high - 2, high)), missing=F.count_if(y.isNull()), least=F.min(y), greatest=F.max(y))


def suspicious_years(rows: DataFrame, year: str, language: str, low: int = 1900, high: int = 2020) -> DataFrame:
    """Counts of the languages among years outside [low, high]."""
    return rows.filter((F.col(year) < low) | (F.col(year) > high)).groupBy(F.col(language).alias("language")).agg(F.count("*").alias("n"))


def text_gaps(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Null and blank texts of each column, and the share of both in percent."""
    out = metrics(rows, **{f"{c}__{k}": v for c in columns for k, v in (("null", F.count_if(F.col(c).isNull())), ("blank", count_if(F.trim(F.col(c)) == "")), ("share", count_if(F.coalesce(F.trim(F.col(c)), F.lit("")) == "") * 100.0 / F.count("*")))})
    return out.select(F.split_part("metric", F.lit("__"), F.lit(1)).alias("column_name"), F.split_part("metric", F.lit("__"), F.lit(2)).alias("metric"), F.round("value", 4).alias("value"))


def categories(rows: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """column_name, n_values, n_distinct, n_null, top_values (value, n), too_many (over 1000 distinct), mostly_missing (over 80 percent), dominant (over 90 percent of one value)."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    counts = rows.select(each).select("x.*").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    sums = counts.groupBy("column_name").agg(F.sum("n").alias("n_values"), F.count("value").alias("n_distinct"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"), F.max(F.when(known, F.col("n"))).alias("most"))
    first = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    best = counts.filter(known).withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= top).groupBy("column_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "value", "n"))), lambda x: F.concat_ws("=", x.value, x.n.cast("string"))).alias("top_values"))
    total = F.col("n_values")
    return sums.join(best, "column_name", "left").select("column_name", "n_values", "n_distinct", "n_null", "top_values", (F.col("n_distinct") > 1000).alias("too_many"), (F.col("n_null") * 100.0 / total > 80).alias("mostly_missing"), (F.coalesce(F.col("most"), F.lit(0)) * 100.0 / total > 90).alias("dominant"))


def quality_score(outliers: Column, values: Column, critical: Column) -> Column:
    """100, less half the percentage of outliers (30 at most) and twice that of critical anomalies (50 at most)."""
    pct = lambda x: x * 100.0 / F.greatest(values, F.lit(1))
    return F.greatest(F.lit(0.0), 100 - F.least(pct(outliers) * 0.5, F.lit(30.0)) - F.least(pct(critical) * 2, F.lit(50.0)))


def field_statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n, mean, std, min, max and the quartiles: documentation only, no row is treated."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")
    one = rows.select(each).select("x.*").groupBy("column_name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return one.join(quantiles(rows, columns, [0.25, 0.5, 0.75]).withColumnsRenamed({"q0": "q25", "q1": "median", "q2": "q75"}), "column_name", "left")


# Repairs and filters of the cleaning steps


def years_within(rows: DataFrame, year: str, low: int, high: int) -> DataFrame:
    return rows.filter(F.col(year).between(low, high))


def repaired_series(rows: DataFrame) -> DataFrame:
    """A series count that is negative or missing becomes null, and so do the series' id and title."""
    ok = F.col("series_works_count") >= 0
    return rows.withColumns({c: F.when(ok, F.col(c)) for c in ("series_works_count", "series_id", "series_title")})


def cleaning_steps(rows: DataFrame, steps: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows for which all conditions hold, and (step, n_before, n_after, n_removed) of the steps in their order, in one pass."""
    left, counts = F.lit(True), {"__all": F.count("*")}
    for name, holds in steps.items():
        left = left & F.coalesce(holds, F.lit(False))
        counts[name] = F.count_if(left)
    one = rows.agg(*(v.alias(k) for k, v in counts.items()))
    names = list(counts)
    each = [F.struct(F.lit(k).alias("step"), F.col(a).alias("n_before"), F.col(k).alias("n_after"), (F.col(a) - F.col(k)).alias("n_removed")) for a, k in zip(names, names[1:])]
    return rows.filter(left), one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


# Gates


def build_gate(works: DataFrame, low: int = 2000, high: int = 2020) -> DataFrame:
    """check, n_failed of a work table; a build is valid where all are 0."""
    out = metrics(works, empty_work_id=F.count_if(F.col("work_id").isNull()), empty_title=F.count_if(F.col("title").isNull()), empty_book_list=F.count_if(F.coalesce(F.size("book_id_list_en"), F.lit(0)) <= 0), year_outside=F.count_if(~F.coalesce(F.col("publication_year").between(low, high), F.lit(False))))
    return out.select(F.col("metric").alias("check"), F.col("value").cast("long").alias("n_failed"))


def check_build(works: DataFrame, low: int = 2000, high: int = 2020) -> DataFrame:
    """The work table; ValueError where a check of build_gate() fails."""
    if failed := [f"{r['check']}: {r['n_failed']}" for r in build_gate(works, low, high).collect() if r["n_failed"]]:
        raise ValueError("the work table isn't valid: " + ", ".join(failed))
    return works


def step_scores(rows: DataFrame, flags: list[str], year: str, years: tuple[int, int], fields: list[str], expected_rows: int | None, narrow: set[str] = frozenset({"smallint", "int", "float"}), least_narrow: float = 0.5, least_kept: int = 0) -> DataFrame:
    """component, check, passed: steps 1 to 3 (duplicate flags are there, under half the columns have nulls, over `least_narrow` of them are of narrow types),
    4 (all years in range, the fields are there, the row count is the expected one), 5 (narrow types, columns kept). Types come from the schema, all else from one pass."""
    cols = rows.columns
    nulls = rows.agg(*(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols), count_if(~F.col(year).between(*years)).alias("__outside"), F.count("*").alias("__rows"))
    with_nulls = sum((F.when(F.col(f"n_{c}") > 0, 1).otherwise(0) for c in cols), F.lit(0))
    share = sum(t in narrow for _, t in rows.dtypes) / max(1, len(cols))
    checks = [
        ("step1_3", "duplicate_flags", F.lit(all(f in cols for f in flags))), ("step1_3", "missing_values", with_nulls < len(cols) * 0.5), ("step1_3", "data_types", F.lit(share > least_narrow)),
        ("step4", "years", F.col("__outside") == 0), ("step4", "fields", F.lit(all(f in cols for f in fields))), ("step4", "row_count", F.lit(True) if expected_rows is None else F.col("__rows") == expected_rows),
        ("step5", "narrow_types", F.lit(share > 0.7)), ("step5", "kept_columns", F.lit(len(cols) > least_kept)),
    ]
    each = F.array(*(F.struct(F.lit(c).alias("component"), F.lit(k).alias("check"), v.alias("passed")) for c, k, v in checks))
    return nulls.select(F.explode(each).alias("x")).select("x.*")


def component_scores(checks: DataFrame) -> DataFrame:
    """component, score: the percentage of its checks that passed."""
    return checks.groupBy("component").agg((F.avg(F.col("passed").cast("int")) * 100).alias("score"))


def gates(scores: DataFrame) -> DataFrame:
    """gate, threshold, achieved, passed, for components' scores in percent; a component that isn't there scores 0."""
    own = {k: F.coalesce(F.max(F.when(F.col("component") == k, F.col("score"))), F.lit(0.0)) for k in WEIGHTS}
    one = scores.agg(*(v.alias(k) for k, v in own.items())).withColumn("overall", sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)))
    each = F.array(*(F.struct(F.lit(g).alias("gate"), F.lit(t).alias("threshold"), F.col(c or "overall").alias("achieved"), (F.col(c or "overall") >= t - 1e-9).alias("passed")) for g, (t, c) in GATES.items()))
    return one.select(F.explode(each).alias("x")).select("x.*")


def certificate(gate_rows: DataFrame) -> DataFrame:
    """overall_score, level, status, gates_passed, gates_total."""
    one = gate_rows.agg(F.max(F.when(F.col("gate") == "overall", F.col("achieved"))).alias("overall_score"), F.count_if("passed").alias("gates_passed"), F.count("*").alias("gates_total"))
    pick = lambda k: F.coalesce(*(F.when(F.col("overall_score") >= row[0] - 1e-9, row[k]) for row in LEVELS))
    return one.select("overall_score", pick(1).alias("level"), pick(2).alias("status"), "gates_passed", "gates_total")


def text_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n, n_null, mean_length, max_length, n_markup, n_line_breaks, n_spaces (runs of white space)."""
    one = rows.agg(*(x.alias(f"{k}__{c}") for c in columns for k, x in (("n", F.count(c)), ("n_null", F.count_if(F.col(c).isNull())), ("mean_length", F.avg(F.length(c))), ("max_length", F.max(F.length(c)).cast("long")), ("n_markup", count_if(C.has_markup(F.col(c)))), ("n_line_breaks", count_if(F.col(c).rlike(r"[\r\n]"))), ("n_spaces", count_if(F.col(c).rlike(r"\s{2,}"))))))
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{k}__{c}").alias(k) for k in ("n", "n_null", "mean_length", "max_length", "n_markup", "n_line_breaks", "n_spaces"))) for c in columns))
    return one.select(F.explode(each).alias("x")).select("x.*")


def text_gate(rows: DataFrame, texts: list[str], lists: list[str]) -> DataFrame:
    """check, n_failed: markup left in texts; lists of tags or genres with empty items, capitals or spaces at commas."""
    checks = {f"{c}_markup": count_if(C.has_markup(F.col(c))) for c in texts} | {f"{c}_format": count_if(F.col(c).rlike(r"^,|,$|,,|\s,|,\s|[A-Z]")) for c in lists}
    return metrics(rows, **checks).select(F.col("metric").alias("check"), F.col("value").cast("long").alias("n_failed"))


def list_statistics(rows: DataFrame, column: str, top: int = 10) -> DataFrame:
    """metric, value of an array column: rows, empty ones, least, greatest, mean and median length, deviation, items, distinct items."""
    n = F.coalesce(F.size(column), F.lit(0))
    one = metrics(rows, rows=F.count("*"), empty=F.count_if(n <= 0), least=F.min(n), greatest=F.max(n), mean=F.avg(n), std=F.stddev_samp(n), items=F.sum(F.greatest(n, F.lit(0))))
    median = quantiles(rows.select(n.alias("n")), ["n"], [0.5]).select(F.lit("median").alias("metric"), F.col("q0").alias("value"))
    kinds = rows.select(F.explode(column).alias("item")).distinct().agg(F.count("*").cast("double").alias("value")).select(F.lit("distinct_items").alias("metric"), "value")
    return one.unionByName(median).unionByName(kinds)


def list_validation(rows: DataFrame, text: str, parsed: str) -> DataFrame:
    """metric, value: texts that are there, that gave items, empty lists, success in percent, items that are numbers in percent."""
    given, got = F.coalesce(F.trim(F.col(text)), F.lit("")) != "", F.coalesce(F.size(parsed), F.lit(0)) > 0
    numbers = F.sum(F.size(F.filter(parsed, lambda x: x.rlike(r"^\d+$"))))
    return metrics(rows, given=F.count_if(given), parsed=F.count_if(given & got), empty=F.count_if(~got), success_pct=F.count_if(given & got) * 100.0 / F.greatest(F.count_if(given), F.lit(1)), numeric_pct=F.coalesce(numbers, F.lit(0)) * 100.0 / F.greatest(F.sum(F.size(parsed)), F.lit(1)))


def run_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b, change over two runs' (metric, value); a metric of one run only has nulls."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full")
    return both.withColumn("change", F.col("b") - F.col("a"))


def tier_summary(reviews: DataFrame, tier: str, work: str, text: str, rating: str) -> DataFrame:
    """Twelve figures a tier: reviews, works, mean and median reviews a work, mean and median length in characters and words, mean and median rating, reviews with one."""
    own = reviews.filter(F.col(tier).isNotNull()).select(tier, work, F.length(text).alias("chars"), C.word_count(F.col(text)).alias("words"), F.col(rating).cast("double").alias("rating"))
    per = own.filter(F.col(work).isNotNull()).groupBy(tier, work).agg(F.count("*").alias("n"))
    one = own.groupBy(tier).agg(F.count("*").alias("reviews"), F.avg("chars").alias("mean_chars"), F.avg("words").alias("mean_words"), F.avg("rating").alias("mean_rating"), F.count("rating").alias("rated"))
    works = per.groupBy(tier).agg(F.count("*").alias("works"), F.avg("n").alias("mean_per_work"))
    medians = quantiles(own, ["chars", "words", "rating"], [0.5], [tier]).groupBy(tier).pivot("column_name", ["chars", "words", "rating"]).agg(F.max("q0"))
    medians = medians.withColumnsRenamed({"chars": "median_chars", "words": "median_words", "rating": "median_rating"})
    per_work = quantiles(per, ["n"], [0.5], [tier]).select(tier, F.col("q0").alias("median_per_work"))
    return one.join(works, tier, "left").join(per_work, tier, "left").join(medians, tier, "left")
