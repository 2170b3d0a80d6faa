"""Distribution profiles and tests. Every result is a few rows; p-values come from foliant.functions.distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions as D
from .quantiles import group_quantiles, quantiles

CUTS = 200


def running_counts(counts: DataFrame, value: str, n: str, by: list[str] = ()) -> DataFrame:
    """counts (by, value, n; a value once) with `below`, the sum of n over smaller values, and `total`.

    Values are dealt into some CUTS ranges by a sketch; a small table of the ranges' sums gives each its start, so no task orders all values.
    """
    by = list(by)
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, F.array(*(F.lit(i / CUTS) for i in range(1, CUTS))), 1000).alias("__cuts"))
    keys = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    cuts = cuts.withColumnsRenamed({b: f"__{b}" for b in by})
    placed = (counts.join(cuts, keys) if by else counts.join(F.broadcast(cuts))).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(value))))
    placed = placed.drop("__cuts", *(f"__{b}" for b in by))
    parts = placed.groupBy(*by, "__part").agg(F.sum(n).alias("__sum"))
    order = Window.partitionBy(*by, F.lit(0)).orderBy("__part")
    parts = parts.withColumn("__start", F.sum("__sum").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum"))
    parts = parts.withColumn("total", F.sum("__sum").over(Window.partitionBy(*by, F.lit(0)))).drop("__sum").withColumnsRenamed({b: f"__{b}" for b in by})
    inside = Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    started = placed.withColumn("__in", F.sum(n).over(inside) - F.col(n)).withColumnRenamed("__part", "__p")
    out = started.join(parts, [F.col("__p") == F.col("__part"), *keys])
    return out.withColumn("below", F.col("__start") + F.col("__in")).drop("__start", "__in", "__p", "__part", *(f"__{b}" for b in by))


def average_ranks(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """by, value, n, avg_rank: distinct values with how often they occur and their average rank from 1. Nulls have none."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running_counts(counts, value, "n", by).select(*by, value, "n", (F.col("below") + (F.col("n") + 1) / 2).alias("avg_rank"))


def ccdf(rows: DataFrame, value: str) -> DataFrame:
    """Distinct values with the share of rows that are greater."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return running_counts(counts, value, "n").select(value, (1 - (F.col("below") + F.col("n")) / F.col("total")).alias("ccdf"))


def count_profile(rows: DataFrame, columns: list[str], limit: float = 1.5) -> DataFrame:
    """Of values that aren't negative: n, mean, median, population deviation, least, largest, zeros, their percentage, variance to mean, whether over limit."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")
    values = rows.select(each).select("x.*").filter("value >= 0")
    one = values.groupBy("column_name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(F.col("value") == 0).alias("zeros"))
    medians = quantiles(rows.select(*(F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in columns)), columns, [0.5]).withColumnRenamed("q0", "median")
    out = one.join(medians, "column_name").withColumn("zero_pct", F.col("zeros") * 100.0 / F.col("n"))
    return out.withColumn("vmr", F.when(F.col("mean") > 0, F.col("std") ** 2 / F.col("mean"))).withColumn("overdispersed", F.coalesce(F.col("vmr") > limit, F.lit(True)))


def overdispersion(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Tests of a Poisson model with an intercept alone, a row a column: Pearson's chi2 with its z (Dean and Lawless), and the regression of
    ((y - mu)^2 - y) / mu on mu (Cameron and Trivedi)."""

    def of(c: str) -> DataFrame:
        y = rows.select(F.col(c).cast("double").alias("y")).filter("y is not null and not isnan(y)")
        mu = y.agg(F.avg("y").alias("mu"))
        e = F.col("y") - F.col("mu")
        one = y.join(F.broadcast(mu)).agg(F.count("*").alias("n"), F.max("mu").alias("mean"), F.var_samp("y").alias("variance"), F.sum(e**2 / F.col("mu")).alias("pearson_chi2"), F.avg((e**2 - F.col("y")) / F.col("mu")).alias("m"), F.stddev_samp((e**2 - F.col("y")) / F.col("mu")).alias("s"))
        return one.select(F.lit(c).alias("column_name"), "n", "mean", "variance", (F.col("variance") / F.col("mean")).alias("vmr"), "pearson_chi2", (F.col("n") - 1).alias("df"), (F.col("m") / F.col("mean")).alias("alpha"), (F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"))

    out = reduce(DataFrame.unionByName, map(of, columns))
    out = out.withColumn("z", (F.col("pearson_chi2") - F.col("df")) / F.sqrt(2.0 * F.col("df")))
    return out.withColumn("z_p", D.normal_p(F.col("z"))).withColumn("t_p", D.t_p(F.col("t"), F.col("df")))


def power_law(rows: DataFrame, column: str, most: int = 100, least_rows: int = 50) -> DataFrame:
    """Discrete power law of values from 1: xmin with the least Kolmogorov-Smirnov distance of at most `most` distinct values, evenly taken by rank of the
    distinct values (all of them if there are no more), alpha = 1 + n / sum(ln(x / (xmin - 0.5))), the distance, the tail's size and share. No row
    under least_rows values."""
    values = rows.select(F.floor(F.col(column)).cast("double").alias("x")).filter("x >= 1")
    counts = values.groupBy("x").agg(F.count("*").alias("c"))
    ranked = running_counts(counts.withColumn("one", F.lit(1)), "x", "one").withColumnsRenamed({"below": "place", "total": "kinds"})
    step = F.greatest(F.lit(1), F.ceil(F.col("kinds") / most))
    least = ranked.filter(F.col("place") % step == 0).agg(F.sort_array(F.collect_list("x")).alias("xmins"))  # at most `most`
    total = counts.agg(F.sum("c").alias("all"))
    met = counts.join(F.broadcast(least)).select("x", "c", F.explode(F.filter("xmins", lambda m: m <= F.col("x"))).alias("xmin"))
    fit = met.groupBy("xmin").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log(F.col("x") / (F.col("xmin") - 0.5))).alias("s")).withColumn("alpha", 1 + F.col("n") / F.col("s"))
    below = running_counts(met, "x", "c", ["xmin"]).select("xmin", "x", "c", "below")
    both = below.join(fit, "xmin")
    above = lambda x: D.hurwitz_zeta(F.col("alpha"), x, F.col("xmin")) / D.hurwitz_zeta(F.col("alpha"), F.col("xmin"), F.col("xmin"))
    gap = F.abs((F.col("below") + F.col("c")) / F.col("n") - (1 - above(F.col("x") + 1)))
    best = both.groupBy("xmin", "alpha", "n").agg(F.max(gap).alias("ks")).filter("alpha > 1").agg(F.min(F.struct("ks", "xmin", "alpha", "n")).alias("b"))
    return best.join(F.broadcast(total)).filter(F.col("all") >= least_rows).select("b.xmin", "b.alpha", "b.ks", F.col("b.n").alias("n_tail"), (F.col("b.n") / F.col("all")).alias("tail_share"))


def goodness_of_fit(observed: DataFrame, expected: DataFrame, key: str, n: str = "n", least: int = 0, least_kinds: int = 2) -> DataFrame:
    """chi2 of the observed counts against the expected ones' proportions: chi2_prop on proportions, chi2_counts on counts; dof and p of the
    latter. Only kinds of at least `least` counts on both sides; no row under least_kinds of them."""
    o, e = (x.groupBy(key).agg(F.sum(n).cast("double").alias(c)) for x, c in ((observed, "o"), (expected, "e")))
    both = e.join(o, key, "left").fillna({"o": 0.0}).filter((F.col("e") >= least) & (F.col("o") >= least) & (F.col("e") > 0))
    sums = both.agg(F.sum("o").alias("to"), F.sum("e").alias("te"))
    gap = F.col("o") / F.col("to") - F.col("e") / F.col("te")
    one = both.join(F.broadcast(sums)).agg(F.count("*").alias("k"), F.max("to").alias("n"), F.sum(gap**2 / (F.col("e") / F.col("te"))).alias("chi2_prop"))
    out = one.filter(F.col("k") >= least_kinds).select("chi2_prop", (F.col("chi2_prop") * F.col("n")).alias("chi2_counts"), (F.col("k") - 1).alias("dof"), "n")
    return out.withColumn("p", D.chi2_p(F.col("chi2_counts"), F.col("dof")))


def independence(cells: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """chi2 (with Yates' correction for two by two), dof, n, Cramer's V and p of a table of counts (a, b, n). Cells that don't occur needn't be there:
    chi2 = n (sum of o^2 / (r c) - 1) needs only the others."""
    own = cells.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.sum(n).cast("double").alias("o")).filter("o > 0")
    r, c = (own.groupBy(k).agg(F.sum("o").alias(s)) for k, s in (("a", "r"), ("b", "c")))
    sums = lambda t, s, k: t.agg(F.count("*").alias(k), F.sum(1 / F.col(s)).alias(f"inv_{s}"))
    whole = own.agg(F.sum("o").alias("t")).join(sums(r, "r", "ka")).join(sums(c, "c", "kb"))
    met = own.join(r, "a").join(c, "b").join(F.broadcast(whole))
    e = F.col("r") * F.col("c") / F.col("t")
    one = met.groupBy("t", "ka", "kb", "inv_r", "inv_c").agg(F.sum(F.col("o") ** 2 / (F.col("r") * F.col("c"))).alias("s"), F.max(F.abs(F.col("o") - e)).alias("d"))
    dof = (F.col("ka") - 1) * (F.col("kb") - 1)
    yates = F.greatest(F.lit(0.0), F.col("d") - 0.5) ** 2 * F.col("t") * F.col("inv_r") * F.col("inv_c")
    chi2 = F.when(dof == 1, yates).otherwise(F.col("t") * (F.col("s") - 1))
    out = one.select(chi2.alias("chi2"), dof.alias("dof"), F.col("t").cast("long").alias("n"), F.sqrt(chi2 / (F.col("t") * (F.least("ka", "kb") - 1))).alias("cramers_v"))
    return out.withColumn("p", D.chi2_p(F.col("chi2"), F.col("dof")))


def two_corpora(full: DataFrame, subset: DataFrame, key: Column) -> DataFrame:
    """Counts (value, corpus, n) of a column in both, for independence()."""
    each = lambda df, name: df.groupBy(key.alias("value")).agg(F.count("*").alias("n")).withColumn("corpus", F.lit(name))
    return each(full, "full").unionByName(each(subset, "subset"))


def mann_whitney(full: DataFrame, subset: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Two-sided test for each group: u of the first corpus, z with corrections for ties and continuity, p; n and mean of both, Cohen's d. Groups that lack either corpus have no row."""
    by = list(by)
    both = full.select(*by, F.col(value).cast("double").alias("v"), F.lit(1).alias("f")).unionByName(subset.select(*by, F.col(value).cast("double").alias("v"), F.lit(0).alias("f"))).filter("v is not null")
    counts = both.groupBy(*by, "v").agg(F.count("*").alias("n"), F.sum("f").alias("n1"))
    ranks = running_counts(counts, "v", "n", by).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    t = F.col("n").cast("double")
    one = ranks.groupBy(*by).agg(F.sum(F.col("n1") * F.col("rank")).alias("r1"), F.sum("n1").cast("double").alias("a"), F.sum(t).alias("t"), F.sum(t**3 - t).alias("ties"))
    first, second = F.when(F.col("f") == 1, F.col("v")), F.when(F.col("f") == 0, F.col("v"))
    means = both.groupBy(*by).agg(F.avg(first).alias("full_mean"), F.avg(second).alias("subset_mean"), F.var_samp(first).alias("v1"), F.var_samp(second).alias("v2"))
    out = (one.join(means, by) if by else one.join(F.broadcast(means))).withColumn("b", F.col("t") - F.col("a")).filter("a > 0 and b > 0")
    a, b, n = F.col("a"), F.col("b"), F.col("t")
    u = F.col("r1") - a * (a + 1) / 2
    sigma = F.sqrt(a * b / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    pooled = F.sqrt(((a - 1) * F.col("v1") + (b - 1) * F.col("v2")) / F.nullif(a + b - 2, F.lit(0.0)))
    d = F.when(pooled == 0, 0.0).otherwise((F.col("full_mean") - F.col("subset_mean")) / pooled)
    out = out.withColumn("u", u).withColumn("z", (F.greatest("u", a * b - F.col("u")) - a * b / 2 - 0.5) / F.nullif(sigma, F.lit(0.0)))
    out = out.select(*by, "u", "z", a.cast("long").alias("n_full"), b.cast("long").alias("n_subset"), "full_mean", "subset_mean", d.alias("cohens_d"))
    return out.withColumn("p", F.least(F.lit(1.0), F.when(F.col("z") > 0, D.normal_p(F.col("z"))).otherwise(2 - D.normal_p(F.col("z")))))


def normality(rows: DataFrame, value: str) -> DataFrame:
    """D'Agostino and Pearson's test: z of skewness and of kurtosis, their squares' sum and p. No row under 8 values."""
    one = rows.agg(F.count(value).cast("double").alias("n"), F.skewness(value).alias("g"), (F.kurtosis(value) + 3).alias("b2")).filter("n >= 8")
    n = F.col("n")
    y = F.col("g") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    x = y / F.sqrt(2 / (w2 - 1))
    skew_z = F.log(x + F.sqrt(x**2 + 1)) / F.sqrt(0.5 * F.log(w2))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    k = (F.col("b2") - mean) / F.sqrt(var)
    root = 6 * (n**2 - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / root**2))
    ratio = (1 - 2 / a) / (1 + k * F.sqrt(2 / (a - 4)))
    kurt_z = (1 - 2 / (9 * a) - F.signum(ratio) * F.abs(ratio) ** (1 / 3)) / F.sqrt(2 / (9 * a))
    out = one.select(n.cast("long").alias("n"), skew_z.alias("skew_z"), kurt_z.alias("kurt_z")).withColumn("k2", F.col("skew_z") ** 2 + F.col("kurt_z") ** 2)
    return out.withColumn("p", D.chi2_p(F.col("k2"), F.lit(2)))


def superior(full: DataFrame, subset: DataFrame, by: str, values: list[str]) -> DataFrame:
    """For each group and column the medians of both corpora and whether the subset's is greater."""

    def of(c: str) -> DataFrame:
        a, b = (group_quantiles(df, [by], c, {name: 0.5}) for df, name in ((full, "full_median"), (subset, "subset_median")))
        return a.join(b, by).select(by, F.lit(c).alias("column_name"), "full_median", "subset_median", (F.col("subset_median") > F.col("full_median")).alias("superior"))

    return reduce(DataFrame.unionByName, map(of, values))


CONTINUOUS = "average_rating_weighted_mean ratings_count_sum text_reviews_count_sum num_pages_median author_average_rating author_ratings_count".split()


def cross_validation(full: DataFrame, subset: DataFrame, tier: str = "pop_tier", top: int = 20) -> DataFrame:
    """All comparisons of two corpora, a row each: variable, stratum, test, statistic, p_value, effect, significant. Columns that either lacks are left out."""
    has = lambda c: c in full.columns and c in subset.columns
    row = lambda df, name, test, stat, p, effect=None, stratum=None: df.select(F.lit(name).alias("variable"), (F.lit(None).cast("string") if stratum is None else F.col(stratum).cast("string")).alias("stratum"), F.lit(test).alias("test"), F.col(stat).cast("double").alias("statistic"), F.col(p).alias("p_value"), (F.lit(None).cast("double") if effect is None else F.col(effect)).alias("effect"))
    out = []
    if has("genres_str"):
        names = lambda df: df.select(F.explode(F.split("genres_str", ",")).alias("g")).select(F.trim("g").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
        common = names(full).orderBy(F.desc("n"), "g").limit(top)
        fit = goodness_of_fit(names(subset), common, "g")
        fit = fit.withColumn("parity_p", D.chi2_p(F.col("chi2_prop"), F.col("dof")))
        out += [row(fit, "genre_distribution", "chi-square of proportions", "chi2_prop", "parity_p"), row(fit, "genre_distribution", "chi-square", "chi2_counts", "p")]
    if has("publication_year"):
        decades = two_corpora(full, subset, (F.floor(F.col("publication_year") / 10) * 10).cast("long"))
        out += [row(independence(decades, "value", "corpus", "n"), "publication_year", "chi-square (decade bins)", "chi2", "p", "cramers_v"), row(mann_whitney(full, subset, "publication_year"), "publication_year", "Mann-Whitney U", "u", "p", "cohens_d")]
    if has("series_flag"):
        out.append(row(independence(two_corpora(full, subset, F.col("series_flag")), "value", "corpus", "n"), "series_status", "chi-square", "chi2", "p", "cramers_v"))
    out += [row(mann_whitney(full, subset, c), c, "Mann-Whitney U", "u", "p", "cohens_d") for c in CONTINUOUS if has(c)]
    if has(tier):
        out += [row(mann_whitney(full, subset, c, [tier]), c, "Mann-Whitney U", "u", "p", "cohens_d", tier) for c in ("ratings_count_sum", "text_reviews_count_sum", "average_rating_weighted_mean") if has(c)]
    return reduce(DataFrame.unionByName, out).withColumn("significant", F.col("p_value") < 0.05)
