"""Quotas and repeatable samples. A rank is always bounded by a number known to the plan first, so that map tasks keep no more than that of a stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hashed(*columns: Column, seed: str = "42") -> Column:
    """An order that is the same on any engine: md5 of the columns as text and the seed."""
    return F.md5(F.concat_ws("|", *(c.cast("string") for c in columns), F.lit(seed)))


def first_n(rows: DataFrame, by: list[str], order: list[Column], most: int, n: Column | None = None) -> DataFrame:
    """The first `most` rows of each group, or its first n (a column) of those."""
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rn") <= most)
    return (ranked if n is None else ranked.filter(F.col("__rn") <= n)).drop("__rn")


def uniform_sample(rows: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows without replacement, those with least hash of their key."""
    return rows.orderBy(hashed(F.col(key), seed=seed), key).limit(n)


def quota_table(counts: DataFrame, cells: list[str], target: int, by: list[str] = (), least: int = 1, n: str = "n") -> DataFrame:
    """counts with prop and quota, in each group `by`: the floor of the cell's share of the target, at least `least`; if the sum falls short, as many of
    the largest shares as are missing get one more; if it is over, as many of the smallest shares with a quota over 1 get one less. At most one either
    way a cell; ties by the cell's names."""
    whole = Window.partitionBy(*by, F.lit(0))
    base = counts.withColumn("prop", F.col(n) / F.sum(n).over(whole)).withColumn("__q", F.greatest(F.lit(least), F.floor(F.col("prop") * target).cast("int")))
    base = base.withColumn("__diff", target - F.sum("__q").over(whole)).withColumn("__up", F.row_number().over(whole.orderBy(F.desc("prop"), *cells)))
    down = F.row_number().over(Window.partitionBy(*by, F.col("__q") > 1).orderBy("prop", *cells))
    base = base.withColumn("__down", down)
    change = F.when((F.col("__diff") > 0) & (F.col("__up") <= F.col("__diff")), 1).when((F.col("__diff") < 0) & (F.col("__q") > 1) & (F.col("__down") <= -F.col("__diff")), -1).otherwise(0)
    return base.withColumn("quota", F.col("__q") + change).drop("__q", "__diff", "__up", "__down")


ENGAGEMENT = ["ratings_count_sum", "text_reviews_count_sum", "author_ratings_count"]


def by_engagement(key: str = "work_id") -> list[Column]:
    return [*(F.desc_nulls_last(c) for c in ENGAGEMENT), F.asc(key)]


def tiered_sample(works: DataFrame, total: int = 6000, tiers: tuple[str, ...] = ("thrash", "mid", "top"), tier: str = "pop_tier", cells: tuple[str, ...] = ("publication_year", "genre_group"), inner: tuple[str, ...] = ("series_flag", "pages_bin"), key: str = "work_id") -> DataFrame:
    """A sample in three levels: each tier an equal part of the total, spread over the cells by quota_table(), and each cell's over its inner cells by
    their shares, filled in order of engagement; what an inner cell can't fill comes from the rest of its cell, what a cell can't fill from the rest
    of its tier; a sum over the total is cut at the least engaged."""
    each, own, cells, inner = total // len(tiers), works.filter(F.col(tier).isin(*tiers)), list(cells), list(inner)
    order, at = by_engagement(key), [tier, *cells]
    known = [F.col(c).isNotNull() for c in cells]
    rows = own.filter(known[0] & known[1]) if len(known) == 2 else own.na.drop(subset=cells)
    quotas = quota_table(rows.groupBy(*at).agg(F.count("*").alias("n")), cells, each, [tier]).select(*at, F.col("quota").alias("__quota"))
    parts = rows.na.drop(subset=inner).groupBy(*at, *inner).agg(F.count("*").alias("n")).join(quotas, at)
    whole = Window.partitionBy(*at)
    parts = parts.withColumn("__prop", F.col("n") / F.sum("n").over(whole)).withColumn("__q", F.floor(F.col("__prop") * F.col("__quota")).cast("int"))
    bump = F.row_number().over(whole.orderBy(F.desc("__prop"), *inner)) <= F.col("__quota") - F.sum("__q").over(whole)
    parts = parts.withColumn("__inner", F.col("__q") + F.when(bump, 1).otherwise(0)).select(*at, *inner, "__inner")
    met = rows.join(quotas, at).join(parts, [*at, *inner], "left").fillna({"__inner": 0})
    ranked = met.withColumn("__r", F.row_number().over(Window.partitionBy(*at, *inner).orderBy(*order))).filter(F.col("__r") <= 2 * each + 1)
    ranked = ranked.withColumn("__own", F.col("__r") <= F.col("__inner"))
    place = F.row_number().over(Window.partitionBy(*at).orderBy(F.desc("__own"), *order))
    chosen = ranked.withColumn("__place", place).filter(F.col("__place") <= each + 1).filter(F.col("__place") <= F.col("__quota")).select(*works.columns)
    counts = chosen.groupBy(tier).agg(F.count("*").alias("__have"))
    rest = own.join(chosen.select(key), key, "left_anti")
    fill = first_n(rest, [tier], order, each).join(counts, tier, "left").withColumn("__need", each - F.coalesce("__have", F.lit(0)))
    fill = fill.withColumn("__rn", F.row_number().over(Window.partitionBy(tier).orderBy(*order))).filter(F.col("__rn") <= F.col("__need")).select(*works.columns)
    return chosen.unionByName(fill).orderBy(*order).limit(total)


def whole_reviews(sentences: DataFrame, tier: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """Sentences of some n reviews, an equal part of each tier (those with least hash of their key); each review whole."""
    reviews = sentences.select(tier, key).distinct()
    tiers = reviews.select(tier).distinct().agg(F.count("*").alias("__k"))
    picked = reviews.join(F.broadcast(tiers)).withColumn("__rn", F.row_number().over(Window.partitionBy(tier).orderBy(hashed(F.col(key), seed=seed), key))).filter(F.col("__rn") <= n)
    return sentences.join(picked.filter(F.col("__rn") <= F.floor(n / F.col("__k"))).select(tier, key), [tier, key], "left_semi")


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.8, seed: str = "42") -> DataFrame:
    """rows with in_train: of each label the given share (rounded) with least hash of the key. A label's rows are ranked by ranges of their hash: see running_counts()."""
    from .stats import running_counts

    placed = rows.select(label, key).withColumn("__h", F.conv(F.substring(hashed(F.col(key), seed=seed), 1, 13), 16, 10).cast("double"))
    counts = placed.groupBy(label, "__h").agg(F.count("*").alias("__n"))
    ranks = running_counts(counts, "__h", "__n", [label]).select(F.col(label).alias("__l"), F.col("__h").alias("__g"), (F.col("below") < F.round(F.col("total") * share)).alias("in_train"))
    own = rows.withColumn("__h", F.conv(F.substring(hashed(F.col(key), seed=seed), 1, 13), 16, 10).cast("double"))
    return own.join(ranks, own[label].eqNullSafe(ranks["__l"]) & (own["__h"] == ranks["__g"])).drop("__h", "__l", "__g")
