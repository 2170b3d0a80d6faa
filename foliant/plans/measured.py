"""Queries of quantiles, profiles, tests and samples, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binning as B
from ..operators import core as O
from ..operators import quality as Q
from ..operators import quantiles as N
from ..operators import sampling as P
from ..operators import stats as S
from .registry import query

# Quantiles and what is made of them


@query("""
    WITH r AS (SELECT l_partkey, count(*) AS n_rows, sum(l_quantity) AS weight_sum, sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0.0) AS wm, median(l_extendedprice) AS md, max(l_extendedprice) AS max_value
               FROM lineitem GROUP BY l_partkey),
    q AS (SELECT quantile_cont(round(wm, 4), 0.25) AS q1, quantile_cont(round(wm, 4), 0.75) AS q3 FROM r)
    SELECT p_partkey, p_name, n_rows, weight_sum, round(wm, 4) AS weighted_mean, round(md, 4) AS median_value, max_value,
           CASE WHEN wm IS NULL THEN NULL WHEN round(wm, 4) < q1 THEN 'thrash' WHEN round(wm, 4) > q3 THEN 'top' ELSE 'mid' END AS tier
    FROM part LEFT JOIN r ON p_partkey = l_partkey, q""")
def rollup_weighted(t):
    works = O.weighted_rollup(t("lineitem"), "l_partkey", "l_extendedprice", "l_quantity")
    return B.tiers(t("part").join(works, F.col("p_partkey") == F.col("l_partkey"), "left"), "weighted_mean", "tier").select("p_partkey", "p_name", "n_rows", "weight_sum", "weighted_mean", "median_value", "max_value", "tier")


@query("""
    WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer)
    SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 'Low' WHEN c_acctbal <= b THEN 'Medium' WHEN c_acctbal <= c THEN 'High' ELSE 'Very High' END AS bin FROM customer, q""")
def quartile_bins(t):
    return B.quantile_bins(t("customer"), "c_acctbal", ["Low", "Medium", "High", "Very High"], "bin").select("c_custkey", "bin")


@query("SELECT o_orderkey, CAST(NULL AS VARCHAR) AS bin FROM orders")
def quartile_bins_tied(t):
    """Edges that collapse give no bins."""
    return B.quantile_bins(t("orders").withColumn("x", F.lit(1.0)), "x", ["Q1", "Q2", "Q3", "Q4"], "bin").select("o_orderkey", "bin")


@query("""
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
    SELECT CASE WHEN o_totalprice < a THEN 'thrash' WHEN o_totalprice > b THEN 'top' ELSE 'mid' END AS tier, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM orders, q GROUP BY 1""")
def price_tier(t):
    return B.tiers(t("orders").select("o_totalprice"), "o_totalprice", "tier").groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"))


@query("SELECT l_partkey, CASE WHEN r >= 0 AND r <= 2 THEN 'Poor' WHEN r <= 3 THEN 'Fair' WHEN r <= 4 THEN 'Good' WHEN r <= 5 THEN 'Excellent' END AS bin, count(*) AS n FROM (SELECT l_partkey, l_quantity / 10 AS r FROM lineitem) GROUP BY 1, 2")
def rating_bins(t):
    bins = B.fixed_bins(F.col("l_quantity") / 10, [0, 2, 3, 4, 5], ["Poor", "Fair", "Good", "Excellent"])
    return t("lineitem").groupBy("l_partkey", bins.alias("bin")).agg(F.count("*").alias("n"))


@query("""
    WITH g AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey), q AS (SELECT quantile_cont(n, 0.1) AS p10 FROM g)
    SELECT o_custkey, n FROM g, q WHERE NOT (n <= p10 AND m <= 150000)""")
def low_group_removal(t):
    g = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"))
    return B.with_quantiles(g, "n", [0.1]).filter(~((F.col("n") <= F.col("q0")) & (F.col("m") <= 150000))).select("o_custkey", "n")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def describe_all(t):
    out = Q.field_statistics(t("lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return out.select("column_name", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max")))


@query("SELECT " + ", ".join(f"round(quantile_cont(o_totalprice, {p / 100}), 4) AS p{p}" for p in (5, 10, 25, 50, 75, 90, 95)) + " FROM orders")
def percentiles7(t):
    shares = (5, 10, 25, 50, 75, 90, 95)
    return N.quantile_row(t("orders"), "o_totalprice", [p / 100 for p in shares]).select(*(F.round(f"q{i}", 4).alias(f"p{p}") for i, p in enumerate(shares)))


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY l_suppkey")
def quantiles_by_group(t):
    names = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    return N.group_quantiles(t("lineitem"), ["l_suppkey"], "l_extendedprice", names).select("l_suppkey", *(F.round(n, 4).alias(n) for n in names))


@query("""
    WITH c AS (SELECT c_mktsegment, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)
    SELECT c_mktsegment, count(*) AS total, count(*) FILTER (n > 0) AS covered, round(count(*) FILTER (n > 0) * 100.0 / count(*), 2) AS rate, round(avg(n), 4) AS mean_n, min(n) AS min_n, max(n) AS max_n, quantile_cont(n, 0.1) AS p10, median(n) AS median_n, quantile_cont(n, 0.9) AS p90 FROM c GROUP BY c_mktsegment""")
def coverage_summary(t):
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = t("customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"))
    covered = F.count_if(F.col("n") > 0)
    one = c.groupBy("c_mktsegment").agg(F.count("*").alias("total"), covered.alias("covered"), F.round(covered * 100.0 / F.count("*"), 2).alias("rate"), F.round(F.avg("n"), 4).alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))
    return one.join(N.group_quantiles(c, ["c_mktsegment"], "n", {"p10": 0.1, "median_n": 0.5, "p90": 0.9}), "c_mktsegment")


# Distributions


@query("SELECT l_quantity AS x, round(1.0 - sum(count(*)) OVER (ORDER BY l_quantity) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS ccdf FROM lineitem GROUP BY l_quantity")
def ccdf(t):
    return S.ccdf(t("lineitem"), "l_quantity").select(F.col("l_quantity").alias("x"), F.round("ccdf", 6).alias("ccdf"))


@query("SELECT l_extendedprice AS x, count(*) AS n, sum(count(*)) OVER (ORDER BY l_extendedprice) - count(*) + (count(*) + 1) / 2.0 AS avg_rank FROM lineitem GROUP BY l_extendedprice")
def average_ranks(t):
    return S.average_ranks(t("lineitem"), "l_extendedprice").withColumnRenamed("l_extendedprice", "x")


@query("""
    WITH r AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)
    SELECT CAST(least(floor((o_totalprice - a) / ((b - a) / 18)), 17) AS BIGINT) AS bin, count(*) AS n FROM orders, r GROUP BY 1""")
def histogram(t):
    return O.histogram(t("orders"), "o_totalprice", 18).select("bin", "n")


@query("""
    WITH r AS (SELECT min(log10(o_totalprice)) AS a, max(log10(o_totalprice)) AS b, count(*) AS t FROM orders WHERE o_totalprice > 0),
    h AS (SELECT CAST(least(floor((log10(o_totalprice) - a) / ((b - a) / 50)), 49) AS BIGINT) AS bin, a, (b - a) / 50 AS w, t, count(*) AS n FROM orders, r WHERE o_totalprice > 0 GROUP BY 1, 2, 3, 4)
    SELECT bin, n, round(n / t / (power(10, a + (bin + 1) * w) - power(10, a + bin * w)) * 1e6, 4) AS density FROM h""")
def log_histogram(t):
    return O.log_histogram(t("orders"), "o_totalprice").select("bin", "n", F.round(F.col("density") * 1e6, 4).alias("density"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, round(avg({c}), 4) AS mean, median({c}) AS median, round(stddev_pop({c}), 4) AS std, min({c}) AS min, max({c}) AS max, count(*) FILTER ({c} = 0) AS zeros, round(count(*) FILTER ({c} = 0) * 100.0 / count(*), 4) AS zero_pct, round(var_pop({c}) / avg({c}), 4) AS vmr, var_pop({c}) / avg({c}) > 1.5 AS overdispersed FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM lineitem) WHERE {c} >= 0" for c in ("l_quantity", "l_linenumber")))
def dispersion(t):
    out = S.count_profile(t("lineitem"), ["l_quantity", "l_linenumber"])
    return out.select("column_name", "n", F.round("mean", 4).alias("mean"), "median", F.round("std", 4).alias("std"), "min", "max", "zeros", F.round("zero_pct", 4).alias("zero_pct"), F.round("vmr", 4).alias("vmr"), "overdispersed")


@query(" UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, n, round(chi2, 3) AS pearson_chi2, round((chi2 - (n - 1)) / sqrt(2.0 * (n - 1)), 3) AS z, round(a / mu, 5) AS alpha, round(a / (s / sqrt(n)), 3) AS t FROM (
        SELECT count(*) AS n, max(mu) AS mu, sum((y - mu) ** 2 / mu) AS chi2, avg(((y - mu) ** 2 - y) / mu) AS a, stddev_samp(((y - mu) ** 2 - y) / mu) AS s
        FROM (SELECT CAST({c} AS DOUBLE) AS y, avg({c}) OVER () AS mu FROM lineitem))""" for c in ("l_quantity", "l_linenumber")))
def overdispersion(t):
    return S.overdispersion(t("lineitem"), ["l_quantity", "l_linenumber"]).select("column_name", "n", F.round("pearson_chi2", 3).alias("pearson_chi2"), F.round("z", 3).alias("z"), F.round("alpha", 5).alias("alpha"), F.round("t", 3).alias("t"))


@query("""
    WITH m AS (SELECT avg(l_extendedprice) AS m FROM lineitem), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(power(l_extendedprice - m, 2)) AS m2, avg(power(l_extendedprice - m, 3)) AS m3, avg(power(l_extendedprice - m, 4)) AS m4 FROM lineitem, m),
    g AS (SELECT n, m3 / power(m2, 1.5) AS g, m4 / (m2 * m2) AS b2 FROM s),
    h AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS be,
          (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
          6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS r FROM g),
    i AS (SELECT *, sqrt(2 * (be - 1)) - 1 AS w2, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) AS a FROM h),
    j AS (SELECT n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS zk FROM i)
    SELECT CAST(n AS BIGINT) AS n, round(zs, 3) AS skew_z, round(zk, 3) AS kurt_z, round(zs * zs + zk * zk, 2) AS k2 FROM j""")
def normality(t):
    return S.normality(t("lineitem"), "l_extendedprice").select("n", F.round("skew_z", 3).alias("skew_z"), F.round("kurt_z", 3).alias("kurt_z"), F.round("k2", 2).alias("k2"))


@query()
def power_law(t):
    """Compared with brute force in the tests."""
    return S.power_law(t("documents").select((F.length("text") / 50 + 1).alias("x")), "x")


# Tests


_CELLS = "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders WHERE {} GROUP BY ALL"


@query(f"""
    WITH c AS ({_CELLS.format("true")}), r AS (SELECT a, sum(o) AS r FROM c GROUP BY a), k AS (SELECT b, sum(o) AS k FROM c GROUP BY b), t AS (SELECT sum(o) AS t FROM c),
    x AS (SELECT r.a, k.b, r.r * k.k / CAST(t.t AS DOUBLE) AS e, coalesce(c.o, 0) AS o, t.t FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b)
    SELECT round(sum((o - e) ** 2 / e), 4) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, CAST(max(t) AS BIGINT) AS n, round(sqrt(sum((o - e) ** 2 / e) / (max(t) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 4) AS cramers_v FROM x""")
def chi2_indep(t):
    cells = t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return S.independence(cells, "o_orderstatus", "o_orderpriority", "n").select(F.round("chi2", 4).alias("chi2"), "dof", "n", F.round("cramers_v", 4).alias("cramers_v"))


@query("""
    WITH c AS (SELECT o_orderstatus = 'F' AS a, o_totalprice > 200000 AS b, count(*) AS o FROM orders GROUP BY ALL), r AS (SELECT a, sum(o) AS r FROM c GROUP BY a), k AS (SELECT b, sum(o) AS k FROM c GROUP BY b), t AS (SELECT sum(o) AS t FROM c),
    x AS (SELECT r.r * k.k / CAST(t.t AS DOUBLE) AS e, coalesce(c.o, 0) AS o, t.t FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b)
    SELECT round(sum(greatest(0, abs(o - e) - 0.5) ** 2 / e), 6) AS chi2, 1 AS dof, CAST(max(t) AS BIGINT) AS n FROM x""")
def chi2_two_by_two(t):
    cells = t("orders").groupBy((F.col("o_orderstatus") == "F").alias("a"), (F.col("o_totalprice") > 200000).alias("b")).agg(F.count("*").alias("n"))
    return S.independence(cells, "a", "b", "n").select(F.round("chi2", 6).alias("chi2"), "dof", "n")


_FULL = "SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1"


@query(f"""
    WITH e AS ({_FULL}), o AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1),
    x AS (SELECT o.n / sum(o.n) OVER () AS po, e.n / sum(e.n) OVER () AS pe, sum(o.n) OVER () AS t FROM e JOIN o USING (k))
    SELECT round(sum((po - pe) ** 2 / pe), 8) AS chi2_prop, round(sum((po - pe) ** 2 / pe) * max(t), 4) AS chi2_counts, count(*) - 1 AS dof FROM x""")
def chi2_gof(t):
    full, some = t("orders"), t("orders").filter("o_totalprice > 100000")
    counts = lambda df: df.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return S.goodness_of_fit(counts(some), counts(full), "o_orderpriority").select(F.round("chi2_prop", 8).alias("chi2_prop"), F.round("chi2_counts", 4).alias("chi2_counts"), "dof")


_MWU = """
    WITH b AS (SELECT {by} AS g, l_quantity AS v, 1 AS f FROM lineitem UNION ALL SELECT {by}, l_quantity, 0 FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'),
    c AS (SELECT g, v, count(*) AS n, sum(f) AS n1 FROM b GROUP BY g, v), r AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY v) - n + (n + 1) / 2.0 AS rk FROM c),
    s AS (SELECT g, CAST(sum(n1 * rk) AS DOUBLE) AS r1, CAST(sum(n1) AS DOUBLE) AS a, CAST(sum(n) - sum(n1) AS DOUBLE) AS b, CAST(sum(n) AS DOUBLE) AS t, sum(CAST(n AS DOUBLE) ** 3 - n) AS ties FROM r GROUP BY g),
    u AS (SELECT *, r1 - a * (a + 1) / 2 AS u FROM s)
    SELECT {out} round(u, 1) AS u, round((greatest(u, a * b - u) - a * b / 2 - 0.5) / sqrt(a * b / 12 * (t + 1 - ties / (t * (t - 1)))), 5) AS z, CAST(a AS BIGINT) AS n_full, CAST(b AS BIGINT) AS n_subset FROM u"""


@query(_MWU.format(by="1", out=""))
def mwu(t):
    full = t("lineitem")
    return S.mann_whitney(full, full.filter("l_shipdate < TIMESTAMP '1996-01-01'"), "l_quantity").select(F.round("u", 1).alias("u"), F.round("z", 5).alias("z"), "n_full", "n_subset")


@query(_MWU.format(by="l_returnflag", out="g AS l_returnflag,"))
def mwu_by_group(t):
    full = t("lineitem")
    return S.mann_whitney(full, full.filter("l_shipdate < TIMESTAMP '1996-01-01'"), "l_quantity", ["l_returnflag"]).select("l_returnflag", F.round("u", 1).alias("u"), F.round("z", 5).alias("z"), "n_full", "n_subset")


@query("SELECT a.g AS l_returnflag, 'l_extendedprice' AS column_name, a.m AS full_median, b.m AS subset_median, b.m > a.m AS superior FROM (SELECT l_returnflag AS g, median(l_extendedprice) AS m FROM lineitem GROUP BY 1) a JOIN (SELECT l_returnflag AS g, median(l_extendedprice) AS m FROM lineitem WHERE l_quantity > 20 GROUP BY 1) b USING (g)")
def superiority(t):
    return S.superior(t("lineitem"), t("lineitem").filter("l_quantity > 20"), "l_returnflag", ["l_extendedprice"])


# Quotas and samples


_SHARES = """
    WITH c AS (SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS yr, count(*) AS n FROM orders GROUP BY ALL),
    q AS (SELECT *, n / sum(n) OVER (PARTITION BY o_orderstatus) AS prop FROM c), f AS (SELECT *, greatest(1, CAST(floor(prop * 60) AS INTEGER)) AS q0 FROM q),
    d AS (SELECT *, 60 - sum(q0) OVER (PARTITION BY o_orderstatus) AS diff, row_number() OVER (PARTITION BY o_orderstatus ORDER BY prop DESC, yr, o_orderpriority) AS up, row_number() OVER (PARTITION BY o_orderstatus, q0 > 1 ORDER BY prop, yr, o_orderpriority) AS down FROM f),
    quota AS (SELECT o_orderstatus, o_orderpriority, yr, n, CAST(q0 + CASE WHEN diff > 0 AND up <= diff THEN 1 WHEN diff < 0 AND q0 > 1 AND down <= -diff THEN -1 ELSE 0 END AS INTEGER) AS quota FROM d)"""


def _quotas(t):
    counts = t("orders").groupBy("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))
    return P.quota_table(counts, ["yr", "o_orderpriority"], 60, ["o_orderstatus"]).drop("prop")


@query(_SHARES + " SELECT * FROM quota")
def quota_table(t):
    return _quotas(t)


@query(_SHARES + """ SELECT o_orderkey, o_orderstatus, o_orderpriority, yr FROM (
    SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, yr ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS rk FROM (SELECT *, year(o_orderdate) AS yr FROM orders) JOIN quota USING (o_orderstatus, o_orderpriority, yr)) WHERE rk <= quota""")
def stratified_sample(t):
    keys = ["o_orderstatus", "o_orderpriority", "yr"]
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("yr")).join(_quotas(t).select(*keys, "quota"), keys)
    return P.first_n(rows, keys, [P.hashed(F.col("o_orderkey")), F.col("o_orderkey")], 60, F.col("quota")).select("o_orderkey", *keys)


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 250")
def uniform_sample(t):
    return P.uniform_sample(t("orders").select("o_orderkey"), "o_orderkey", 250)


@query("""
    SELECT doc_id, quality, r <= round(n * 0.8) AS in_train FROM (
        SELECT *, row_number() OVER (PARTITION BY quality ORDER BY substr(md5(doc_id || '|42'), 1, 13)) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)""")
def train_test_split(t):
    return P.stratified_split(t("labels").select("doc_id", "quality"), "quality", "doc_id")


@query("""
    WITH r AS (SELECT DISTINCT role AS tier, conv_id FROM conversations), k AS (SELECT count(DISTINCT tier) AS k FROM r),
    p AS (SELECT tier, conv_id, row_number() OVER (PARTITION BY tier ORDER BY md5(conv_id || '|42'), conv_id) AS rn FROM r)
    SELECT conv_id, turn, role FROM conversations WHERE (role, conv_id) IN (SELECT (tier, conv_id) FROM p, k WHERE rn <= floor(60 / k))""")
def whole_reviews(t):
    return P.whole_reviews(t("conversations"), "role", "conv_id", 60).select("conv_id", "turn", "role")


@query()
def tiered_sample(t):
    """Compared with a plain version in the tests."""
    from .catalogue import works_for_sampling

    return P.tiered_sample(works_for_sampling(t), 300).select("work_id", "pop_tier", "publication_year", "genre_group", "series_flag", "pages_bin")
