"""Named queries over the driver's tables, each beside the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binning as B
from ..functions import text as X
from ..operators import core as O
from ..session import table
from ..streaming import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table getter as a query named like it."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# Roll-ups and joins


@query("SELECT source, doc_id, size FROM (SELECT source, doc_id, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def longest_text(t):
    # max_by in a map-side combined aggregate: no window over a source's rows.
    best = t("documents").groupBy("source").agg(F.max(F.struct(F.length("text").alias("size"), (-F.col("doc_id")).alias("neg"))).alias("b"))
    return best.select("source", (-F.col("b.neg")).alias("doc_id"), F.col("b.size").cast("long").alias("size"))


@query("SELECT o_orderkey, coalesce(nullif(c_mktsegment, ''), nullif(o_orderpriority, ''), 'unknown') AS title FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def title_fallback(t):
    some = t("customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    filled = F.coalesce(F.nullif("c_mktsegment", F.lit("")), F.nullif("o_orderpriority", F.lit("")), F.lit("unknown"))
    return t("orders").join(some, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", filled.alias("title"))


@query("SELECT n_name, r_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name, r_name")
def id_map_join(t):
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("n_name", "r_name").agg(F.countDistinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_keys(t):
    return t("orders").join(t("lineitem").filter("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_written(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(n, 0) > 0 AS has_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def coverage_table(t):
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t("customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), (F.coalesce("n", F.lit(0)) > 0).alias("has_orders"))


@query("""
    WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
    SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS in_both, count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right FROM a FULL JOIN b ON a.k = b.k""")
def key_coverage(t):
    sides = t("customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(t("orders").select(F.col("o_custkey").alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    keys = sides.groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))  # one aggregate instead of a full join
    n = lambda cond: F.count(F.when(cond, 1))
    return keys.agg(n(F.col("l") + F.col("r") == 2).alias("in_both"), n(F.col("r") == 0).alias("only_left"), n(F.col("l") == 0).alias("only_right"))


# Bins, filters, counts


@query("SELECT event_id, try_cast(nullif(regexp_extract(props, '\"k\": ([0-9]+)', 1), '') AS DOUBLE) AS k, coalesce(try_cast(event_type AS DOUBLE), 0.0) AS coerced FROM events")
def null_token_coerce(t):
    k = F.get_json_object("props", "$.k")
    return t("events").select("event_id", X.coerce_number(k).alias("k"), X.coerce_number(F.col("event_type"), 0).alias("coerced"))


@query("SELECT (year(o_orderdate) // 10) * 10 AS decade, count(*) AS n FROM orders GROUP BY 1")
def decade_bins(t):
    return t("orders").groupBy(B.decade(F.year("o_orderdate")).alias("decade")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_size >= 0 AND p_size <= 10 THEN 'short' WHEN p_size <= 25 THEN 'medium' WHEN p_size <= 40 THEN 'long' ELSE 'very long' END AS bin, count(*) AS n FROM part GROUP BY 1")
def fixed_bins(t):
    return t("part").groupBy(B.fixed_bins(F.col("p_size"), [0, 10, 25, 40, float("inf")], ["short", "medium", "long", "very long"]).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE n >= 2 AND q >= 50")
def engagement_cuts(t):
    busy = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")).filter("n >= 2 and q >= 50")
    return t("orders").join(busy, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM orders GROUP BY 1")
def value_counts(t):
    return O.value_counts(t("orders"), "o_orderpriority")


@query("SELECT word, count(*) AS n, count(DISTINCT p_partkey) AS works FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word NOT IN ('large') GROUP BY word")
def multi_counts(t):
    return t("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).filter("word not in ('large')").groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("works"))


# Profiles


_LABELLED = "(SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"SELECT doc_id, quality IS NULL AS quality_missing, toxic IS NULL AS toxic_missing FROM {_LABELLED}")
def missing_flags(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select("doc_id", F.col("quality").isNull().alias("quality_missing"), F.col("toxic").isNull().alias("toxic_missing"))


@query("SELECT count(*) AS processed, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (lang = 'en' AND length(text) >= 500) AS long_enough, round(count(*) FILTER (lang = 'en') * 100.0 / count(*), 2) AS pct_english FROM documents")
def funnel(t):
    n = lambda c: F.count(F.when(c, 1))
    en = F.col("lang") == "en"
    return t("documents").agg(F.count("*").alias("processed"), n(en).alias("english"), n(en & (F.length("text") >= 500)).alias("long_enough"), F.round(n(en) * 100.0 / F.count("*"), 2).alias("pct_english"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean_value, round(stddev_samp(value), 4) AS std_value FROM events GROUP BY event_type")
def category_profile(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.stddev_samp("value"), 4).alias("std_value"))


# Duplicates


@query("SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id, count(*) - 1 AS extra FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dups(t):
    return t("documents").groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), (F.count("*") - 1).alias("extra")).filter("n > 1")


@query("""
    WITH g AS (SELECT l_partkey, l_suppkey, count(*) AS n, max(year(l_shipdate)) - min(year(l_shipdate)) AS span FROM lineitem GROUP BY ALL HAVING count(*) > 1)
    SELECT l_partkey, l_suppkey, n, span, CASE WHEN span <= 1 THEN 'same_edition' WHEN span <= 5 THEN 'reprint' ELSE 'different_editions' END AS kind FROM g""")
def dup_class(t):
    year = F.year("l_shipdate")
    g = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), (F.max(year) - F.min(year)).cast("long").alias("span")).filter("n > 1")
    return g.withColumn("kind", F.when(F.col("span") <= 1, "same_edition").when(F.col("span") <= 5, "reprint").otherwise("different_editions"))


@query("SELECT p_name, count(DISTINCT p_partkey) AS ids FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1")
def id_conflicts(t):
    return t("part").groupBy("p_name").agg(F.countDistinct("p_partkey").alias("ids")).filter("ids > 1")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1")
def first_by_key(t):
    first = t("conversations").groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("f"))
    return first.select("conv_id", "f.turn", "f.role")


# Outliers, samples, distributions


@query("""
    WITH b AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, quantile_cont(o_totalprice, 0.01) AS p1, quantile_cont(o_totalprice, 0.99) AS p99 FROM orders),
    f AS (SELECT o_orderkey, abs((o_totalprice - m) / s) > 3 AS by_z, o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1) AS by_iqr, o_totalprice < p1 OR o_totalprice > p99 AS by_pct FROM orders, b)
    SELECT *, by_z OR by_iqr OR by_pct AS by_any FROM f""")
def outliers_union(t):
    return O.outliers(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "by_z", "by_iqr", "by_pct", "by_any")


@query("SELECT yr, o_orderstatus, o_orderkey, o_totalprice FROM (SELECT year(o_orderdate) AS yr, *, row_number() OVER (PARTITION BY year(o_orderdate), o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topn_per_cell(t):
    rows = t("orders").select(F.year("o_orderdate").cast("long").alias("yr"), "o_orderstatus", "o_orderkey", "o_totalprice")
    return O.ranked(rows, ["yr", "o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")]).filter("rn <= 3").drop("rn")


@query("""
    WITH g AS (SELECT o_orderstatus = 'F' AS f, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1)
    SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 4) AS d FROM g a, g b WHERE a.f AND NOT b.f""")
def cohens_d(t):
    o, x = t("orders"), F.col("o_totalprice")
    side = lambda s: F.when(F.col("o_orderstatus") == s, x)
    na, nb = F.count(side("F")), F.count(side("O"))
    pooled = F.sqrt(((na - 1) * F.var_samp(side("F")) + (nb - 1) * F.var_samp(side("O"))) / (na + nb - 2))
    return o.agg(F.round((F.avg(side("F")) - F.avg(side("O"))) / pooled, 4).alias("d"))


# Text


@query("SELECT event_id, array_to_string(json_keys(props), ',') AS keys, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_map_keys(t):
    return t("events").select("event_id", F.array_join(F.json_object_keys("props"), ",").alias("keys"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(r"SELECT doc_id, len(s) AS n_sentences, max_len FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]+)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s, list_max(list_transform(s, lambda x: length(x))) AS max_len FROM documents WHERE lang = 'en')")
def sentence_counts(t):
    s = t("documents").filter("lang = 'en'").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("max_len"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS idx, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part)")
def bridge_long(t):
    return t("part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("idx", "word")).select("p_partkey", (F.col("idx") + 1).cast("long").alias("idx"), "word")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON regexp_extract(c_name, '([0-9]+)', 1) = regexp_extract(s_name, '([0-9]+)', 1) AND c_nationkey = s_nationkey")
def exact_match(t):
    key = lambda c: F.regexp_extract(c, "([0-9]+)", 1)
    return t("customer").join(t("supplier"), (key("c_name") == key("s_name")) & (F.col("c_nationkey") == F.col("s_nationkey"))).select("c_custkey", "s_suppkey")


# Profiles of tails, boxes, dates and keys


@query("""
    WITH e AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
    f AS (SELECT o_orderstatus, o_totalprice AS x, q1, q2, q3, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM orders JOIN e USING (o_orderstatus))
    SELECT o_orderstatus, count(*) AS n, round(max(q1), 4) AS q1, round(max(q2), 4) AS q2, round(max(q3), 4) AS q3, round(min(x) FILTER (inside), 4) AS low, round(max(x) FILTER (inside), 4) AS high, count(*) FILTER (NOT inside) AS beyond FROM f GROUP BY 1""")
def boxplot_data(t):
    return O.box(t("orders"), "o_orderstatus", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS n FROM lineitem) WHERE n > 1")
def key_dups(t):
    keys = ["l_orderkey", "l_partkey"]
    repeated = t("lineitem").groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return t("lineitem").join(repeated, keys, "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT y.y AS yr, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(1990, 2003)) AS INTEGER) AS y) y LEFT JOIN (SELECT year(o_orderdate) AS yr, count(*) AS n FROM orders GROUP BY 1) ON yr = y.y")
def year_counts_filled(t):
    orders = t("orders")
    years = orders.sparkSession.range(1990, 2003).select(F.col("id").cast("int").alias("yr"))
    counts = orders.groupBy(F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))
    return years.join(counts, "yr", "left").select("yr", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT 'c_acctbal' AS column_name, count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (c_acctbal = 0) AS zero FROM customer UNION ALL SELECT 's_acctbal', count(*) FILTER (s_acctbal < 0), count(*) FILTER (s_acctbal = 0) FROM supplier")
def negative_scan(t):
    one = lambda name, c: t(name).agg(F.count_if(F.col(c) < 0).alias("negative"), F.count_if(F.col(c) == 0).alias("zero")).select(F.lit(c).alias("column_name"), "negative", "zero")
    return one("customer", "c_acctbal").unionByName(one("supplier", "s_acctbal"))


@query("WITH w AS (SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity > 0) SELECT cut, (SELECT count(*) FROM lineitem) AS before, (SELECT count(*) FROM lineitem WHERE l_quantity >= cut) AS after, round((SELECT count(*) FROM lineitem WHERE l_quantity >= cut) * 100.0 / (SELECT count(*) FROM lineitem), 2) AS pct FROM (SELECT unnest([5, 10, 25]) AS cut), w")
def cut_impact(t):
    one = t("lineitem").agg(F.count("*").alias("before"), *(F.count_if(F.col("l_quantity") >= c).alias(f"c{c}") for c in (5, 10, 25)))
    rows = one.select("before", F.explode(F.array(*(F.struct(F.lit(c).alias("cut"), F.col(f"c{c}").alias("after")) for c in (5, 10, 25)))).alias("x")).select("before", "x.*")
    return rows.select("cut", "before", "after", F.round(F.col("after") * 100.0 / F.col("before"), 2).alias("pct"))


# Titles, words, matches, events


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: CASE WHEN x IN ('large', 'small') THEN '1' ELSE '0' END), '') AS flags, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('large', 'small')), ' ') AS content FROM part")
def bridge_flags(t):
    words, noise = F.split("p_name", " "), ["large", "small"]
    return t("part").select("p_partkey", F.array_join(F.transform(words, lambda x: F.when(x.isin(noise), "1").otherwise("0")), "").alias("flags"), F.array_join(F.filter(words, lambda x: ~x.isin(noise)), " ").alias("content"))


@query("SELECT count(DISTINCT p_partkey) AS works, count(*) AS tags, count(DISTINCT w) AS distinct_tags, round(count(*) * 1.0 / count(DISTINCT p_partkey), 4) AS mean_tags FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)")
def bridge_summary(t):
    long = t("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    return long.agg(F.countDistinct("p_partkey").alias("works"), F.count("*").alias("tags"), F.countDistinct("w").alias("distinct_tags")).withColumn("mean_tags", F.round(F.col("tags") / F.col("works"), 4))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(t):
    counts = W.windowed_counts(t("events"), "ts", "event_type", "1 hour")
    return counts.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
