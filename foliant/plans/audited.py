"""Queries of audits, gates, duplicates and repairs, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import core as O
from ..operators import quality as Q
from .cleaned import dealt
from .registry import query

_LABELLED = "(SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


def _labelled(t):
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")


_SEVERITY = "CASE WHEN {0} < 1 THEN 'minimal' WHEN {0} < 10 THEN 'moderate' WHEN {0} < 50 THEN 'significant' ELSE 'extensive' END"


def _each(columns, sql):
    return " UNION ALL ".join(sql(c) for c in columns)


@query(_each(("doc_id", "lang", "quality", "toxic"), lambda c: f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 2) AS pct_null, {_SEVERITY.format(f'count(*) FILTER ({c} IS NULL) * 100.0 / count(*)')} AS severity FROM {_LABELLED}"))
def missing_profile(t):
    return O.profile(_labelled(t), ["doc_id", "lang", "quality", "toxic"])


_MISSING = _each(("doc_id", "lang", "quality", "toxic"), lambda c: f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER ({'trim(lang) = ' + chr(39) * 2 if c == 'lang' else 'false'}) AS n_blank, count(*) FILTER ({c} IS NULL) * 100.0 / count(*) AS share FROM {_LABELLED}")


@query(f"""
    SELECT column_name, n_null, n_blank, round(share, 2) AS pct_null, CASE WHEN share > 0 THEN {_SEVERITY.format('share')} END AS severity,
           CASE WHEN share = 0 THEN NULL WHEN share < 10 THEN 'flag_for_analysis' WHEN share < 50 THEN 'flag_for_investigation' ELSE 'exclude_from_analysis' END AS strategy,
           CAST(row_number() OVER (ORDER BY n_null DESC, column_name) AS INTEGER) AS most_missing FROM ({_MISSING})""")
def missingness(t):
    return Q.missingness(_labelled(t))


@query("""
    SELECT 'quality' AS column_name, round(count(l.quality) * 100.0 / count(*), 4) AS complete_before, 100.0 AS complete_after, round(100 - count(l.quality) * 100.0 / count(*), 4) AS gain FROM documents LEFT JOIN labels l USING (doc_id)
    UNION ALL SELECT 'lang', round(count(lang) * 100.0 / count(*), 4), 100.0, round(100 - count(lang) * 100.0 / count(*), 4) FROM documents""")
def completeness(t):
    rows = _labelled(t)
    return Q.completeness(rows, Q.dropped_nulls(rows, ["quality"])[0], ["quality", "lang"])


@query(f"SELECT 'lang' AS column_name, count(*) FILTER (lang IS NULL) AS n_dropped FROM {_LABELLED} UNION ALL SELECT 'quality', count(*) FILTER (lang IS NOT NULL AND quality IS NULL) FROM {_LABELLED} UNION ALL SELECT 'toxic', count(*) FILTER (lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NULL) FROM {_LABELLED}")
def dropped_nulls(t):
    return Q.dropped_nulls(_labelled(t), ["lang", "quality", "toxic"])[1]


@query("SELECT 'o_orderkey' AS column_name, 'bigint' AS dtype, count(*) AS n_rows, CASE WHEN max(o_orderkey) < 32768 THEN 'smallint' ELSE 'int' END AS opportunity FROM orders UNION ALL SELECT 'o_totalprice', 'double', count(*), 'float' FROM orders UNION ALL SELECT 'o_orderstatus', 'string', count(*), CASE WHEN count(DISTINCT o_orderstatus) / count(*) < 0.5 THEN 'category' END FROM orders")
def type_audit(t):
    return Q.type_audit(t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")).select("column_name", "dtype", "n_rows", "opportunity")


@query("SELECT 'o_orderkey' AS column_name, 'bigint' AS \"before\", 'smallint' AS \"after\", count(*) FILTER (o_orderkey >= 32768) AS lost, count(*) * 6 AS saved_bytes FROM orders UNION ALL SELECT 'o_totalprice', 'double', 'float', 0, count(*) * 4 FROM orders")
def narrowing(t):
    return Q.narrowing_report(t("orders"), {"o_orderkey": "short", "o_totalprice": "float"})


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 32768 THEN o_orderkey END AS narrow FROM orders")
def narrowed_values(t):
    own = Q.narrowed(t("orders").withColumn("narrow", F.col("o_orderkey")), {"narrow": "short"})
    return own.select("o_orderkey", F.col("narrow").cast("long").alias("narrow"))


@query("SELECT 'c_acctbal' AS column_name, 0.0 AS low, 5000.0 AS high, count(*) FILTER (NOT c_acctbal BETWEEN 0 AND 5000) AS n_outside FROM customer UNION ALL SELECT 'c_nationkey', 0.0, 20.0, count(*) FILTER (NOT c_nationkey BETWEEN 0 AND 20) FROM customer")
def range_checks(t):
    return Q.range_checks(t("customer"), {"c_acctbal": (0, 5000), "c_nationkey": (0, 20)})


# Duplicates


@query("""
    WITH g AS (SELECT l_orderkey, l_partkey, count(*) AS n, min(l_linenumber) AS first_row, list(l_linenumber ORDER BY l_linenumber)[:20] AS m FROM lineitem GROUP BY ALL HAVING count(*) > 1)
    SELECT l_orderkey, l_partkey, n, first_row, array_to_string(m, ',') AS members FROM g""")
def duplicate_groups(t):
    out = Q.duplicate_groups(t("lineitem"), ["l_orderkey", "l_partkey"], "l_linenumber")
    return out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("""
    WITH g AS (SELECT l_partkey, l_suppkey, count(*) AS n, count(y) AS k, max(y) - min(y) AS span, min(l_linestatus) <> max(l_linestatus) AS several
               FROM (SELECT *, CASE WHEN l_quantity > 5 THEN year(l_shipdate) END AS y FROM lineitem) GROUP BY ALL HAVING count(*) > 1)
    SELECT l_partkey, l_suppkey, n, CASE WHEN k < 2 THEN 'unknown' WHEN span <= 1 THEN 'same_edition' WHEN span <= 5 THEN 'reprint' ELSE 'different_editions' END AS kind,
           CASE WHEN k < 2 THEN 'low' WHEN span <= 1 THEN 'high' ELSE 'medium' END AS confidence,
           CASE WHEN several OR k < 2 THEN 'manual_review' WHEN span <= 1 THEN 'keep_most_recent' WHEN span <= 5 THEN 'keep_original' ELSE 'keep_all' END AS action FROM g""")
def title_groups(t):
    rows = t("lineitem").withColumn("y", F.when(F.col("l_quantity") > 5, F.year("l_shipdate")))
    return Q.title_groups(rows, ["l_partkey", "l_suppkey"], "y", "l_linestatus")


_RESOLVED = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice) AS rn FROM lineitem) WHERE rn = 1)"


@query(f"WITH {_RESOLVED} SELECT l_orderkey, l_linenumber, CAST(count(*) OVER (PARTITION BY l_orderkey, l_partkey) > 1 AS INTEGER) AS title_duplicate_flag, CAST(count(*) OVER (PARTITION BY l_suppkey) > 1 AS INTEGER) AS author_id_duplicate_flag FROM r")
def resolved_duplicates(t):
    return Q.resolved(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice", ["l_orderkey", "l_partkey"], ["l_suppkey"]).select("l_orderkey", "l_linenumber", "title_duplicate_flag", "author_id_duplicate_flag")


@query(f"WITH {_RESOLVED} SELECT 'rows_before' AS metric, CAST(count(*) AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 'rows_after', count(*) FROM r UNION ALL SELECT 'duplicates_left', 0 UNION ALL SELECT 'flagged_keys', count(*) FILTER (f > 1) FROM (SELECT count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS f FROM r)")
def resolution_stats(t):
    after = Q.resolved(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice", ["l_orderkey", "l_partkey"], ["l_suppkey"])
    return Q.resolution_stats(t("lineitem"), after, ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) - count(DISTINCT (l_orderkey, l_partkey, l_suppkey)) AS surplus FROM lineitem")
def duplicate_triplets(t):
    return Q.surplus(t("lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])


# Anomalies


@query("SELECT 'before' AS metric, CAST(count(*) FILTER (year(o_orderdate) < 1993) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'after', count(*) FILTER (year(o_orderdate) > 1999) FROM orders UNION ALL SELECT 'last_three', count(*) FILTER (year(o_orderdate) BETWEEN 1997 AND 1999) FROM orders UNION ALL SELECT 'missing', count(*) FILTER (o_orderdate IS NULL) FROM orders UNION ALL SELECT 'least', min(year(o_orderdate)) FROM orders UNION ALL SELECT 'greatest', max(year(o_orderdate)) FROM orders")
def year_anomalies(t):
    return Q.year_anomalies(t("orders").withColumn("y", F.year("o_orderdate")), "y", 1993, 1999)


@query("SELECT o_orderpriority AS language, count(*) AS n FROM orders WHERE year(o_orderdate) < 1993 OR year(o_orderdate) > 1999 GROUP BY 1")
def suspicious_years(t):
    return Q.suspicious_years(t("orders").withColumn("y", F.year("o_orderdate")), "y", "o_orderpriority", 1993, 1999)


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996")
def year_range(t):
    return Q.years_within(t("orders").withColumn("y", F.year("o_orderdate")), "y", 1994, 1996).select("o_orderkey")


@query("SELECT 'text' AS column_name, m AS metric, v AS value FROM (SELECT CAST(count(*) FILTER (text IS NULL) AS DOUBLE) AS \"null\", CAST(count(*) FILTER (trim(text) = '') AS DOUBLE) AS blank, round(count(*) FILTER (coalesce(trim(text), '') = '') * 100.0 / count(*), 4)::DOUBLE AS share FROM documents) UNPIVOT (v FOR m IN (\"null\", blank, share))")
def text_gaps(t):
    return Q.text_gaps(t("documents"), ["text"])


@query("SELECT m AS metric, v AS value FROM (SELECT CAST(count(*) FILTER (p <= 0) AS DOUBLE) AS not_positive, CAST(count(*) FILTER (p > 0 AND p < 10) AS DOUBLE) AS short, CAST(count(*) FILTER (p > 2000) AS DOUBLE) AS long, CAST(count(*) FILTER (p IS NULL) AS DOUBLE) AS missing FROM (SELECT CASE WHEN l_tax > 0 THEN l_quantity - 8 END * 60 AS p FROM lineitem)) UNPIVOT (v FOR m IN (not_positive, short, long, missing))")
def page_anomalies(t):
    return Q.page_anomalies(t("lineitem").select((F.when(F.col("l_tax") > 0, F.col("l_quantity") - 8) * 60).alias("p")), "p")


@query("SELECT m AS metric, v AS value FROM (SELECT CAST(count(*) FILTER (r < 0 OR r > 5) AS DOUBLE) AS r_impossible, CAST(count(*) FILTER (r IS NULL) AS DOUBLE) AS r_missing, CAST(count(*) FILTER (c_acctbal < 0) AS DOUBLE) AS c_acctbal_negative FROM (SELECT c_acctbal, CASE WHEN c_nationkey > 2 THEN c_acctbal / 1500 END AS r FROM customer)) UNPIVOT (v FOR m IN (r_impossible, r_missing, c_acctbal_negative))")
def rating_anomalies(t):
    return Q.rating_anomalies(t("customer").withColumn("r", F.when(F.col("c_nationkey") > 2, F.col("c_acctbal") / 1500)), "r", ["c_acctbal"])


@query("""
    WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'o_orderpriority' AS column_name, CAST(sum(n) AS BIGINT) AS n_values, count(v) AS n_distinct, array_to_string(list(v || '=' || n ORDER BY n DESC, v)[:2], ';') AS top, max(n) * 100.0 / sum(n) > 90 AS dominant FROM c
    UNION ALL SELECT 'o_orderstatus', CAST(sum(n) AS BIGINT), count(v), array_to_string(list(v || '=' || n ORDER BY n DESC, v)[:2], ';'), max(n) * 100.0 / sum(n) > 90 FROM s""")
def category_audit(t):
    return Q.categories(t("orders"), ["o_orderpriority", "o_orderstatus"], 2).select("column_name", "n_values", "n_distinct", F.array_join("top_values", ";").alias("top"), "dominant")


@query("SELECT round(greatest(0, 100 - least(o * 100.0 / n * 0.5, 30) - least(c * 100.0 / n * 2, 50)), 6) AS score FROM (SELECT count(*) AS n, count(*) FILTER (c_acctbal > 9000) AS o, count(*) FILTER (c_acctbal < 0) AS c FROM customer)")
def outlier_score(t):
    score = Q.quality_score(F.count_if(F.col("c_acctbal") > 9000), F.count("*"), F.count_if(F.col("c_acctbal") < 0))
    return t("customer").agg(F.round(score, 6).alias("score"))


# Repairs, steps and gates


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS series_works_count, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS series_id, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS series_title FROM customer")
def negative_repair(t):
    own = t("customer").select("c_custkey", F.col("c_acctbal").alias("series_works_count"), F.col("c_nationkey").alias("series_id"), F.col("c_mktsegment").alias("series_title"))
    return Q.repaired_series(own)


@query("""
    WITH f AS (SELECT year(o_orderdate) BETWEEN 1993 AND 1998 AS a, o_totalprice > 100000 AS b, o_orderstatus <> 'F' AS c FROM orders), n AS (SELECT count(*) AS t, count(*) FILTER (a) AS a, count(*) FILTER (a AND b) AS b, count(*) FILTER (a AND b AND c) AS c FROM f)
    SELECT 'years' AS step, t AS n_before, a AS n_after, t - a AS n_removed FROM n UNION ALL SELECT 'priced', a, b, a - b FROM n UNION ALL SELECT 'status', b, c, b - c FROM n""")
def cleaning_steps(t):
    return Q.cleaning_steps(t("orders"), {"years": F.year("o_orderdate").between(1993, 1998), "priced": F.col("o_totalprice") > 100000, "status": F.col("o_orderstatus") != "F"})[1]


_NULLED = "count(*) FILTER (quality IS NULL) > 0"


@query(f"""
    SELECT 'step1_3' AS component, 'duplicate_flags' AS "check", true AS passed UNION ALL SELECT 'step1_3', 'missing_values', (SELECT CAST({_NULLED} AS INTEGER) * 2 < 2.5 FROM {_LABELLED}) UNION ALL SELECT 'step1_3', 'data_types', false
    UNION ALL SELECT 'step4', 'years', true UNION ALL SELECT 'step4', 'fields', true UNION ALL SELECT 'step4', 'row_count', true UNION ALL SELECT 'step5', 'narrow_types', false UNION ALL SELECT 'step5', 'kept_columns', true""")
def step_gates(t):
    rows = _labelled(t).select("doc_id", "lang", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")).withColumn("year", (F.col("doc_id") % 10 + 2000))
    return Q.step_scores(rows, ["lang"], "year", (2000, 2009), ["quality", "toxic"], None)


def _component_scores(t):
    spark = t("region").sparkSession
    return spark.createDataFrame([("step1_3", 100.0), ("step4", 200 / 3), ("step5", 100.0)], "component string, score double")


@query("SELECT * FROM (VALUES ('completeness', 95.0, 100.0, true), ('consistency', 90.0, 66.666667, false), ('integrity', 98.0, 100.0, true), ('optimization', 95.0, 100.0, true), ('overall', 90.0, 90.0, true)) v(gate, threshold, achieved, passed)")
def quality_gates(t):
    return Q.gates(_component_scores(t)).withColumn("achieved", F.round("achieved", 6))


@query("SELECT 90.0 AS overall_score, 'Good' AS level, 'Certified' AS status, 4 AS gates_passed, 5 AS gates_total")
def certificate(t):
    return Q.certificate(Q.gates(_component_scores(t))).withColumn("overall_score", F.round("overall_score", 6))


@query(r"SELECT 'html' AS column_name, count(html) AS n, count(*) FILTER (html IS NULL) AS n_null, round(avg(length(html)), 4) AS mean_length, max(length(html)) AS max_length, count(*) FILTER (regexp_matches(html, '<[^>]+>|&[a-zA-Z0-9#]+;')) AS n_markup, count(*) FILTER (regexp_matches(html, '[\r\n]')) AS n_line_breaks, count(*) FILTER (regexp_matches(html, '\s{2,}')) AS n_spaces FROM pages")
def text_profile(t):
    return Q.text_profile(t("pages"), ["html"]).withColumn("mean_length", F.round("mean_length", 4))


@query(r"""SELECT 'html_markup' AS "check", count(*) FILTER (regexp_matches(html, '<[^>]+>|&[a-zA-Z0-9#]+;')) AS n_failed FROM pages UNION ALL SELECT 'url_format', count(*) FILTER (regexp_matches(url, '^,|,$|,,|\s,|,\s|[A-Z]')) FROM pages""")
def text_gate(t):
    return Q.text_gate(t("pages"), ["html"], ["url"])


@query("""
    WITH l AS (SELECT string_split(p_name, ' ') AS w FROM part), s AS (SELECT count(*) AS rows, min(len(w)) AS least, max(len(w)) AS greatest, avg(len(w)) AS mean, stddev_samp(len(w)) AS std, sum(len(w)) AS items, median(len(w)) AS median FROM l)
    SELECT m AS metric, round(v, 6) AS value FROM (SELECT CAST(rows AS DOUBLE) AS rows, CAST(0 AS DOUBLE) AS empty, CAST(least AS DOUBLE) AS least, CAST(greatest AS DOUBLE) AS greatest, mean, std, CAST(items AS DOUBLE) AS items, CAST(median AS DOUBLE) AS median, CAST((SELECT count(DISTINCT x) FROM (SELECT unnest(w) AS x FROM l)) AS DOUBLE) AS distinct_items FROM s)
    UNPIVOT (v FOR m IN (rows, empty, least, greatest, mean, std, items, median, distinct_items))""")
def list_statistics(t):
    return Q.list_statistics(t("part").select(F.split("p_name", " ").alias("w")), "w").withColumn("value", F.round("value", 6))


@query("""
    WITH a AS (SELECT o_orderstatus AS metric, CAST(count(*) AS DOUBLE) AS a FROM orders WHERE o_totalprice > 200000 GROUP BY 1), b AS (SELECT o_orderstatus AS metric, CAST(count(*) AS DOUBLE) AS b FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
    SELECT coalesce(a.metric, b.metric) AS metric, a, b, b - a AS change FROM a FULL JOIN b ON a.metric = b.metric""")
def run_difference(t):
    count = lambda df: df.groupBy(F.col("o_orderstatus").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return Q.run_difference(count(t("orders").filter("o_totalprice > 200000")), count(t("orders").filter("o_orderstatus != 'P'")))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 46)")
def anti_unmatched(t):
    return t("part").join(t("lineitem").filter("l_quantity > 46"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey", "p_name")


@query(r"""
    WITH d AS (SELECT lang, source, length(text) AS c, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS w, quality AS q FROM documents LEFT JOIN labels USING (doc_id)),
    p AS (SELECT lang, source, count(*) AS n FROM d GROUP BY ALL)
    SELECT lang, count(*) AS reviews, round(avg(c), 4) AS mean_chars, median(c) AS median_chars, round(avg(w), 4) AS mean_words, median(w) AS median_words, round(avg(q), 4) AS mean_rating, median(q) AS median_rating, count(q) AS rated,
           (SELECT count(*) FROM p WHERE p.lang = d.lang) AS works, (SELECT round(avg(n), 4) FROM p WHERE p.lang = d.lang) AS mean_per_work, (SELECT median(n) FROM p WHERE p.lang = d.lang) AS median_per_work FROM d GROUP BY lang""")
def tier_summary(t):
    rows = t("documents").select("doc_id", "lang", "source", "text").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    out = Q.tier_summary(rows, "lang", "source", "text", "quality")
    return out.withColumns({c: F.round(c, 4) for c in ("mean_chars", "mean_words", "mean_rating", "mean_per_work")})


_TEXT_LISTS = ["['1', '2']", "a;b", "", None, "nan", "x"]


@query(f"SELECT m AS metric, round(v, 4) AS value FROM (SELECT CAST(count(*) FILTER (k NOT IN (2, 3)) AS DOUBLE) AS given, CAST(count(*) FILTER (k IN (0, 1, 5)) AS DOUBLE) AS parsed, CAST(count(*) FILTER (k IN (2, 3, 4)) AS DOUBLE) AS empty, count(*) FILTER (k IN (0, 1, 5)) * 100.0 / count(*) FILTER (k NOT IN (2, 3)) AS success_pct, count(*) FILTER (k = 0) * 200.0 / (count(*) FILTER (k IN (0, 1)) * 2 + count(*) FILTER (k = 5)) AS numeric_pct FROM (SELECT p_partkey % {len(_TEXT_LISTS)} AS k FROM part)) UNPIVOT (v FOR m IN (given, parsed, empty, success_pct, numeric_pct))")
def list_validation(t):
    own = t("part").select(dealt(_TEXT_LISTS).alias("x")).withColumn("items", C.parsed_list(F.col("x")))
    return Q.list_validation(own, "x", "items").withColumn("value", F.round("value", 4))
