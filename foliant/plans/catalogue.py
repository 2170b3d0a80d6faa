"""Queries of the work build over the driver's order lines, which play the editions, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binning as B
from ..operators import quality as Q
from ..operators import works as K
from .registry import query

#: Order lines as editions: one SQL view and the same as columns.
_EDITIONS = """
    e AS (SELECT l_partkey AS work_id, l_orderkey || '-' || l_linenumber AS book_id, CASE WHEN l_quantity > 10 THEN 'Title ' || l_orderkey END AS title,
                 CASE WHEN l_quantity > 5 THEN repeat('d', CAST(l_quantity AS INTEGER) % 7) || l_linestatus END AS description,
                 CASE l_returnflag WHEN 'A' THEN 'eng' WHEN 'N' THEN 'en-US' ELSE 'fre' END AS language_code, year(l_shipdate) + 6 AS publication_year, CAST(l_quantity AS DOUBLE) * 10 - 20 AS num_pages,
                 CASE WHEN l_discount <> 0.05 THEN l_linenumber * 100 END AS ratings_count, l_linenumber AS text_reviews_count, CASE WHEN l_tax > 0.005 THEN round(l_tax * 50, 2) END AS average_rating,
                 CASE WHEN l_linenumber > 1 THEN CAST(l_suppkey AS VARCHAR) END AS author, CASE WHEN l_linenumber = 1 THEN CAST(l_orderkey % 20 AS VARCHAR) END AS series, [l_returnflag, l_linestatus, 'x' || l_linenumber] AS shelves,
                 (l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS line FROM lineitem),
    en AS (SELECT * FROM e WHERE language_code <> 'fre')"""


def editions(t):
    n = F.col("l_linenumber")
    text = lambda c: F.col(c).cast("string")
    return t("lineitem").select(
        F.col("l_partkey").alias("work_id"), F.concat(text("l_orderkey"), F.lit("-"), text("l_linenumber")).alias("book_id"), F.when(F.col("l_quantity") > 10, F.concat(F.lit("Title "), text("l_orderkey"))).alias("title"),
        F.when(F.col("l_quantity") > 5, F.concat(F.repeat(F.lit("d"), F.col("l_quantity").cast("int") % 7), F.col("l_linestatus"))).alias("description"),
        F.when(F.col("l_returnflag") == "A", "eng").when(F.col("l_returnflag") == "N", "en-US").otherwise("fre").alias("language_code"), (F.year("l_shipdate") + 6).alias("publication_year"), (F.col("l_quantity") * 10 - 20).alias("num_pages"),
        F.when(F.col("l_discount") != 0.05, n * 100).alias("ratings_count"), n.alias("text_reviews_count"), F.when(F.col("l_tax") > 0.005, F.round(F.col("l_tax") * 50, 2)).alias("average_rating"),
        F.when(n > 1, F.array(F.struct(text("l_suppkey").alias("author_id")))).alias("authors"), F.when(n == 1, F.array((F.col("l_orderkey") % 20).cast("string"))).alias("series"),
        F.array(*(F.struct(c.alias("name")) for c in (F.col("l_returnflag"), F.col("l_linestatus"), F.concat(F.lit("x"), text("l_linenumber"))))).alias("popular_shelves"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("line"),
    )


def sources(t):
    works = t("part").select(F.col("p_partkey").alias("work_id"), F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_name"), F.lit(" (deluxe)"))).alias("original_title"), F.when(F.col("p_size") % 3 == 1, " ").alias("best_book_title"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("title"), F.when(F.col("p_size") > 25, (F.col("p_size") + 1980).cast("string")).otherwise("0").alias("original_publication_year"))
    authors = t("supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("average_rating"), F.col("s_nationkey").alias("ratings_count")).filter("author_id % 5 != 0")
    series = t("nation").select(F.col("n_nationkey").alias("series_id"), F.col("n_name").alias("title"), (F.col("n_regionkey") - 1).alias("series_works_count")).filter("series_id < 18")
    genres = t("lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("book_id"), F.create_map("l_returnflag", F.lit(1), "l_linestatus", F.lit(2)).alias("genres"))
    return works, authors, series, genres


def built(t):
    return K.build_works(editions(t), *sources(t))


_ROLLED = """
    r AS (SELECT work_id, CAST(coalesce(sum(ratings_count), 0) AS BIGINT) AS ratings_count_sum, CAST(sum(text_reviews_count) AS BIGINT) AS text_reviews_count_sum,
                 CASE WHEN count(*) FILTER (ratings_count IS NOT NULL AND average_rating IS NOT NULL) = count(ratings_count) AND sum(ratings_count) > 0 THEN sum(average_rating * ratings_count) / sum(ratings_count) END AS mean_rating,
                 median(floor(num_pages)) FILTER (floor(num_pages) > 0) AS pages, array_to_string(list(book_id ORDER BY coalesce(ratings_count, 0) DESC, book_id), ',') AS ids, array_to_string(list_sort(list_distinct(list(language_code))), ',') AS languages,
                 coalesce(first(description ORDER BY length(description) DESC, line) FILTER (description IS NOT NULL), '') AS description, array_to_string(list_sort(list_distinct(flatten(list(shelves)))), ',') AS shelves,
                 first(title ORDER BY line) FILTER (title IS NOT NULL) AS edition_title, CAST(floor(median(publication_year)) AS INTEGER) AS edition_year, count(*) AS n_editions
          FROM en GROUP BY work_id)"""


@query(f"WITH {_EDITIONS}, {_ROLLED} SELECT work_id, ratings_count_sum, text_reviews_count_sum, round(mean_rating, 6) AS mean_rating, pages, ids, languages, description, shelves, edition_title, edition_year, n_editions FROM r")
def edition_rollup(t):
    out = K.edition_rollup(editions(t).filter("language_code != 'fre'"))
    return out.select("work_id", "ratings_count_sum", "text_reviews_count_sum", F.round("average_rating_weighted_mean", 6).alias("mean_rating"), F.col("num_pages_median").alias("pages"), F.array_join("book_id_list_en", ",").alias("ids"), F.array_join("language_codes_en", ",").alias("languages"), "description", F.col("popular_shelves").alias("shelves"), "edition_title", "edition_year", "n_editions")


_BUILT = f"""
    WITH {_EDITIONS}, {_ROLLED},
    a AS (SELECT work_id, author FROM (SELECT work_id, author, row_number() OVER (PARTITION BY work_id ORDER BY count(*) DESC, coalesce(sum(ratings_count), 0) DESC, author) AS rn FROM en WHERE author IS NOT NULL GROUP BY work_id, author) WHERE rn = 1),
    s AS (SELECT work_id, first(series ORDER BY line) FILTER (series IS NOT NULL) AS series_id FROM e GROUP BY work_id),
    gi AS (SELECT l_orderkey || '-' || l_linenumber AS book_id, l_returnflag AS g FROM lineitem UNION SELECT l_orderkey || '-' || l_linenumber, l_linestatus FROM lineitem),
    g AS (SELECT work_id, array_to_string(list_sort(list_distinct(list(g))), ',') AS genres FROM en JOIN gi USING (book_id) GROUP BY work_id),
    w AS (SELECT r.*, p_name, p_size, p_brand, a.author, s.series_id, g.genres, CASE WHEN p_size > 25 AND p_size + 1980 BETWEEN 1800 AND 2030 THEN p_size + 1980 ELSE edition_year END AS yr
          FROM r LEFT JOIN part ON p_partkey = r.work_id LEFT JOIN a USING (work_id) LEFT JOIN s USING (work_id) LEFT JOIN g USING (work_id)),
    b AS (SELECT work_id, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 2 = 0 THEN p_brand ELSE coalesce(edition_title, 'Untitled') END AS title, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 2 = 0 THEN 2 WHEN edition_title IS NOT NULL THEN 3 ELSE 4 END AS title_source,
                 CAST(yr AS INTEGER) AS publication_year, genres, author AS author_id, coalesce(s_name, '') AS author_name, coalesce(s_acctbal, 0.0) AS author_average_rating, coalesce(s_nationkey, 0) AS author_ratings_count, series_id,
                 n_name AS series_title, n_regionkey - 1 AS series_works_count, ratings_count_sum, ids, round(mean_rating, 6) AS mean_rating, pages, text_reviews_count_sum
          FROM w LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) ON CAST(s_suppkey AS VARCHAR) = author LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 18) ON CAST(n_nationkey AS VARCHAR) = series_id WHERE yr BETWEEN 2000 AND 2020)"""


@query(_BUILT + " SELECT work_id, title, title_source, publication_year, genres, author_id, author_name, author_average_rating, author_ratings_count, series_id, series_title, series_works_count, ratings_count_sum, ids, mean_rating FROM b")
def work_build(t):
    return built(t).select("work_id", "title", "title_source", "publication_year", "genres", "author_id", "author_name", "author_average_rating", "author_ratings_count", "series_id", "series_title", "series_works_count", "ratings_count_sum", F.array_join("book_id_list_en", ",").alias("ids"), F.round("average_rating_weighted_mean", 6).alias("mean_rating"))


@query("""
    SELECT l_partkey, l_suppkey FROM (
        SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, q DESC, CAST(l_suppkey AS VARCHAR)) AS rn
        FROM (SELECT l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey, count(*) AS n, sum(l_linenumber) AS q FROM lineitem GROUP BY ALL)) WHERE rn = 1""")
def primary_owner(t):
    own = t("lineitem").select(F.col("l_partkey").alias("work_id"), F.array(F.struct(F.col("l_suppkey").alias("author_id"))).alias("authors"), F.col("l_linenumber").alias("ratings_count"))
    return K.primary_author(own).select(F.col("work_id").alias("l_partkey"), F.col("author_id").alias("l_suppkey"))


@query(_BUILT + " SELECT len(string_split(ids, ',')) AS n_editions, count(*) AS n_works FROM b GROUP BY 1")
def editions_per_work(t):
    return K.editions_per_work(built(t)).select(F.col("n_editions").cast("long").alias("n_editions"), "n_works")


@query(_BUILT + " SELECT author_id, min(author_name) AS author_name, CAST(sum(ratings_count_sum) AS BIGINT) AS ratings_count_sum, count(*) AS n_works FROM b WHERE author_id IS NOT NULL GROUP BY 1")
def author_rollup(t):
    return K.author_rollup(built(t)).select("author_id", "author_name", "ratings_count_sum", "n_works")


_CHECKS = {"empty_work_id": "work_id IS NULL", "empty_title": "title IS NULL", "empty_book_list": "ids = ''", "year_outside": "NOT publication_year BETWEEN 2000 AND 2020"}


@query(_BUILT + " UNION ALL ".join(f" SELECT '{k}' AS \"check\", count(*) FILTER ({v}) AS n_failed FROM b" for k, v in _CHECKS.items()))
def build_gate(t):
    return Q.build_gate(built(t))


@query(_BUILT + ", m AS (SELECT unnest(string_split(ids, ',')) AS book_id, work_id FROM b) SELECT doc_id, work_id, title FROM (SELECT doc_id, (doc_id * 7) || '-' || (doc_id % 7 + 1) AS book_id FROM documents) LEFT JOIN (SELECT book_id, max(work_id) AS work_id FROM m GROUP BY 1) USING (book_id) LEFT JOIN b USING (work_id)")
def joined_reviews(t):
    book = F.concat((F.col("doc_id") * 7).cast("string"), F.lit("-"), (F.col("doc_id") % 7 + 1).cast("string"))
    reviews = t("documents").select("doc_id", book.alias("book_id"))
    return K.joined_reviews(reviews, built(t).select("work_id", "title", "book_id_list_en"), "left").select("doc_id", "work_id", "title")


@query(_BUILT + " SELECT count(DISTINCT id) AS n_books FROM (SELECT unnest(string_split(ids, ',')) AS id FROM b WHERE work_id % 10 = 0)")
def two_hop_books(t):
    works = built(t)
    return K.books_of_works(works, works.filter("work_id % 10 = 0")).agg(F.count("*").alias("n_books"))


def works_for_sampling(t):
    """Works with the columns that the stratified sample reads."""
    own = built(t).withColumn("series_flag", F.col("series_id").isNotNull().cast("int")).withColumn("genre_group", F.concat(F.lit("g"), (F.col("work_id") % 3).cast("string")))
    own = B.tiers(own, "author_average_rating", "pop_tier")
    return own.withColumn("pages_bin", F.concat(F.lit("Q"), (F.col("num_pages_median") % 4).cast("int").cast("string")))
