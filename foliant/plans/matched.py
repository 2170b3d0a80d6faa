"""Queries of matches and aliases. SQL has the Damerau-Levenshtein distance, but neither the indel ratio nor this Jaro-Winkler similarity, which halves transpositions without rounding: what is made of those is compared with
brute force in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..operators import matching as M
from .registry import query


def _sides(t):
    """Documents as titled texts: every tenth is a query against all."""
    words = F.split(F.col("text"), r"[ \t\n\f\r]+", 9)  # eight words and the rest
    own = t("documents").select("doc_id", F.array_join(F.slice(words, 1, 3), " ").alias("author"), F.array_join(F.slice(words, 4, 5), " ").alias("title")).filter("title != ''")
    return own.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "ext_id"), own.withColumnRenamed("doc_id", "work_id")


_KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g')), '[.,;:!?''"()\[\]{{}}]', '', 'g'), '\b(the|a|an|and|or|but|in|on|at|to|for|of|with|by)\b', '', 'g'), '\s+', ' ', 'g'))"""


@query(rf"""
    WITH w AS (SELECT doc_id, regexp_split_to_array(text, '\s+') AS w FROM documents), d AS (SELECT doc_id, array_to_string(w[1:3], ' ') AS author, array_to_string(w[4:8], ' ') AS title FROM w),
    k AS (SELECT doc_id, {_KEY.format('author')} AS a, {_KEY.format('title')} AS t FROM d WHERE title <> '')
    SELECT e.doc_id AS ext_id, b.doc_id AS work_id, 1.0 AS confidence FROM k e JOIN k b ON e.a = b.a AND e.t = b.t WHERE e.doc_id % 10 = 0 AND e.a <> '' AND e.t <> ''""")
def exact_match(t):
    return M.exact_matches(*_sides(t)).select("ext_id", "work_id", "confidence")


@query()
def fuzzy_match(t):
    return M.fuzzy_matches(*_sides(t))


@query()
def match_report(t):
    external, books = _sides(t)
    return M.match_report(M.counted_matches(external, books), external)


def _words(t):
    return t("part").select(F.explode(F.split("p_name", " ")).alias("w")).unionByName(t("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("w"))).distinct()


_WORDS = "w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark) WHERE w <> '')"


@query()
def alias_pairs(t):
    return M.alias_candidates(_words(t), "w").select("shelf_a", "shelf_b", "jw", "edit")


@query(f"WITH {_WORDS} SELECT a.w AS a, b.w AS b, CAST(damerau_levenshtein(a.w, b.w) AS INTEGER) AS damerau FROM w a JOIN w b ON a.w < b.w AND length(a.w) = length(b.w) AND substr(a.w, 2, 2) = substr(b.w, 2, 2)")
def string_similarity(t):
    words = _words(t).filter("w != ''")
    a, b = words.withColumnRenamed("w", "a"), words.withColumnRenamed("w", "b")
    pairs = a.join(b, (F.col("a") < F.col("b")) & (F.length("a") == F.length("b")) & (F.substring("a", 2, 2) == F.substring("b", 2, 2)))
    return pairs.select("a", "b", S.damerau(F.col("a"), F.col("b")).alias("damerau"))
