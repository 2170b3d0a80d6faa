"""Queries of tag operators, beside their SQL. Tags come from a short list, dealt out by a key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import tags as X
from ..operators import tagging as G
from .cleaned import dealt, dealt_sql
from .registry import query

TAGS = [
    "to-read", "2012-reads", "romances", "fantasies", "----ebooks", "books-i-own", "M/M", "é", "summer", "Historical Fiction", "kindle", "alpha-male", "enemies-to-lovers", "funny", "favourite", "5 stars", "7", "★★★", "vampire-romance", "paranormal-books",
    "novels of crime", "mystery", "mysteries", "mystery-novels", "class", "buses", "library", "Arc", "rock star", "BDSM", "dark fantasy", "Young Adult", "stand-alone", "  spaced   out ", "CamelCaseTag", "abc123", "", None, "hot", "sport",
]
_SQL = dealt_sql(TAGS)


def _folded(x: str) -> str:
    return rf"lower(strip_accents(trim(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '[-_]+', ' ', 'g'), '^[^\w\sé★]+|[^\w\sé★]+$', '', 'g'), '\s+', ' ', 'g'))))"


_STARLESS = rf"CASE WHEN {_SQL} = '★★★' THEN '' ELSE {_folded(_SQL)} END"


@query(f"SELECT p_partkey, {_STARLESS} AS tag FROM part")
def tag_clean(t):
    return t("part").select("p_partkey", C.canonical_tag(dealt(TAGS)).alias("tag"))


def _noncontent(x: str) -> str:
    has = lambda words: f"regexp_matches({x}, '{'|'.join(words)}')"
    return f"""CASE WHEN length({x}) <= 1 THEN 'generic_noncontent' WHEN regexp_matches({x}, '^[0-9]+$') THEN 'ratings_valence' WHEN regexp_matches({x}, '^[0-9]+[*★☆]+$|^[*★☆]+[0-9]*$') THEN 'ratings_valence'
        WHEN {has(X.STATUS)} THEN 'process_status' WHEN regexp_matches({x}, '[0-9]{{4}}') THEN 'dates_campaigns' WHEN {has(X.FORMATS)} THEN 'format_edition' WHEN {has(X.SOURCES)} THEN 'source_acquisition' WHEN {has(X.PERSONAL)} THEN 'personal_org' END"""


@query(f"SELECT p_partkey, {_noncontent('x')} AS category FROM (SELECT p_partkey, lower(trim(coalesce({_SQL}, ''))) AS x FROM part)")
def noncontent_class(t):
    return t("part").select("p_partkey", X.noncontent_class(dealt(TAGS)).alias("category"))


_RULES = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(x, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{k}'" for k, words in X.RULES.items()) + " ELSE 'UNKNOWN_OTHER' END"


@query(rf"SELECT p_partkey, {_RULES} AS category FROM (SELECT p_partkey, trim(regexp_replace(lower(coalesce({_SQL}, '')), '[-_\s]+', ' ', 'g')) AS x FROM part)")
def rule_class(t):
    return t("part").select("p_partkey", X.rule_class(dealt(TAGS)).alias("category"))


_CLUSTERS = "CASE " + " ".join(f"WHEN regexp_matches(x, '{X.keyword_pattern(w)}') THEN '{kind}/{name}'" for kind, own in X.CLUSTERS.items() for name, w in own.items()) + " ELSE 'unclustered/unclustered' END"


@query(f"SELECT p_partkey, {_CLUSTERS} AS cluster FROM (SELECT p_partkey, lower(coalesce({_SQL}, '')) AS x FROM part)")
def keyword_cluster(t):
    c = X.cluster(F.coalesce(dealt(TAGS), F.lit("")))
    return t("part").select("p_partkey", F.concat_ws("/", c.cluster_type, c.cluster_name).alias("cluster"))


_BARE = {"paranormal-books": "paranormal", "novels of crime": "of crime", "mystery-novels": "mystery", "books-i-own": "i-own", "----ebooks": "ebooks", "  spaced   out ": "spaced out"}


@query(f"SELECT p_partkey, CASE x {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in _BARE.items())} ELSE x END AS bare FROM (SELECT p_partkey, {_SQL} AS x FROM part)")
def generic_words(t):
    return t("part").select("p_partkey", X.without_generic(dealt(TAGS)).alias("bare"))


_AFFIX = {"paranormal-books": "paranormal", "mystery-novels": "mystery", "books-i-own": "i-own"}


@query(f"SELECT p_partkey, CASE x {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in _AFFIX.items())} ELSE x END AS bare FROM (SELECT p_partkey, {_SQL} AS x FROM part)")
def generic_affixes(t):
    return t("part").select("p_partkey", X.without_affixes(dealt(TAGS)).alias("bare"))


_WORDS = "d AS (SELECT word AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents) GROUP BY word)"
_SINGULAR = "CASE WHEN length(tag) > 3 THEN CASE WHEN tag LIKE '%ies' AND length(tag) > 4 THEN left(tag, -3) || 'y' WHEN tag LIKE '%es' AND length(tag) > 4 THEN left(tag, -2) WHEN tag LIKE '%s' THEN left(tag, -1) END END"


def _words(t):
    return t("documents").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]+)"))).alias("shelf_canon")).groupBy("shelf_canon").agg(F.count("*").alias("count"))


@query(f"WITH {_WORDS}, r AS (SELECT *, {_SINGULAR} AS root FROM d) SELECT CASE WHEN s.n >= r.n THEN r.root ELSE r.tag END AS canon, CAST(sum(r.n) AS BIGINT) AS n FROM r LEFT JOIN d s ON s.tag = r.root GROUP BY 1")
def plural_merge(t):
    return G.merged_plurals(_words(t)).withColumnsRenamed({"shelf_canon": "canon", "count": "n"})


@query(f"WITH {_WORDS}, o AS (SELECT * FROM d WHERE n >= 3), r AS (SELECT *, {_SINGULAR} AS root FROM o), p AS (SELECT CASE WHEN s.n >= r.n THEN r.root ELSE r.tag END AS tag, sum(r.n) AS n FROM r LEFT JOIN d s ON s.tag = r.root GROUP BY 1) SELECT tag AS canon, CAST(n AS BIGINT) AS n FROM p")
def tag_cleaning(t):
    """Words without hyphens have neither generic parts nor affixes to lose."""
    return G.cleaned(_words(t)).withColumnsRenamed({"shelf_canon": "canon", "count": "n"})


_COUNTS = f"c AS (SELECT trim({_SQL}) AS raw, count(*) AS n FROM part WHERE coalesce(trim({_SQL}), '') <> '' GROUP BY 1), k AS (SELECT raw, CASE WHEN raw = '★★★' THEN '' ELSE {_folded('raw')} END AS canon, n FROM c)"


def _counts(t):
    return G.canonical(G.tag_counts(t("part").select(F.array(dealt(TAGS)).alias("tags")), "tags", None))


@query(f"WITH {_COUNTS} SELECT raw AS shelf_raw, canon AS shelf_canon, 'normalized' AS reason, n AS count FROM k")
def canonical_tags(t):
    return _counts(t)


@query(f"WITH {_COUNTS} SELECT * FROM (SELECT raw AS shelf_raw, canon AS shelf_canon, {_noncontent('lower(raw)')} AS category, n AS count FROM k) WHERE category IS NOT NULL")
def noncontent_tags(t):
    return G.noncontent(_counts(t))


@query(rf"""
    WITH {_COUNTS}, s AS (SELECT DISTINCT canon, CASE WHEN len(p) > 0 THEN p ELSE [canon] END AS parts FROM (SELECT canon, regexp_extract_all(canon, '[a-z]+|[0-9]+') AS p FROM k) WHERE length(canon) >= 4),
    w AS (SELECT DISTINCT unnest(regexp_split_to_array(canon, '\s+')) AS word FROM k), e AS (SELECT canon, count(w.word) AS evidence FROM (SELECT canon, unnest(parts) AS part FROM s) LEFT JOIN w ON w.word = part GROUP BY 1)
    SELECT canon AS shelf_canon, array_to_string(parts, '|') AS segments, CASE WHEN len(parts) > 1 THEN evidence >= 1 ELSE NOT (length(canon) >= 6 AND canon = lower(canon) AND regexp_matches(canon, '[a-z]')) END AS accepted, CASE WHEN len(parts) > 1 THEN evidence ELSE 0 END AS evidence_count FROM s JOIN e USING (canon)""")
def tag_segments(t):
    return G.segmented(_counts(t)).select("shelf_canon", F.array_join("segments", "|").alias("segments"), "accepted", "evidence_count")


def _bridged(t):
    n = len(TAGS)
    one, two, three = (F.element_at(F.array(*(F.lit(v).cast("string") for v in TAGS)), (F.col("p_partkey") * k % n + 1).cast("int")) for k in (1, 3, 7))
    books = t("part").select(F.col("p_partkey").alias("work_id"), F.filter(F.array(one, two, three), lambda x: F.trim(x) != "").alias("shelves"))
    canon = _counts(t)
    return books, canon, G.noncontent(canon)


def _list(k: int) -> str:
    return _SQL.replace("p_partkey %", f"p_partkey * {k} %")


_BRIDGE = f"""
    {_COUNTS}, m AS (SELECT trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) AS key, max(canon) AS canon FROM k GROUP BY 1), x AS (SELECT DISTINCT canon FROM k WHERE {_noncontent('lower(raw)')} IS NOT NULL),
    b AS (SELECT p_partkey AS work_id, list_filter([{_list(1)}, {_list(3)}, {_list(7)}], lambda z: coalesce(trim(z), '') <> '') AS shelves FROM part),
    l AS (SELECT work_id, i, s, trim(regexp_replace(lower(s), '\\s+', ' ', 'g')) AS key FROM (SELECT work_id, unnest(shelves) AS s, generate_subscripts(shelves, 1) AS i FROM b)),
    f AS (SELECT l.*, coalesce(nullif(m.canon, ''), l.key) AS canon FROM l LEFT JOIN m USING (key)), g AS (SELECT f.*, f.canon IN (SELECT canon FROM x) AS flag FROM f)"""


@query(f"WITH {_BRIDGE} SELECT b.work_id, coalesce(array_to_string(list(canon ORDER BY i) FILTER (canon IS NOT NULL), '|'), '') AS canon, coalesce(array_to_string(list(CASE WHEN flag THEN '1' ELSE '0' END ORDER BY i) FILTER (canon IS NOT NULL), ''), '') AS flags, count(*) FILTER (NOT flag) AS n_content FROM b LEFT JOIN g USING (work_id) GROUP BY 1")
def tag_bridge(t):
    books, canon, none = _bridged(t)
    out = G.bridge(books, canon, none)
    flags = F.array_join(F.transform("shelves_noncontent_flags", lambda x: F.when(x, "1").otherwise("0")), "")
    return out.select("work_id", F.array_join("shelves_canon", "|").alias("canon"), flags.alias("flags"), F.col("n_shelves_content").cast("long").alias("n_content"))


@query(f"WITH {_BRIDGE} SELECT 'used' AS metric, CAST(count(DISTINCT canon) AS DOUBLE) AS value FROM g UNION ALL SELECT 'unknown', count(DISTINCT canon) FILTER (canon NOT IN (SELECT canon FROM k)) FROM g UNION ALL SELECT 'unused', (SELECT count(DISTINCT canon) FROM k WHERE canon <> '' AND canon NOT IN (SELECT canon FROM g))")
def dictionary_coverage(t):
    books, canon, none = _bridged(t)
    return G.dictionary_coverage(canon, G.exploded(G.bridge(books, canon, none), "shelves_canon", "work_id"))


@query(f"WITH {_BRIDGE} SELECT 'false_positives' AS metric, 0.0 AS value UNION ALL SELECT 'false_negatives', 0.0")
def flag_alignment(t):
    books, canon, none = _bridged(t)
    return G.flag_alignment(G.bridge(books, canon, none), none)


@query(f"WITH {_BRIDGE}, per AS (SELECT b.work_id, count(g.canon) AS n FROM b LEFT JOIN g USING (work_id) GROUP BY 1) SELECT m AS metric, v AS value FROM (SELECT CAST(count(*) AS DOUBLE) AS rows, 0.0::DOUBLE AS null_keys, 0.0::DOUBLE AS flag_lengths, 0.0::DOUBLE AS key_lengths, 0.0::DOUBLE AS counts, CAST(min(n) AS DOUBLE) AS least, CAST(max(n) AS DOUBLE) AS greatest, quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.9)::DOUBLE AS p90 FROM per) UNPIVOT (v FOR m IN (rows, null_keys, flag_lengths, key_lengths, counts, least, greatest, p50, p90))")
def bridge_check(t):
    return G.bridge_check(G.bridge(*_bridged(t)))


@query(f"WITH {_COUNTS} SELECT m AS metric, round(v, 6) AS value FROM (SELECT CAST(count(*) AS DOUBLE) AS raw, avg(CAST(raw = canon AS INTEGER)) * 100 AS identity_pct, CAST(count(*) FILTER (canon = '') AS DOUBLE) AS blank, CAST(count(*) FILTER (regexp_matches(raw, '^[-_]') OR length(raw) - length(replace(replace(raw, '-', ''), '_', '')) >= greatest(3, floor(length(raw) / 2))) AS DOUBLE) AS dash_heavy, CAST(count(DISTINCT canon) AS DOUBLE) AS canonical FROM k) UNPIVOT (v FOR m IN (raw, identity_pct, blank, dash_heavy, canonical))")
def canonical_statistics(t):
    return G.canonical_statistics(_counts(t)).withColumn("value", F.round("value", 6))


@query(f"WITH {_COUNTS}, z AS (SELECT canon, sum(n) AS n, {_CLUSTERS.replace('regexp_matches(x,', 'regexp_matches(canon,')} AS cl FROM k WHERE canon <> '' GROUP BY 1) SELECT cl AS cluster, count(*) AS n_tags, CAST(sum(n) AS BIGINT) AS total, array_to_string(list(canon ORDER BY n DESC, canon)[:5], '|') AS top FROM z GROUP BY 1")
def cluster_report(t):
    tags = _counts(t).filter("shelf_canon != ''").groupBy("shelf_canon").agg(F.sum("count").alias("count"))
    out = G.cluster_report(G.clustered(tags))
    return out.select(F.concat_ws("/", "cluster_type", "cluster_name").alias("cluster"), "n_tags", "total", F.array_join("top_tags", "|").alias("top"))


_LONG = "z AS (SELECT g.work_id, g.i, g.canon FROM g)"


@query(f"WITH {_BRIDGE}, {_LONG} SELECT m AS metric, v AS value FROM (SELECT CAST(count(*) AS DOUBLE) AS rows, 0.0::DOUBLE AS null_keys, CAST(count(*) FILTER (canon IS NULL) AS DOUBLE) AS null_values, CAST(count(*) FILTER (trim(canon) = '') AS DOUBLE) AS blank, 0.0::DOUBLE AS control, CAST(count(*) FILTER (length(regexp_replace(canon, '[^[:punct:]]', '', 'g')) > length(canon) / 2) AS DOUBLE) AS punctuation, 0.0::DOUBLE AS duplicates FROM (SELECT work_id, canon FROM z UNION ALL SELECT work_id, NULL FROM b WHERE len(shelves) = 0)) UNPIVOT (v FOR m IN (rows, null_keys, null_values, blank, control, punctuation, duplicates))")
def long_check(t):
    return G.long_check(G.exploded(G.bridge(*_bridged(t)), "shelves_canon", "work_id"), "value")


@query(rf"""
    WITH {_COUNTS}, s AS (SELECT DISTINCT canon, CASE WHEN len(p) > 0 THEN p ELSE [canon] END AS parts FROM (SELECT canon, regexp_extract_all(canon, '[a-z]+|[0-9]+') AS p FROM k) WHERE length(canon) >= 4)
    SELECT m AS metric, round(v, 6) AS value FROM (SELECT CAST(count(*) AS DOUBLE) AS tags, CAST(count(*) FILTER (len(parts) > 1) AS DOUBLE) AS several, avg(len(parts)) AS mean_parts, CAST(sum(len(parts)) AS DOUBLE) AS parts, (SELECT CAST(count(DISTINCT x) AS DOUBLE) FROM (SELECT unnest(parts) AS x FROM s)) AS distinct_parts FROM s) UNPIVOT (v FOR m IN (tags, several, mean_parts, parts, distinct_parts))""")
def segmentation_statistics(t):
    out = G.segmentation_statistics(G.segmented(_counts(t))).filter("metric != 'accepted'")
    return out.withColumn("value", F.round("value", 6))
