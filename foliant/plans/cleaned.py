"""Queries of text, genre, list, header and sentence operators, beside their SQL. Odd inputs come from short lists, dealt out by a key."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clean as C
from ..functions import headers as H
from ..operators import sentences as Z
from ..operators import works as K
from .registry import query


def dealt(values: list[str | None], key: str = "p_partkey"):
    """A column of the values in turn."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def dealt_sql(values: list[str | None], key: str = "p_partkey") -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], CAST({key} % {len(values)} + 1 AS INTEGER))"


# Markup and words


_UNESCAPED = "replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&')"
_BARE = f"regexp_replace({_UNESCAPED.format('html')}, '<[^>]+>', '', 'g')"
_SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_SQUEEZED.format(f'''regexp_replace({_BARE}, '&[a-zA-Z0-9#]+;', '', 'g')''')} AS body, {_SQUEEZED.format(_BARE)} AS light, regexp_matches(html, '<[^>]+>|&[a-zA-Z0-9#]+;') AS had_html FROM pages")
def html_clean(t):
    return t("pages").select("page_id", C.full_clean(F.col("html")).alias("body"), C.light_clean(F.col("html")).alias("light"), C.has_markup(F.col("html")).alias("had_html"))


_STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)
_PUNCTUATION = r"[!-/:-@\[-`{-~]"


@query(rf"""
    WITH w AS (SELECT lang, unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '{_PUNCTUATION}', '', 'g'), '\s+', ' ', 'g')), ' ')) AS word FROM documents)
    SELECT lang, word, n FROM (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rn FROM (SELECT lang, word, count(*) AS n FROM w WHERE length(word) > 2 AND word NOT IN ({_STOP}) GROUP BY lang, word)) WHERE rn <= 20""")
def top_words(t):
    counts = t("documents").select("lang", F.explode(C.counted_words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts.withColumn("rn", rank).filter("rn <= 20").drop("rn")


@query(r"""
    SELECT lang, count(*) AS n, round(avg(length(text)), 2) AS mean_chars, round(avg(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END), 2) AS mean_tokens FROM documents GROUP BY lang""")
def length_by_group(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"), F.round(F.avg(C.word_count(F.col("text"))), 2).alias("mean_tokens"))


@query(r"""
    WITH d AS (SELECT d.doc_id, lang, text, CASE WHEN regexp_matches(lang, '^(eng|en(-[A-Za-z]+)?)$') THEN true ELSE false END AS english FROM documents d)
    SELECT doc_id, lang FROM d WHERE english AND length(trim(text)) >= 10""")
def code_regex_filter(t):
    return t("documents").filter(C.is_english(F.col("lang")) & (F.length(F.trim("text")) >= 10)).select("doc_id", "lang")


_CODES = ["eng", "EN", "en-US", " en ", "enx", "english", "en-", "fre", "", None, "en-GB1"]


@query(f"SELECT p_partkey, coalesce(regexp_matches(trim({dealt_sql(_CODES)}), '(?i)^(eng|en(-[A-Za-z]+)?)$'), false) AS english FROM part")
def language_codes(t):
    return t("part").select("p_partkey", C.is_english(dealt(_CODES)).alias("english"))


# Genres and tag lists


_GENRES = ["Contemporary  Romance, crime", "love story,LOVE-story,Romantic", "steamy romance novels, historical romance", "modern fiction,period fiction, fiction for teens", "chick lit, womens fiction, women in fiction", "Teen,, ya , young adults", "supernatural,magic realism", "memoir,auto-biography", "non-fiction, history of art", "poetry, Westerns", " , ", "", None, "paranormal mystery romance", "science fiction,sci-fi"]


def _genre_sql(x: str) -> str:
    exact = " ".join(f"WHEN {x} IN ({', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in vs)}) THEN '{k.replace(chr(39), chr(39) * 2)}'" for k, vs in C.GENRES.items())
    has = lambda *w: "(" + " OR ".join(f"contains({x}, '{y}')" for y in w) + ")"
    return f"""CASE {exact}
        WHEN {has('romance')} THEN CASE WHEN {has('contemporary', 'modern')} THEN 'contemporary romance' WHEN {has('historical', 'period')} THEN 'historical romance' WHEN {has('paranormal', 'supernatural')} THEN 'paranormal romance' WHEN {has('erotic', 'steamy')} THEN 'erotic romance' ELSE 'romance' END
        WHEN {has('fiction')} THEN CASE WHEN {has('contemporary', 'modern')} THEN 'contemporary fiction' WHEN {has('historical', 'period')} THEN 'historical fiction' WHEN {has('women', 'chick')} THEN 'women''s fiction' ELSE 'fiction' END
        WHEN {has('mystery', 'thriller', 'suspense', 'crime')} THEN 'mystery' WHEN {has('fantasy', 'magic', 'supernatural')} THEN 'fantasy' WHEN {has('young', 'ya', 'teen')} THEN 'young adult'
        WHEN {has('biography', 'memoir', 'autobiography')} THEN 'biography' WHEN {has('history', 'historical')} THEN 'history' ELSE {x} END"""


@query(rf"""
    WITH g AS (SELECT p_partkey, {dealt_sql(_GENRES)} AS g FROM part),
    e AS (SELECT p_partkey, g, trim(regexp_replace(lower(unnest(string_split(g, ','))), '\s+', ' ', 'g')) AS x FROM g WHERE g IS NOT NULL)
    SELECT g.p_partkey, CASE WHEN g.g IS NOT NULL THEN coalesce(array_to_string(list_sort(list_distinct(list({_genre_sql('x')}) FILTER (x <> ''))), ','), '') END AS genres FROM g LEFT JOIN e ON g.p_partkey = e.p_partkey GROUP BY g.p_partkey, g.g""")
def standard_genres(t):
    return t("part").select("p_partkey", C.standard_genres(dealt(_GENRES)).alias("genres"))


_SAMPLED = ["Sci Fi, YA", "history, Historical Fiction,romance", "Paranormal Romance,mystery romance, Comics", "young adult,ya,YA", "", None, " fantasy romance ,, contemporary", "Graphic Novels", "historical"]
_SYNONYM = "CASE " + " ".join(f"WHEN x = '{k}' THEN '{v}'" for k, v in C.SYNONYMS.items()) + " ELSE x END"


@query(f"""
    WITH g AS (SELECT p_partkey, {dealt_sql(_SAMPLED)} AS g FROM part), e AS (SELECT p_partkey, trim(lower(unnest(string_split(g, ',')))) AS x FROM g),
    c AS (SELECT g.p_partkey, g.g, coalesce(array_to_string(list_sort(list_distinct(list({_SYNONYM}) FILTER (x <> ''))), ', '), '') AS canon FROM g LEFT JOIN e ON g.p_partkey = e.p_partkey GROUP BY 1, 2)
    SELECT p_partkey, canon, CASE WHEN contains(canon, 'paranormal') THEN 'paranormal' WHEN contains(canon, 'historical romance') THEN 'historical' WHEN contains(canon, 'fantasy') THEN 'fantasy' WHEN contains(canon, 'mystery') THEN 'mystery' WHEN contains(canon, 'young adult') THEN 'young_adult' ELSE 'other' END AS grp
    FROM c WHERE NOT coalesce(regexp_matches(g, '(?i)comics|graphic'), false)""")
def genre_canon(t):
    own = t("part").select("p_partkey", dealt(_SAMPLED).alias("g")).filter(~F.coalesce(F.col("g").rlike("(?i)comics|graphic"), F.lit(False)))
    own = own.withColumn("canon", C.sampled_genres(F.col("g")))
    return own.select("p_partkey", "canon", C.genre_group(F.col("canon")).alias("grp"))


_SHELVES = [",to-read, favorites ,,Sci Fi", "a,,b,", "ROMANCE , love/hate", "", None, "2012 reads,books_i_own", " x , y-z "]


@query(rf"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower({dealt_sql(_SHELVES)}), '[^a-z0-9\-,]', '', 'g'), ',+', ',', 'g'), ',') AS shelves FROM part")
def standard_tags(t):
    return t("part").select("p_partkey", C.standard_tags(dealt(_SHELVES)).alias("shelves"))


_LISTS = ["['1', '2']", "a,b;c|d", "nan", "", None, '"x"', "[]", '["it", "two words", ""]', "['a','nan']", "None", "one", " 'p' ; \"q\" ,, null", "[1, 2]"]
_PARSED = [["1", "2"], ["a", "b", "c", "d"], [], [], [], ["x"], [], ["it", "two words"], ["a", "nan"], [], ["one"], ["p", "q"], ["1", "2"]]


@query(f"SELECT p_partkey, len(x) AS n, array_to_string(x, '|') AS items FROM (SELECT p_partkey, list_extract({_PARSED!r}, CAST(p_partkey % {len(_LISTS)} + 1 AS INTEGER)) AS x FROM part)")
def list_parse(t):
    items = C.parsed_list(dealt(_LISTS))
    return t("part").select("p_partkey", F.size(items).cast("long").alias("n"), F.array_join(items, "|").alias("items"))


_SEGMENTS = ['["a", "b c"]', "x, y z", "['p', 'q']", "", None, "single"]
_CUT = [["a", "b c"], ["x", "y", "z"], ["p", "q"], [], [], ["single"]]


@query(f"SELECT p_partkey, array_to_string(list_extract({_CUT!r}, CAST(p_partkey % {len(_CUT)} + 1 AS INTEGER)), '|') AS parts FROM part")
def segment_parse(t):
    return t("part").select("p_partkey", F.array_join(C.segments(dealt(_SEGMENTS), spaces=True), "|").alias("parts"))


_KEYS = ["The Lord, of the  Rings!", "A Tale (of Two) Cities", "It's \"by\" the Book", None, " ", "andy and the band", "To Have; or To Hold?"]


@query(rf"""
    WITH k AS (SELECT p_partkey, trim(regexp_replace(lower(coalesce({dealt_sql(_KEYS)}, '')), '\s+', ' ', 'g')) AS x FROM part)
    SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(x, '[.,;:!?''"()\[\]{{}}]', '', 'g'), '\b(the|a|an|and|or|but|in|on|at|to|for|of|with|by)\b', '', 'g'), '\s+', ' ', 'g')) AS match_key FROM k""")
def match_keys(t):
    return t("part").select("p_partkey", C.match_key(dealt(_KEYS)).alias("match_key"))


_TITLES = ["A (B) [C]", "(only)", None, "x  y", "Book (Series, #1)  two"]
_BARE_TITLES, _TAKEN = ["A", "(only)", None, "x y", "Book two"], ["(B)|[C]", "(only)", None, "", "(Series, #1)"]


@query(f"SELECT p_partkey, {dealt_sql(_BARE_TITLES)} AS title, {dealt_sql(_TAKEN)} AS removed FROM part")
def bracket_titles(t):
    title, removed = C.without_brackets(dealt(_TITLES))
    return t("part").select("p_partkey", title.alias("title"), F.array_join(removed, "|").alias("removed"))


_NUMBERS = ["", "0", "Unknown", "12.0", "abc", None, "-3", " 7 ", "N/A"]
_VALUES = [None, "0", None, "12", None, None, "-3", "7", None]


@query(f"SELECT p_partkey, CAST({dealt_sql(_VALUES)} AS DOUBLE) AS value, coalesce(CAST({dealt_sql(_VALUES)} AS DOUBLE), -1) AS with_default FROM part")
def number_or_null(t):
    c = dealt(_NUMBERS)
    return t("part").select("p_partkey", C.number_or(c, ["", "Unknown", "N/A"]).alias("value"), C.number_or(c, ["", "Unknown", "N/A"], -1).alias("with_default"))


# Titles and authors


_HEADERS = ["Moonlight Sonata by Jane Doe", "Jane Doe — the moonlight sonata", "the moonlight sonata - Jane Doe", '"Winter Rose" by Anna Bell', '"Winter Rose"', "Cherie Benjamin A Sinless Betrayal (completed)", "chapter one of something that nobody wrote down", "", None, "THE LONG ROAD HOME by MARY O'NEIL", "Stand by me"]
_WANT = ["Moonlight Sonata|Jane Doe|title_by_author|0.95", "the moonlight sonata|Jane Doe|dash_author_right|0.85", "the moonlight sonata|Jane Doe|dash_author_left|0.88", "Winter Rose|Anna Bell|title_by_author|0.92", "Winter Rose||quoted_title_only|0.6", "Betrayal|Cherie Benjamin A Sinless|leading_name_then_title|0.78", "chapter one of something that nobody||header_snippet|0.4", "||failed|0.0", "||failed|0.0", "The Long Road Home by Mary||header_snippet|0.4", "Stand by me||header_snippet|0.4"]


@query(f"SELECT p_partkey, {dealt_sql(_WANT)} AS found FROM part")
def header_extraction(t):
    e = H.extraction(F.lit(None).cast("string"), H.header(F.coalesce(dealt(_HEADERS), F.lit(""))))
    text = F.concat_ws("|", F.coalesce(e.title, F.lit("")), F.coalesce(e.author, F.lit("")), e.method, e.confidence.cast("string"))
    return t("part").select("p_partkey", text.alias("found"))


_URLS = ["https://www.bookrix.com/_ebook-jane-doe-the-long-road/", "https://www.bookrix.com/_ebook-anna-bell-i-039-m-here/", "https://www.bookrix.com/_ebook-solo/", "http://example.org/a/some_old-tale.html", "http://example.org/", "https://www.bookrix.com/_ebook-mary-o-neil-love-amp-war"]
_OF_URL = ["Jane|Doe the Long Road", "Anna Bell|I'm Here", "-|Solo", "-|Some Old Tale.html", "-|-", "Mary O|Neil Love & War"]


@query(f"SELECT p_partkey, {dealt_sql(_OF_URL)} AS found FROM part")
def url_extraction(t):
    e = H.from_url(dealt(_URLS))
    return t("part").select("p_partkey", F.concat_ws("|", F.coalesce(e.author, F.lit("-")), F.coalesce(e.title, F.lit("-"))).alias("found"))


@query(r"""
    WITH s AS (SELECT page_id, regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '^.*?://', ''), '/+$', ''), '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM pages),
    p AS (SELECT page_id, list_filter(regexp_split_to_array(stem, '[_\-+]+'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$') AND lower(x) NOT IN ('bookrix', 'wattpad', 'chapter', 'ch', 'part', 'novel', 'romance', 'books', 'story', 'fanfic')) AS parts FROM s)
    SELECT page_id, CASE WHEN len(parts) >= 2 THEN trim(regexp_replace(regexp_replace(array_to_string(parts, ' '), '[^\w\s.\-'']+', ' ', 'g'), '\s+', ' ', 'g')) END AS title FROM p""")
def url_titles(t):
    return t("pages").select("page_id", H.url_title(F.col("url")).alias("title"))


# Sentences


_SPLIT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]+)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 10)"


@query(rf"""
    WITH d AS (SELECT doc_id, {_SPLIT} AS s FROM documents WHERE lang = 'en'), e AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS i FROM d)
    SELECT doc_id, CAST(i AS INTEGER) AS sentence_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_sentences, md5(lower(trim(regexp_replace(sentence, '\s+', ' ', 'g')))) AS sentence_md5 FROM e""")
def sentence_rows(t):
    reviews = t("documents").filter("lang = 'en'").select("doc_id", "text")
    out = Z.clean_sentences(Z.split_sentences(reviews, text="text", key="doc_id"), "doc_id")
    return out.select("doc_id", "sentence_index", F.col("n_sentences_in_review").alias("n_sentences"), F.md5("sentence_text").alias("sentence_md5"))


@query(rf"""
    WITH d AS (SELECT doc_id, {_SPLIT} AS s FROM documents), e AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS i FROM d)
    SELECT count(*) AS n, 0 AS first_id, count(*) - 1 AS last_id, count(*) AS distinct_ids, count(DISTINCT doc_id) AS reviews FROM e""")
def sentence_numbers(t):
    out = Z.numbered(Z.split_sentences(t("documents").select("doc_id", "text"), text="text", key="doc_id"), "doc_id")
    return out.agg(F.count("*").alias("n"), F.min("sentence_id").alias("first_id"), F.max("sentence_id").alias("last_id"), F.count_distinct("sentence_id").alias("distinct_ids"), F.count_distinct("doc_id").alias("reviews"))


@query("SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1")
def unique_reviews(t):
    return Z.unique_reviews(t("conversations"), "conv_id", "turn").select("conv_id", "text")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'stand_alone' ELSE CAST(o_custkey AS VARCHAR) END AS series_id, CAST(o_orderkey % 3 <> 0 AS INTEGER) AS flag FROM orders")
def series_flags(t):
    own = t("orders").select("o_orderkey", F.lit("g").alias("genres"), F.lit("p").alias("popular_shelves"), F.lit("3").alias("series_works_count"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")).alias("series_id"))
    return K.analysis_columns(own).select("o_orderkey", "series_id", K.series_flag(F.col("series_id")).alias("flag"))
