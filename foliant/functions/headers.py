"""Title and author from a text's first line or its URL, as struct expressions (title, author, method, confidence)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import squeezed

#: Words of names, of URLs that say nothing, words that open titles, letters written out in slugs.
PARTICLES = "de da del van der von le la".split()
URL_NOISE = "bookrix wattpad chapter ch part novel romance books story fanfic".split()
SMALL_WORDS = "a an the and but or nor for so to of in on at by as per with without".split()
APOSTROPHES = [
    (" i 039 m ", " I'm "), (" i 039 ve ", " I've "), (" i 039 ll ", " I'll "), (" don 039 t ", " don't "), (" can 039 t ", " can't "), (" won 039 t ", " won't "), (" didn 039 t ", " didn't "),
    (" isn 039 t ", " isn't "), (" shouldn 039 t ", " shouldn't "), (" wouldn 039 t ", " wouldn't "), (" 039 s ", "'s "), (" 039 ", "'"), (" amp ", " & "),
]

_NAME = r"^(?:[A-Z][a-z]+\.?|[A-Z]\.|O'[A-Z][a-z]+|Mc[A-Z][a-z]+)$"
_TITLED = r"^(?=.*[a-z])[^\p{L}]*(?:\p{Lu}\p{Ll}*(?:[^\p{L}]+|$))+$"
_EDGES = r"""^[\s"'«»\[\(]+|[\s"'«»\]\)]+$"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(c: Column) -> Column:
    """Words of a text between white space; none of a blank one."""
    return F.filter(F.split(squeezed(c), " "), lambda x: x != "")


def _calmed(s: Column) -> Column:
    upper, letters = F.regexp_count(s, F.lit(r"\p{Lu}")), F.greatest(F.lit(1), F.regexp_count(s, F.lit(r"\p{L}")))
    capital = lambda w: F.concat(F.upper(w.substr(1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
    calm = F.array_join(F.transform(F.split(s, " "), lambda w: F.when(F.length(w) > 2, capital(w)).otherwise(w)), " ")
    return F.when(upper / letters > 0.75, calm).otherwise(s)


def field(c: Column) -> Column:
    """A title or author without brackets, quotes at the ends and signs; a text of capitals as capitalised words. Null: ''."""
    s = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s*[\(\[].*?[\)\]]\s*", " ")
    s = F.regexp_replace(F.regexp_replace(s, _EDGES, ""), _EDGES, "")
    return let(squeezed(F.regexp_replace(s, r"(?U)[^\w\s.\-']+", " ")), _calmed)


def _named(n: Column, tokens: Column) -> Column:
    good = F.size(F.filter(tokens, lambda t: t.rlike(_NAME) | t.rlike(_TITLED) | F.lower(t).isin(PARTICLES) | t.isin("&", "and")))
    return n.between(2, 5) & (good >= F.greatest(F.lit(2), F.ceil(0.6 * F.size(tokens) - 1e-9)))


def is_name(c: Column) -> Column:
    """Two to five words of which at least two, and six tenths, look like parts of a person's name."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "^[-–—]+|[-–—]+$", "")
    return let(bare, lambda s: let(words(F.replace(s, F.lit(","), F.lit(" "))), lambda tokens: _named(F.size(words(s)), tokens)))


def found(title: Column, author: Column | None, method: str, confidence: float) -> Column:
    return F.struct(title.alias("title"), (F.lit(None).cast("string") if author is None else author).alias("author"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))


def header(text: Column, most: int = 200) -> Column:
    """The first line that isn't blank, squeezed, its first 200 characters."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), squeezed), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit("")).substr(1, most)


#: Names of columns that hold a record's text, the likeliest first.
TEXT_COLUMNS = "text content body raw document data excerpt".split()


def main_text(names: list[str]) -> Column:
    """A record's text: of the table's text columns (names) the first likely one that isn't blank, else the longest; null where all are blank."""
    filled = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    likely = [filled(c) for c in TEXT_COLUMNS if c in names]
    longest = F.array_max(F.array(*(F.struct(F.coalesce(F.length(filled(c)), F.lit(0)).alias("n"), F.lit(-k).alias("k"), filled(c).alias("t")) for k, c in enumerate(names))))
    return F.coalesce(*likely, longest.t)


def url_title(url: Column) -> Column:
    """A title of two words or more from the last part of a URL, null else."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^.*?://", ""), "/+$", "")
    stem = F.regexp_replace(F.regexp_extract(rest, r"([^/]*)$", 1), r"\.[^.]*$", "")
    stem = F.regexp_replace(stem, r"(?i)[_\-]+(pdf|epub|mobi|txt)$", "")
    parts = F.filter(F.split(stem, r"[_\-+]+"), lambda p: (p != "") & ~p.rlike(r"^\d+$") & ~F.lower(p).isin(URL_NOISE))
    return let(parts, lambda p: F.when(F.size(p) >= 2, field(F.array_join(p, " "))))


def by_clause(h: Column) -> Column:
    """Title by Author."""
    left, right = (F.regexp_extract(h, r"(?is)^(.*?)\s+by\s+(.*)$", k) for k in (1, 2))
    ok = h.rlike(r"(?i)\s+by\s+")
    made = lambda title, author: F.when(ok & (title != "") & (author != "") & is_name(author), found(title, author, "title_by_author", 0.92))
    return let(field(left), lambda title: let(field(F.split(F.split(right, r"\|")[0], "-")[0]), lambda author: made(title, author)))


def dash_split(h: Column) -> Column:
    """Two parts with a dash between, of which one is a name."""
    first, second = (field(F.regexp_extract(h, r"(?s)^(.*?)\s+[-–—]\s+(.*)$", k)) for k in (1, 2))
    ok = h.rlike(r"\s+[-–—]\s+")
    made = lambda a, b, x, y: F.when(ok & x & ~y, found(b, a, "dash_author_right", 0.85)).when(ok & y & ~x, found(a, b, "dash_author_left", 0.85))
    return let(first, lambda a: let(second, lambda b: let(is_name(a), lambda x: let(is_name(b), lambda y: made(a, b, x, y)))))


def quoted(h: Column) -> Column:
    """A title in quotes, perhaps by an author."""
    pattern = r"""(?i)^"([^"]+)"\s*(?:by\s+([^|\-(\[]+))?"""
    first, second = (field(F.regexp_extract(F.trim(h), pattern, k)) for k in (1, 2))
    ok = F.trim(h).rlike(pattern)
    made = lambda title, author: F.when(ok & (title != "") & (author != "") & is_name(author), found(title, author, "quoted_title_by", 0.88)).when(ok & (title != "") & (author == ""), found(title, None, "quoted_title_only", 0.6))
    return let(first, lambda title: let(second, lambda author: made(title, author)))


def leading_name(h: Column) -> Column:
    """A name of four, three or two words, then a title of at least two."""

    def cut(w: Column, k: int) -> Column:
        name, rest = F.array_join(F.slice(w, 1, k), " "), F.array_join(F.slice(w, k + 1, 200), " ")
        return F.when((F.size(w) >= k + 2) & is_name(name), found(field(rest), field(name), "leading_name_then_title", 0.78))

    return let(words(h), lambda w: F.coalesce(cut(w, 4), cut(w, 3), cut(w, 2)))


def _finished(e: Column, h: Column, by_url: Column) -> Column:
    untitled = (e.title == "") & (by_url != "")
    method = F.when(untitled, F.concat(e.method, F.lit("+url_title"))).otherwise(e.method)
    sure = F.when(untitled, F.greatest(e.confidence, F.lit(0.65))).otherwise(e.confidence)

    def made(title: Column) -> Column:
        start = F.lower(title).substr(F.lit(1), F.greatest(F.lit(5), F.least(F.lit(20), F.length(title))))
        bumped = F.when((title != "") & F.startswith(F.lower(h), start), F.least(F.lit(0.99), sure + 0.03)).otherwise(sure)
        return F.struct(F.nullif(field(title), F.lit("")).alias("title"), F.nullif(field(e.author), F.lit("")).alias("author"), method.alias("method"), F.round(bumped, 4).alias("confidence"))

    return let(F.when(untitled, by_url).otherwise(e.title), made)


def extraction(url: Column, h: Column) -> Column:
    """The first form that fits; without one the URL's title, else the header's first six words; failed where there is nothing."""
    none = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("author"), F.lit("failed").alias("method"), F.lit(0.0).alias("confidence"))

    def without(by_url: Column) -> Column:
        rough = field(F.array_join(F.slice(words(h), 1, 6), " "))
        return F.when(by_url != "", found(field(by_url), None, "url_title_only", 0.55)).otherwise(let(rough, lambda r: F.when(r != "", found(r, None, "header_snippet", 0.4)).otherwise(none)))

    made = lambda e, by_url: F.when(e.isNotNull(), _finished(e, h, by_url)).otherwise(without(by_url))
    return let(F.coalesce(by_clause(h), dash_split(h), quoted(h), leading_name(h)), lambda e: let(F.coalesce(url_title(url), F.lit("")), lambda by_url: made(e, by_url)))


def slug_text(tokens: Column) -> Column:
    """Slug tokens as words: percent codes and written-out apostrophes decoded, small words inside stay lower."""
    raw = F.array_join(tokens, " ")
    s = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    s = F.concat(F.lit(" "), F.replace(F.lower(s), F.lit("-"), F.lit(" ")), F.lit(" "))
    s = squeezed(reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), APOSTROPHES, s))
    capital = lambda x: F.concat(F.upper(x.substr(1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))
    joined = lambda w: F.array_join(F.transform(w, lambda x, i: F.when((i == 0) | (i == F.size(w) - 1) | ~x.isin(SMALL_WORDS), capital(x)).otherwise(x)), " ")
    return let(F.split(s, " "), joined)


def author_tokens(parts: Column) -> Column:
    """How many of a slug's tokens are the author: the best scored of one to four, the fewest of equal ones; 0 of under two tokens."""
    n = F.size(parts)

    def score(k: Column) -> Column:
        own = F.slice(parts, F.lit(1), k)
        points = F.when(n - k >= k, 1).otherwise(0) - F.when(F.exists(own, lambda t: t.rlike(r"\d")), 1).otherwise(0)
        points = points - F.when(F.exists(own, lambda t: t.isin(SMALL_WORDS)), 1).otherwise(0) + F.when(k.between(2, 3), 1).otherwise(0)
        return F.when(~F.get(parts, k).isin(SMALL_WORDS), F.struct(points.alias("p"), (-k).alias("k")))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(4), n - 1))), score))
    return let(best, lambda b: F.when(n < 2, 0).otherwise(F.coalesce(-b.k, F.when(n >= 3, 2).otherwise(1))))


def from_url(url: Column, site: str = "bookrix.com") -> Column:
    """struct(author, title): of the site's _ebook- slugs both, of other URLs the last part as title; null for what isn't there."""
    host, path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    slug = F.filter(F.split(F.regexp_extract(url, r"/_ebook-([^/]+)/?$", 1), "-"), lambda p: p != "")
    last = F.regexp_replace(F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1), r"(?i)^(_ebook-|ebook-)", "")
    other = F.filter(F.split(F.replace(last, F.lit("_"), F.lit("-")), "-"), lambda p: p != "")
    pair = lambda author, title: F.struct(author.alias("author"), title.alias("title"))
    own = lambda s: let(author_tokens(s), lambda k: pair(F.when(k > 0, slug_text(F.slice(s, F.lit(1), k))), slug_text(F.slice(s, k + 1, F.greatest(F.lit(1), F.size(s))))))
    nobody = F.lit(None).cast("string")
    return F.when(host.contains(site) & url.rlike(r"/_ebook-[^/]+/?$"), let(slug, own)).otherwise(let(other, lambda o: pair(nobody, F.when(F.size(o) > 0, slug_text(o)))))
