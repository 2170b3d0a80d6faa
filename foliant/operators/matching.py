"""Matches of names and titles, and aliases of tags: similarity joins whose candidates are complete for their threshold.

Characters of a string, numbered by occurrence, are a set; two strings that are similar enough share a least number of them. With the rarest
characters first, such strings share one among the first few (as many as may differ, plus one), so only those are join keys. Longer strings must share pairs of
neighbouring characters as well, which are rarer. All that passes is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clean as C
from ..functions import similarity as S


def characters(c: Column, n: int = 1) -> Column:
    """A string's characters, or runs of n characters, each with the number of its occurrence."""
    each = F.split(c, "")
    if n > 1:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.transform(each, lambda x, i: F.concat(x, F.size(F.filter(F.slice(each, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def signature(c: Column) -> Column:
    """64 bits of a string's characters: an inserted or deleted character changes one bit at most."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    return F.aggregate(characters(c), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(bit(x)))


def within(a: Column, b: Column, x: Column, y: Column, least: float) -> Column:
    """Of strings of lengths a and b and signatures x and y, those that an indel ratio of `least` may join."""
    return (2 * F.least(a, b) >= least * (a + b) - 1e-9) & (F.bit_count(x.bitwiseXOR(y)) <= (a + b) * (1 - least) + 1e-9)


def rarest(strings: DataFrame, text: str, needed: Column, counts: DataFrame, n: int = 1) -> DataFrame:
    """text, token: of each distinct string the characters (runs of n) that are rarest by counts (token, n), one more than may differ where `needed` (of its length) must be shared."""
    own = strings.select(text).filter(F.length(text) > 0).distinct().withColumn("__need", needed)
    each = own.select(text, "__need", F.explode(characters(F.col(text), n)).alias("token")).join(counts, "token", "left")
    ordered = each.groupBy(text, "__need").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("t"))
    kept = F.slice("t", F.lit(1), F.greatest(F.lit(1), F.size("t") - F.ceil("__need").cast("int") + 1))
    return ordered.select(text, F.explode(kept).alias("x")).select(text, F.col("x.token").alias("token"))


def indel_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """a, b, ratio: all pairs of distinct strings, one of each side, whose indel ratio is at least `least`."""
    # ratio = 2 common / (la + lb) >= t, and common <= the shorter length, so the other's length is at least t / (2 - t) of this one's.
    # common - 1 pairs of neighbours are kept but for one at each gap, of which there are at most la + lb - 2 common: 3 common - (la + lb) - 1 stay.
    share = (1.5 * least - 1) * 2 / (2 - least)
    # From `long` letters on that is one at least. Strings of which one is shorter are both under `short`, and have single characters as keys.
    long = int(1 / share) + 1 if share > 1e-9 else None
    short = long * (2 - least) / least if long else None
    single = lambda c: F.length(c) * (least / 2) * (1 + least / (2 - least)) - 1e-9
    double = lambda c: F.length(c) * share - 1 - 1e-9
    fits = within(F.col("na"), F.col("nb"), F.col("xa"), F.col("xb"), least)
    signed = lambda df, c, side: df.withColumn(f"x{side}", signature(F.col(c))).withColumn(f"n{side}", F.length(c))

    def met(own: DataFrame, other: DataFrame, n: int, need) -> DataFrame:
        counts = other.select(F.explode(characters(F.col(b), n)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        # A pair may meet at several keys: what rules it out is part of the join, before it is made unique.
        keys_a = rarest(own, a, need(a), counts, n).withColumnRenamed("token", "ta").join(signed(own, a, "a"), a)
        keys_b = rarest(other, b, need(b), counts, n).withColumnRenamed("token", "tb").join(signed(other, b, "b"), b)
        return keys_a.join(keys_b, (F.col("ta") == F.col("tb")) & fits).select(a, b)

    own, other = left.select(a).distinct(), right.select(b).distinct()
    if long:
        some = lambda n, need, at: met(own.filter(at(a)), other.filter(at(b)), n, need)
        pairs = some(2, double, lambda c: F.length(c) >= long).unionByName(some(1, single, lambda c: F.length(c) < short + 1))
    else:
        pairs = met(own, other, 1, single)
    return pairs.distinct().withColumn("ratio", S.indel(F.col(a), F.col(b))).filter(F.col("ratio") >= least - 1e-9)


def match_rows(external: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """External rows (ext_id, author, title) and books (work_id, author, title) with match keys a_clean, t_clean and b_clean, u_clean."""
    own = external.select("ext_id", C.match_key(F.col("author")).alias("a_clean"), C.match_key(F.col("title")).alias("t_clean")).filter("a_clean != '' and t_clean != ''")
    return own, books.select("work_id", C.match_key(F.col("author")).alias("b_clean"), C.match_key(F.col("title")).alias("u_clean"))


def exact_matches(external: DataFrame, books: DataFrame) -> DataFrame:
    """ext_id, work_id, match_type, confidence, author_similarity, title_similarity of equal keys; blank keys match nothing."""
    e, b = match_rows(external, books)
    one = F.lit(1.0)
    return e.join(b, (e.a_clean == b.b_clean) & (e.t_clean == b.u_clean)).select("ext_id", "work_id", F.lit("exact").alias("match_type"), one.alias("confidence"), one.alias("author_similarity"), one.alias("title_similarity"))


def fuzzy_matches(external: DataFrame, books: DataFrame, least: float = 0.8, author_weight: float = 0.6, title_weight: float = 0.4, authors: int = 10) -> DataFrame:
    """The best fuzzy match of each external row that has one, exact matches left out: of its `authors` most similar author strings (ties by the string) the
    book with the greatest weighted similarity (ties by work_id); author, title and sum all at least `least`."""
    rows, b = match_rows(external, books)
    # Equal keys have equal matches, and of equal books the least work_id wins: copies make no pairs. Keys are made once of the texts; what
    # memory doesn't hold of them is kept on disk.
    rows, b = rows.persist(), b.filter("b_clean != ''").groupBy("b_clean", "u_clean").agg(F.min("work_id").alias("work_id")).persist()
    e = rows.select("a_clean", "t_clean").distinct()
    pairs = indel_pairs(e, b, "a_clean", "b_clean", least)
    best = Window.partitionBy("a_clean").orderBy(F.desc("ratio"), "b_clean")
    near = pairs.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= authors).drop("rn")
    # A name of many titles makes only the pairs that may be alike.
    e, b = (x.withColumn(f"x{k}", signature(F.col(c))).withColumn(f"n{k}", F.length(c)) for x, k, c in ((e, "t", "t_clean"), (b.filter("u_clean != ''"), "u", "u_clean")))
    near = near.withColumnRenamed("b_clean", "name")
    other = ~((F.col("a_clean") == F.col("b_clean")) & (F.col("t_clean") == F.col("u_clean")))
    met = e.join(near, "a_clean").join(b, (F.col("name") == F.col("b_clean")) & within(F.col("nt"), F.col("nu"), F.col("xt"), F.col("xu"), least) & other)
    scored = met.withColumn("title_similarity", S.indel(F.col("t_clean"), F.col("u_clean"))).filter(F.col("title_similarity") >= least - 1e-9)
    scored = scored.withColumn("confidence", F.col("ratio") * author_weight + F.col("title_similarity") * title_weight).filter(F.col("confidence") >= least - 1e-9)
    kind = F.when((F.col("ratio") >= 0.9) & (F.col("title_similarity") >= 0.9), "fuzzy_both").when(F.col("ratio") >= 0.9, "fuzzy_author").otherwise("fuzzy_title")
    out = scored.select("a_clean", "t_clean", "work_id", kind.alias("match_type"), "confidence", F.col("ratio").alias("author_similarity"), "title_similarity")
    found = best_matches(out, "a_clean", "t_clean")
    return best_matches(rows.join(found, ["a_clean", "t_clean"]).drop("a_clean", "t_clean"))


def best_matches(matches: DataFrame, *by: str) -> DataFrame:
    """Of each external row (by default) the match of greatest confidence, the least work_id of equal ones."""
    by = by or ("ext_id",)
    names = [c for c in matches.columns if c not in by]
    return matches.groupBy(*by).agg(F.min_by(F.struct(*names), F.struct((-F.col("confidence")).alias("c"), "work_id")).alias("m")).select(*by, "m.*")


def all_matches(external: DataFrame, books: DataFrame, **options) -> DataFrame:
    """Exact and fuzzy matches, the surest first."""
    both = exact_matches(external, books).unionByName(fuzzy_matches(external, books, **options))
    return both.orderBy(F.desc("confidence"), "ext_id", "work_id")


def counted_matches(external: DataFrame, books: DataFrame, **options) -> DataFrame:
    """ext_id, match_type, confidence, n: all_matches() for match_report(), with an external row's exact matches counted and not listed."""
    e, b = match_rows(external, books)
    copies = b.groupBy(F.col("b_clean").alias("a_clean"), F.col("u_clean").alias("t_clean")).agg(F.count("*").alias("n"))
    exact = e.join(copies, ["a_clean", "t_clean"]).select("ext_id", F.lit("exact").alias("match_type"), F.lit(1.0).alias("confidence"), "n")
    return exact.unionByName(fuzzy_matches(external, books, **options).select("ext_id", "match_type", "confidence", F.lit(1).cast("long").alias("n")))


def match_report(matches: DataFrame, external: DataFrame) -> DataFrame:
    """One row: total, exact and fuzzy matches, average, least and greatest confidence, matched rows, rows, coverage in percent. A row of `matches` counts n times where it has that column."""
    n = F.col("n") if "n" in matches.columns else F.lit(1)
    # By row first, so that the matches are made once.
    each = matches.groupBy("ext_id").agg(F.sum(n).alias("total"), F.sum(F.when(F.col("match_type") == "exact", n).otherwise(0)).alias("exact"), F.sum(F.col("confidence") * n).alias("sum"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = each.agg(whole("total").alias("total"), whole("exact").alias("exact"), F.coalesce(F.sum("sum") / F.sum("total"), F.lit(0.0)).alias("average"), F.coalesce(F.min("low"), F.lit(0.0)).alias("least"), F.coalesce(F.max("high"), F.lit(0.0)).alias("greatest"), F.count("*").alias("matched"))
    rows = external.agg(F.count("*").alias("n_rows"))
    out = one.join(F.broadcast(rows))  # one row each
    return out.withColumn("fuzzy", F.col("total") - F.col("exact")).withColumn("coverage_pct", F.when(F.col("n_rows") > 0, F.col("matched") * 100.0 / F.col("n_rows")).otherwise(0.0))


def unmatched(external: DataFrame, matches: DataFrame) -> DataFrame:
    return external.join(matches.select("ext_id"), "ext_id", "left_anti")


def alias_candidates(tags: DataFrame, tag: str = "shelf_canon", least: float = 0.94, edits: int = 1, grams: float = 0.8, apart: int = 3, block: Column | None = None) -> DataFrame:
    """shelf_a, shelf_b (a < b), jw, edit, jaccard3, decision_hint: pairs of distinct tags of one block (by default the first character), lengths at
    most `apart` apart, of a Jaro-Winkler similarity of at least least - 0.05. suggest: at least `least`, and few edits or alike in runs of three; else inspect."""
    c = F.col(tag)
    names = tags.select(tag).filter(c != "").distinct()
    counts = names.select(F.explode(characters(c)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # jw <= jaro + 0.4 (1 - jaro), and jaro >= j needs m / la + m / lb >= 3 j - 1 for m common characters.
    jaro = max(0.0, (least - 0.05 - 0.4) / 0.6)
    other = F.greatest(F.lit(1), F.length(c) - apart)
    need = (3 * jaro - 1) * F.length(c) * other / (F.length(c) + other) - 1e-9
    keys = rarest(names, tag, F.greatest(need, F.lit(1.0)), counts).withColumn("block", c.substr(1, 1) if block is None else block)
    a, b = (keys.select("block", "token", c.alias(f"shelf_{s}")) for s in "ab")
    pairs = a.join(b, ["block", "token"]).filter((F.col("shelf_a") < F.col("shelf_b")) & (F.abs(F.length("shelf_a") - F.length("shelf_b")) <= apart)).select("shelf_a", "shelf_b").distinct()
    x, y = F.col("shelf_a"), F.col("shelf_b")
    out = pairs.withColumn("jw", S.jaro_winkler(x, y)).filter(F.col("jw") >= least - 0.05)
    out = out.withColumn("edit", S.damerau(x, y)).withColumn("jaccard3", S.gram_jaccard(x, y))
    hint = F.when((F.col("jw") >= least) & ((F.col("edit") <= edits) | (F.col("jaccard3") >= grams)), "suggest").otherwise("inspect")
    return out.select("shelf_a", "shelf_b", F.round("jw", 4).alias("jw"), "edit", F.round("jaccard3", 4).alias("jaccard3"), hint.alias("decision_hint"))


def alias_dry_run(tags: DataFrame, tag: str = "shelf_canon", sample: int = 10_000, **options) -> DataFrame:
    """alias_candidates() over a sample of tags (those with least hash), in blocks of the first word."""
    some = tags.select(tag).filter(F.col(tag) != "").distinct().orderBy(F.md5(tag), tag).limit(sample)
    return alias_candidates(some, tag, block=F.split_part(F.col(tag), F.lit(" "), F.lit(1)), **options)


def sorted_aliases(aliases: DataFrame) -> DataFrame:
    """By decision, then the most similar first."""
    return aliases.orderBy("decision_hint", F.desc("jw"), "shelf_a", "shelf_b")
