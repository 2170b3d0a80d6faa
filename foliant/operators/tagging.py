"""User tags: canonical keys, classes, aliases, segments, cleaning, clusters, and the bridge from works to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clean as C
from ..functions import tags as X
from .matching import alias_candidates
from .quality import count_if, metrics
from .quantiles import quantiles


def tag_counts(rows: DataFrame, column: str, separator: str | None = ",") -> DataFrame:
    """shelf_raw, count: trimmed tags that aren't blank, of a text with separators or (separator None) an array."""
    each = F.explode(F.split(column, separator) if separator else F.col(column)).alias("t")
    return rows.select(each).select(F.trim("t").alias("shelf_raw")).filter("shelf_raw != ''").groupBy("shelf_raw").agg(F.count("*").alias("count"))


def canonical(counts: DataFrame) -> DataFrame:
    """shelf_raw, shelf_canon, reason, count."""
    return counts.select("shelf_raw", C.canonical_tag(F.col("shelf_raw")).alias("shelf_canon"), F.lit("normalized").alias("reason"), "count")


def noncontent(canon: DataFrame, anchored: bool = False) -> DataFrame:
    """shelf_raw, shelf_canon, category, count of tags that say nothing of content; empty without any."""
    return canon.withColumn("category", X.noncontent_class(F.col("shelf_raw"), anchored)).filter("category is not null").select("shelf_raw", "shelf_canon", "category", "count")


def known_words(canon: DataFrame) -> DataFrame:
    """word: all words of canonical tags, each once."""
    return canon.select(F.explode(F.split("shelf_canon", r"\s+")).alias("word")).filter("word != ''").distinct()


def segmented(canon: DataFrame, frequencies: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """shelf_canon, segments, accepted, guard1_standalone (segments that are words of other tags), guard2_lexicon, evidence_count of canonical tags of at
    least four characters. Of several parts, one must be a known word, and one known or, with frequencies (word, zipf), frequent enough. One part: accepted unless it is a
    lower-case word of six letters or more."""
    names = canon.select("shelf_canon").filter(F.length("shelf_canon") >= 4).distinct().withColumn("segments", X.camel_parts(F.col("shelf_canon")))
    words = known_words(canon).withColumn("known", F.lit(1))
    each = names.select("shelf_canon", F.explode("segments").alias("word")).join(words, "word", "left")
    frequent = F.lit(True)
    if frequencies is not None:
        each = each.join(frequencies.select("word", "zipf"), "word", "left")
        frequent = F.coalesce(F.col("zipf") >= least, F.lit(False))
    facts = each.groupBy("shelf_canon").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("evidence"), F.max(F.col("known").isNotNull() | frequent).alias("lexicon"))
    several = F.size("segments") > 1
    single = ~((F.length("shelf_canon") >= 6) & (F.col("shelf_canon") == F.lower("shelf_canon")) & F.col("shelf_canon").rlike("[a-z]"))
    none = F.lit(0).cast("long")
    return names.join(facts, "shelf_canon").select(
        "shelf_canon", "segments", F.when(several, (F.col("evidence") >= 1) & F.col("lexicon")).otherwise(single).alias("accepted"),
        F.when(several, F.col("evidence")).otherwise(none).alias("guard1_standalone"), F.when(several, F.col("lexicon")).otherwise(F.lit(True)).alias("guard2_lexicon"), F.when(several, F.col("evidence")).otherwise(none).alias("evidence_count"),
    )


def vocabulary(segments: DataFrame) -> DataFrame:
    """segment: sorted, each once, of accepted tags."""
    return segments.filter("accepted").select(F.explode("segments").alias("segment")).distinct().orderBy("segment")


def normalisation(counts: DataFrame, **alias_options) -> dict[str, DataFrame]:
    """All tables of the normalisation: canonical, noncontent, aliases, segments, vocabulary."""
    canon = canonical(counts)
    segments = segmented(canon)
    return {"canonical": canon, "noncontent": noncontent(canon), "aliases": alias_candidates(canon, **alias_options), "segments": segments, "vocabulary": vocabulary(segments)}


# Cleaning


def _merged(tags: DataFrame, cleaned: Column) -> DataFrame:
    return tags.select(cleaned.alias("shelf_canon"), "count").groupBy("shelf_canon").agg(F.sum("count").alias("count"))


def frequent(tags: DataFrame, least: int = 3) -> DataFrame:
    return tags.filter(F.col("count") >= least)


def merged_plurals(tags: DataFrame, all_tags: DataFrame | None = None) -> DataFrame:
    """Plurals become their singular where that is a tag (of all_tags) at least as frequent; counts are added."""
    every = (all_tags if all_tags is not None else tags).select(F.col("shelf_canon").alias("singular"), F.col("count").alias("m"))
    met = tags.withColumn("singular", X.singular_candidate(F.col("shelf_canon"))).join(every, "singular", "left")
    return _merged(met, F.when(F.col("m") >= F.col("count"), F.col("singular")).otherwise(F.col("shelf_canon")))


def cleaned(tags: DataFrame, least: int = 3) -> DataFrame:
    """Canonical tags (shelf_canon, count) after frequency, plurals, generic words and affixes, merged after each."""
    plural = merged_plurals(frequent(tags, least), tags)
    return _merged(_merged(plural, X.without_generic(F.col("shelf_canon"))), X.without_affixes(F.col("shelf_canon")))


def cleaning_statistics(tags: DataFrame, least: int = 3) -> DataFrame:
    """step, n_tags: the number of tags after each step of cleaned()."""
    often = frequent(tags, least)
    plural = merged_plurals(often, tags)
    bare = _merged(plural, X.without_generic(F.col("shelf_canon")))
    steps = {"original": tags, "frequency": often, "plural": plural, "generic": bare, "affixes": _merged(bare, X.without_affixes(F.col("shelf_canon")))}
    out = [df.agg(F.count("*").alias("n_tags")).select(F.lit(k).alias("step"), "n_tags") for k, df in steps.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


def clustered(tags: DataFrame, least: int = 1) -> DataFrame:
    """shelf_canon, count, cluster_type, cluster_name of tags of at least that count."""
    return tags.filter(F.col("count") >= least).withColumn("c", X.cluster(F.col("shelf_canon"))).select("shelf_canon", "count", "c.cluster_type", "c.cluster_name")


def cluster_report(clusters: DataFrame, top: int = 5) -> DataFrame:
    """cluster_type, cluster_name, n_tags, total, top_tags (the most frequent, ties by name)."""
    keys = ["cluster_type", "cluster_name"]
    sums = clusters.groupBy(*keys).agg(F.count("*").alias("n_tags"), F.sum("count").alias("total"))
    best = clusters.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "shelf_canon"))).filter(F.col("rn") <= top)
    return sums.join(best.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "shelf_canon"))), lambda x: x.shelf_canon).alias("top_tags")), keys)


def rule_classes(tags: DataFrame) -> DataFrame:
    """tags with rule_category."""
    return tags.withColumn("rule_category", X.rule_class(F.col("shelf_canon")))


def focus_export(predicted: DataFrame, classes: list[str]) -> DataFrame:
    """Tags of the classes, the surest and most frequent first."""
    return predicted.filter(F.col("final_category").isin(classes)).orderBy(F.desc("confidence"), F.desc("count"), "shelf_canon")


# The bridge from works to tags


def segment_dictionary(segments: DataFrame) -> DataFrame:
    """canon_key, segments_list, seg_accepted, a key once: of a table whose segments and accepted may be text."""
    kinds = dict(segments.dtypes)
    parts = C.segments(F.col("segments"), spaces=True) if kinds["segments"] == "string" else F.col("segments")
    ok = F.lower(F.trim("accepted")).isin("1", "true", "yes") if kinds["accepted"] == "string" else F.col("accepted")
    return segments.select(C.lookup_key(F.col("shelf_canon")).alias("canon_key"), parts.alias("segments_list"), ok.alias("seg_accepted")).groupBy("canon_key").agg(F.min(F.struct("segments_list", "seg_accepted")).alias("s")).select("canon_key", "s.*")


def exploded(rows: DataFrame, column: str, key: str) -> DataFrame:
    """key, row_index (the item's place from 0), value; an empty or missing list has one row without value."""
    return rows.select(key, F.posexplode_outer(column).alias("row_index", "value"))


def bridge(works: DataFrame, canon: DataFrame, nocontent: DataFrame, raw: str = "shelves", key: str = "work_id") -> DataFrame:
    """Works with shelves_canon (of canon: shelf_raw, shelf_canon, by lookup key; the key itself where it isn't there), shelves_lookup_keys, shelves_noncontent_flags (of
    nocontent: shelf_canon), shelves_canon_content and counts. Lists keep their order. key must be unique."""
    names = canon.select(C.lookup_key(F.col("shelf_raw")).alias("k"), F.trim("shelf_canon").alias("c")).groupBy("k").agg(F.max("c").alias("c"))
    flagged = nocontent.select(C.lookup_key(F.col("shelf_canon")).alias("f")).distinct().withColumn("flag", F.lit(True))
    each = works.select(key, F.posexplode(raw).alias("pos", "v")).withColumn("k", C.lookup_key(F.col("v"))).join(names, "k", "left").withColumn("c", F.coalesce(F.nullif("c", F.lit("")), F.col("k")))
    each = each.withColumn("f", C.lookup_key(F.col("c"))).join(flagged, "f", "left")
    lists = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "k", "c", F.coalesce("flag", F.lit(False)).alias("flag")))).alias("x"))
    part = lambda f: F.coalesce(F.transform("x", f), F.array())
    out = works.join(lists, key, "left").withColumn("shelves_canon", part(lambda x: x.c).cast("array<string>")).withColumn("shelves_lookup_keys", part(lambda x: x.k).cast("array<string>"))
    out = out.withColumn("shelves_noncontent_flags", part(lambda x: x.flag).cast("array<boolean>"))
    out = out.withColumn("shelves_canon_content", F.coalesce(F.transform(F.filter("x", lambda x: ~x.flag), lambda x: x.c), F.array()).cast("array<string>")).drop("x")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return out.withColumns({"n_shelves_raw": F.greatest(size(raw), F.lit(0)), "n_shelves_canon": size("shelves_canon"), "n_shelves_content": size("shelves_canon_content")})


def segments_long(bridged: DataFrame, segments: DataFrame, key: str = "work_id") -> DataFrame:
    """key, row_index, value, segment, seg_accepted: segments of canonical tags; tags without any aren't there."""
    long = exploded(bridged, "shelves_canon", key).withColumn("canon_key", C.lookup_key(F.col("value")))
    met = long.join(segment_dictionary(segments), "canon_key").select(key, "row_index", "value", F.explode("segments_list").alias("segment"), "seg_accepted")
    return met.filter("segment != ''")


def bridge_check(bridged: DataFrame, key: str = "work_id") -> DataFrame:
    """metric, value: null keys, lists of unequal length, counts that disagree, and least, median, p90 and greatest number of tags."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    out = metrics(bridged, rows=F.count("*"), null_keys=F.count_if(F.col(key).isNull()), flag_lengths=count_if(size("shelves_noncontent_flags") != size("shelves_canon")), key_lengths=count_if(size("shelves_lookup_keys") != size("shelves_canon")), counts=count_if(size("shelves_canon_content") != F.size(F.filter("shelves_noncontent_flags", lambda x: ~x))), least=F.min("n_shelves_canon"), greatest=F.max("n_shelves_canon"))
    q = quantiles(bridged, ["n_shelves_canon"], [0.5, 0.9])
    return out.unionByName(q.select(F.explode(F.array(F.struct(F.lit("p50").alias("metric"), F.col("q0").alias("value")), F.struct(F.lit("p90").alias("metric"), F.col("q1").alias("value")))).alias("x")).select("x.*"))


def long_check(long: DataFrame, value: str, key: str = "work_id") -> DataFrame:
    """metric, value of a long table: null keys, null and blank values, control characters, values that are mostly punctuation, rows beyond the first of (key, row_index, value)."""
    v = F.col(value)
    out = metrics(long, rows=F.count("*"), null_keys=F.count_if(F.col(key).isNull()), null_values=F.count_if(v.isNull()), blank=count_if(F.trim(v) == ""), control=count_if(v.rlike(r"\p{Cntrl}")), punctuation=count_if(F.regexp_count(v, F.lit(r"\p{P}")) > F.length(v) / 2))
    twice = long.groupBy(key, "row_index", value).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("value"))
    return out.unionByName(twice.select(F.lit("duplicates").alias("metric"), "value"))


def segment_check(long: DataFrame) -> DataFrame:
    """metric, value of segments: accepted in percent, under two and over thirty characters, mostly digits or punctuation."""
    s = F.col("segment")
    return metrics(long, rows=F.count("*"), accepted_pct=count_if(F.col("seg_accepted")) * 100.0 / F.greatest(F.count("*"), F.lit(1)), short=F.count_if(F.length(s) < 2), long=F.count_if(F.length(s) > 30), bad=F.count_if(X.is_bad_token(s)))


def dictionary_coverage(canon: DataFrame, long: DataFrame, value: str = "value") -> DataFrame:
    """metric, value: tags in use, those of them that the dictionary doesn't know, dictionary tags not in use."""
    used = long.select(C.lookup_key(F.col(value)).alias("k")).filter("k != ''").distinct()
    known = canon.select(C.lookup_key(F.col("shelf_canon")).alias("k")).filter("k != ''").distinct()
    both = used.withColumn("u", F.lit(1)).join(known.withColumn("d", F.lit(1)), "k", "full")
    return metrics(both, used=F.count("u"), unknown=F.count_if(F.col("d").isNull()), unused=F.count_if(F.col("u").isNull()))


def flag_alignment(bridged: DataFrame, nocontent: DataFrame) -> DataFrame:
    """metric, value: flagged tags that the list of tags without content doesn't hold, and tags of the list that aren't flagged."""
    each = bridged.select(F.explode(F.arrays_zip("shelves_canon", "shelves_noncontent_flags")).alias("x")).select(C.lookup_key(F.col("x.shelves_canon")).alias("k"), F.col("x.shelves_noncontent_flags").alias("flag"))
    listed = nocontent.select(C.lookup_key(F.col("shelf_canon")).alias("k")).distinct().withColumn("listed", F.lit(True))
    met = each.join(listed, "k", "left")
    return metrics(met, false_positives=count_if(F.col("flag") & F.col("listed").isNull()), false_negatives=count_if(~F.col("flag") & F.col("listed")))


def canonical_statistics(canon: DataFrame) -> DataFrame:
    """metric, value: raw and canonical tags, raw tags a canonical one, tags that are their own key in percent, blank keys, dash-heavy tags."""
    raw = metrics(canon, raw=F.count("*"), identity_pct=F.avg((F.col("shelf_raw") == F.col("shelf_canon")).cast("int")) * 100, blank=F.count_if(F.col("shelf_canon") == ""), dash_heavy=count_if(X.is_dash_heavy(F.col("shelf_raw"))))
    kinds = canon.select("shelf_canon").distinct().agg(F.count("*").cast("double").alias("value")).select(F.lit("canonical").alias("metric"), "value")
    return raw.unionByName(kinds)


def segmentation_statistics(segments: DataFrame) -> DataFrame:
    """metric, value: tags, tags of several parts, accepted ones, mean parts, parts in all, distinct parts."""
    one = metrics(segments, tags=F.count("*"), several=F.count_if(F.size("segments") > 1), accepted=count_if(F.col("accepted")), mean_parts=F.avg(F.size("segments")), parts=F.sum(F.size("segments")))
    kinds = segments.select(F.explode("segments").alias("s")).distinct().agg(F.count("*").cast("double").alias("value"))
    return one.unionByName(kinds.select(F.lit("distinct_parts").alias("metric"), "value"))
