"""Whole runs: each step's output is the next one's input, a failed check stops a run, and results are written where a folder is named."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import binning, clean, tags
from .models import topics
from .operators import quality, sampling, sentences, stats, tagging, works
from .sources import sinks

#: The work table's columns, its ids and its counts.
COLUMNS = "work_id book_id_list_en title publication_year language_codes_en num_pages_median description popular_shelves genres author_id author_name author_average_rating author_ratings_count series_id series_title series_works_count ratings_count_sum text_reviews_count_sum average_rating_weighted_mean".split()
COUNTS = ["ratings_count_sum", "text_reviews_count_sum", "author_ratings_count"]
NUMBERS = [*COUNTS, "num_pages_median", "average_rating_weighted_mean", "publication_year"]


def chain(rows: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], path: str | None = None, stop_after: str | None = None) -> tuple[DataFrame, list[str]]:
    """Runs the steps in order; with a path each result is written and read again, and one that is there already isn't made again. An exception ends the run."""
    done = []
    for name, step in steps.items():
        if path is None:
            rows = step(rows)
        else:
            from .sources import readers

            spark, place = rows.sparkSession, f"{path.rstrip('/')}/{name}"
            if not readers.exists(spark, f"{place}/_SUCCESS"):
                step(rows).write.mode("overwrite").parquet(place)
            rows = spark.read.parquet(place)
        done.append(name)
        if name == stop_after:
            break
    return rows, done


def build(editions: DataFrame, work: DataFrame, authors: DataFrame, series: DataFrame, genres: DataFrame, sample: int | None = None, path: str | None = None) -> DataFrame:
    """The work table, checked, sorted, and written where a folder is named."""
    out = works.sorted_works(quality.check_build(works.build_works(editions, work, authors, series, genres, sample=sample)))
    if path:
        sinks.save(out, sinks.stamped(path, "works"))
    return out


def quality_steps(year: str = "publication_year", years: tuple[int, int] = (2000, 2017)) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The steps of the quality run: missing values, duplicates, derived columns, years, narrower types, the gate."""

    def missing(df: DataFrame) -> DataFrame:
        flagged = quality.missing_flags(df, ["series_id", "series_title", "series_works_count"])
        return quality.dropped_nulls(flagged, ["average_rating_weighted_mean", "num_pages_median", "description"])[0]

    def duplicates(df: DataFrame) -> DataFrame:
        return quality.resolved(df, ["work_id"], "title", ["title", "author_id"], ["author_name"])

    def derived(df: DataFrame) -> DataFrame:
        pages = binning.fixed_bins(F.col("num_pages_median"), [0, 200, 400, 600, float("inf")], ["Short", "Medium", "Long", "Very Long"])
        rating = binning.fixed_bins(F.col("average_rating_weighted_mean"), [0, 2, 3, 4, 5], ["Poor", "Fair", "Good", "Excellent"])
        own = df.withColumn("decade", binning.decade(F.col(year))).withColumn("book_length_category", pages).withColumn("rating_category", rating)
        return binning.quantile_bins(own, "ratings_count_sum", ["Low", "Medium", "High", "Very High"], "popularity_category")

    def gate(df: DataFrame) -> DataFrame:
        failed = quality.range_checks(df, {year: years}).filter("n_outside > 0").count()
        if failed:
            raise ValueError("years are outside the range")
        return df

    return {"step1_missing": missing, "step2_duplicates": duplicates, "step3_types": derived, "step4_years": lambda df: quality.years_within(df, year, *years), "step5_narrow": quality.narrowed, "step6_gate": gate}


def run_quality(rows: DataFrame, path: str | None = None, stop_after: str | None = None) -> dict:
    """The six steps, the gates' rows and the certificate."""
    out, done = chain(rows, quality_steps(), path, stop_after)
    checks = quality.step_scores(out, ["title_duplicate_flag", "author_id_duplicate_flag"], "publication_year", (2000, 2017), ["average_rating_weighted_mean", "ratings_count_sum", "text_reviews_count_sum", "num_pages_median"], None)
    gates = quality.gates(quality.component_scores(checks))
    return {"rows": out, "steps": done, "checks": checks, "gates": gates, "certificate": quality.certificate(gates)}


def run_audit(rows: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Missing values, types, distributions and overdispersion of the counts."""
    counts = [c for c in COUNTS if c in rows.columns]
    out = {"missing": quality.missingness(rows), "types": quality.type_audit(rows), "heavy_tails": stats.count_profile(rows, counts), "overdispersion": stats.overdispersion(rows, counts)}
    if path:
        sinks.reports(out, "Audit", path)
    return out


def run_analysis(rows: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Years, descriptions, pages, editions, authors, suspicious years, ratings, and statistics of the numbers."""
    own = [c for c in NUMBERS if c in rows.columns]
    out = {
        "years": quality.year_anomalies(rows, "publication_year", 2000, 2020), "descriptions": quality.text_gaps(rows, ["description"]), "pages": quality.page_anomalies(rows), "editions": works.editions_per_work(rows),
        "authors": works.author_rollup(rows), "ratings": quality.rating_anomalies(rows, "average_rating_weighted_mean", COUNTS), "numbers": quality.field_statistics(rows, own),
    }
    if path:
        sinks.reports(out, "Analysis", path)
    return out


def run_texts(rows: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Descriptions, tags and genres cleaned, marked as such with the time of the run, and the gate on the result."""
    own = rows.withColumn("description", clean.full_clean(F.col("description"))).withColumn("popular_shelves", clean.standard_tags(F.col("popular_shelves"))).withColumn("genres", clean.standard_genres(F.col("genres")))
    own = own.withColumn("text_preprocessing_applied", F.lit(True)).withColumn("text_preprocessing_timestamp", F.current_timestamp())
    out = {"rows": own, "gate": quality.text_gate(own, ["description"], ["popular_shelves", "genres"])}
    if path:
        sinks.save(own, f"{path}/rows")
    return out


def run_reviews(reviews: DataFrame, books: DataFrame, mode: str = "ids", least: int = 10) -> dict[str, DataFrame]:
    """English reviews of some books (mode ids: book_id; mode works: a work table with book_id_list_en), once each, and the funnel."""
    if mode not in ("ids", "works"):
        raise ValueError(f"mode must be ids or works, not {mode!r}")
    wanted = (books if mode == "ids" else books.select(F.explode("book_id_list_en").alias("book_id"))).select(F.col("book_id").cast("string").alias("__b")).distinct().withColumn("__in", F.lit(True))
    met = reviews.join(wanted, F.col("book_id").cast("string") == F.col("__b"), "left").drop("__b")
    staged = met.withColumn("__english", F.coalesce("__in", F.lit(False)) & clean.is_english_review(F.col("review_text"), least))
    counts = quality.metrics(staged, processed=F.count("*"), matched=F.count("__in"), english=F.count_if("__english"))
    return {"reviews": sentences.unique_reviews(staged.filter("__english").drop("__in", "__english")), "funnel": counts}


def run_tags(rows: DataFrame, column: str, target: str = "normalize", key: str = "work_id", separator: str | None = ",") -> dict[str, DataFrame]:
    """One of normalize, bridge, diagnostics and validate; each does what those before it do as well."""
    order = ("normalize", "bridge", "diagnostics", "validate")
    if target not in order:
        raise ValueError(f"target must be one of {', '.join(order)}")
    own = rows.withColumn("shelves", F.filter(F.transform(F.split(column, separator), lambda x: F.trim(x)), lambda x: x != "") if separator else F.col(column))
    out = tagging.normalisation(tagging.tag_counts(own, "shelves", None))
    if target != "normalize":
        out["books"] = tagging.bridge(own, out["canonical"], out["noncontent"], key=key)
        out |= {"raw_long": tagging.exploded(own, "shelves", key), "canon_long": tagging.exploded(out["books"], "shelves_canon", key), "segments_long": tagging.segments_long(out["books"], out["segments"], key)}
    if target in ("diagnostics", "validate"):
        out |= {"canonical_statistics": tagging.canonical_statistics(out["canonical"]), "segmentation_statistics": tagging.segmentation_statistics(out["segments"])}
    if target == "validate":
        out |= {"bridge_check": tagging.bridge_check(out["books"], key), "long_check": tagging.long_check(out["canon_long"], "value", key), "segment_check": tagging.segment_check(out["segments_long"]), "coverage": tagging.dictionary_coverage(out["canonical"], out["canon_long"]), "flags": tagging.flag_alignment(out["books"], out["noncontent"])}
    return out


def run_topics(rows: DataFrame, key: str, text: str, optimize: bool = False, calls: int | None = None, path: str | None = None, **parameters) -> dict:
    """A topic model of texts; with `optimize`, of the parameters whose mean coherence is best."""
    from .models import search

    own = topics.hashed_vectors(rows.select(key, text).withColumn("tokens", clean.counted_words(F.col(text))).filter("size(tokens) > 0"))
    score = lambda p: topics.coherence(topics.TopicModel().set(**p).train(own, key, text)["words"], own).agg(F.avg("c_v")).first()[0] or -1.0
    if optimize:
        parameters = search.Search(search.DEFAULT, path=path).run(score, calls)["parameters"]
    return topics.TopicModel().set(**parameters).train(own, key, text) | {"parameters": parameters}


def run_corpus_report(full: DataFrame, subset: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Statistics of both corpora and all comparisons between them."""
    own = [c for c in NUMBERS if c in full.columns and c in subset.columns]
    out = {"full": quality.field_statistics(full, own), "subset": quality.field_statistics(subset, own), "validation": stats.cross_validation(full, subset)}
    if path:
        sinks.reports(out, "Corpus", path)
    return out


def sampled_subset(table: DataFrame, total: int = 6000) -> DataFrame:
    """The stratified subset of a work table with analysis columns: comics out, genres merged, tiers, page quartiles and genre groups."""
    own = table.filter(~F.coalesce(F.col("genres_str").rlike("(?i)comics|graphic"), F.lit(False))).withColumn("genres_str", clean.sampled_genres(F.col("genres_str")))
    own = own.withColumn("series_flag", works.series_flag(F.col("series_id"))).withColumn("genre_group", clean.genre_group(F.col("genres_str")))
    own = binning.tiers(own, "average_rating_weighted_mean", "pop_tier")
    own = binning.quantile_bins(own, "num_pages_median", ["Q1", "Q2", "Q3", "Q4"], "pages_bin")
    return sampling.tiered_sample(own, total)


def coverage_table(books: DataFrame, reviews: DataFrame, path: str | None = None) -> DataFrame:
    """Books with n_reviews (0 without) and has_reviews; written where a folder is named."""
    counts = reviews.filter("work_id is not null").groupBy("work_id").agg(F.count("*").alias("n_reviews"))
    out = books.join(counts, "work_id", "left").fillna({"n_reviews": 0}).withColumn("has_reviews", F.col("n_reviews") > 0)
    if path:
        sinks.save(out, path, "csv")
    return out


def classified(tag_table: DataFrame) -> DataFrame:
    """Tags with the class of the rules."""
    return tag_table.withColumn("rule_category", tags.rule_class(F.col("shelf_canon")))


def start(app: str = "foliant") -> SparkSession:
    """The session that is there, or a new one with the engine's name."""
    return SparkSession.builder.appName(app).getOrCreate()
