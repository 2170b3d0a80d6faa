"""One row for each work from its editions, with author, series and genres.

Editions: book_id, work_id, title, description, language_code, publication_year, num_pages, ratings_count, text_reviews_count, average_rating (numbers
may be null), authors array<struct<author_id>>, series array<string>, popular_shelves array<struct<name>>, and line (any orderable column that tells
their order). A null work_id is no work. A work's list of book ids is its output, so it is as long as the work has editions; all else is combined in the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C

STAND_ALONE = "stand_alone"


def blank(c: Column) -> Column:
    """Trimmed, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def edition_rollup(editions: DataFrame) -> DataFrame:
    """Sums, weighted mean (only where every edition with a count of ratings has a rating), median of positive pages, ids by count of ratings,
    languages, longest description (the first of equal ones), names of tags, first title, median year."""
    n, rating, year = F.col("ratings_count"), F.col("average_rating"), F.col("publication_year")
    pages, text = F.floor("num_pages"), blank(F.col("description"))
    both = F.count(F.when(n.isNotNull() & rating.isNotNull(), 1)) == F.count(n)
    mean = F.when(both & (F.sum(n) > 0), F.sum(rating * n) / F.sum(n))
    ids = F.filter(F.collect_list(F.when(F.col("book_id").isNotNull(), F.struct((-F.coalesce(n, F.lit(0))).alias("n"), F.col("book_id").cast("string").alias("id")))), lambda x: x.isNotNull())
    best = F.min_by(text, F.when(text.isNotNull(), F.struct((-F.length(text)).alias("n"), F.col("line"))))
    return editions.filter("work_id is not null").groupBy("work_id").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("ratings_count_sum"), F.coalesce(F.sum("text_reviews_count"), F.lit(0)).alias("text_reviews_count_sum"),
        mean.alias("average_rating_weighted_mean"), F.median(F.when(pages > 0, pages)).alias("num_pages_median"),
        F.transform(F.array_sort(ids), lambda x: x.id).alias("book_id_list_en"), F.array_sort(F.collect_set(F.nullif("language_code", F.lit("")))).alias("language_codes_en"),
        F.coalesce(best, F.lit("")).alias("description"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("popular_shelves", lambda x: x["name"]))))), ",").alias("popular_shelves"),
        F.min_by(blank(F.col("title")), F.when(blank(F.col("title")).isNotNull(), F.col("line"))).alias("edition_title"),
        F.floor(F.median(F.when(F.floor(year).between(1800, 2030), F.floor(year)))).cast("int").alias("edition_year"), F.count("*").alias("n_editions"),
    )


def primary_author(editions: DataFrame) -> DataFrame:
    """work_id, author_id: the most frequent first author; of equal ones that of most ratings, then the least id as text."""
    first = F.get("authors", F.lit(0))["author_id"].cast("string")
    own = editions.filter("work_id is not null").select("work_id", first.alias("author_id"), "ratings_count").filter("author_id != ''")
    counts = own.groupBy("work_id", "author_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("ratings_count"), F.lit(0)).alias("r"))
    return counts.groupBy("work_id").agg(F.min_by("author_id", F.struct((-F.col("n")).alias("n"), (-F.col("r")).alias("r"), "author_id")).alias("author_id"))


def first_series(editions: DataFrame) -> DataFrame:
    """work_id, series_id: the first id over all editions of a work, whatever their language."""
    each = editions.filter("work_id is not null").select("work_id", "line", F.posexplode("series").alias("pos", "series_id")).filter("series_id != ''")
    return each.groupBy("work_id").agg(F.min_by("series_id", F.struct("line", "pos")).alias("series_id"))


def work_genres(works: DataFrame, genres: DataFrame) -> DataFrame:
    """work_id, genres: sorted names of the genre maps (book_id, genres) of a work's books, each once, joined by commas."""
    books = works.select("work_id", F.explode("book_id_list_en").alias("book_id")).distinct()
    names = books.join(genres.select(F.col("book_id").cast("string"), F.explode(F.map_keys("genres")).alias("name")), "book_id").select("work_id", "name").distinct()
    return names.groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("genres"))


def chosen_year(original: Column, of_editions: Column) -> Column:
    """The work's own year if it lies in 1800 to 2030, else the median of its editions' years."""
    own = original.try_cast("int")
    return F.coalesce(F.when(own.between(1800, 2030), own), of_editions)


def chosen_title(*sources: Column) -> tuple[Column, Column]:
    """The first title that isn't blank, and the number of its source (from 0); Untitled without one."""
    return F.coalesce(*(blank(s) for s in sources), F.lit("Untitled")), F.coalesce(*(F.when(blank(s).isNotNull(), k) for k, s in enumerate(sources)), F.lit(len(sources)))


def build_works(editions: DataFrame, works: DataFrame, authors: DataFrame, series: DataFrame, genres: DataFrame, years: tuple[int, int] = (2000, 2020), sample: int | None = None) -> DataFrame:
    """The work table: English editions rolled up, with work (work_id, original_title, best_book_title, title, original_publication_year), author
    (author_id, name, average_rating, ratings_count) and series (series_id, title, series_works_count) looked up. Works without a year, or with one
    outside `years`, go. With `sample`, that many works, those with least hash of their id."""
    english = editions.filter(C.is_english(F.col("language_code")))
    rolled = edition_rollup(english)
    if sample is not None:
        rolled = rolled.orderBy(F.md5(F.concat(F.col("work_id").cast("string"), F.lit("42"))), "work_id").limit(sample)
    w = works.select("work_id", "original_title", "best_book_title", F.col("title").alias("work_title"), "original_publication_year")
    a = authors.select(F.col("author_id").cast("string").alias("author_id"), F.col("name").alias("author_name"), F.col("average_rating").alias("author_average_rating"), F.col("ratings_count").alias("author_ratings_count"))
    s = series.select(F.col("series_id").cast("string").alias("series_id"), F.col("title").alias("series_title"), "series_works_count")
    title, source = chosen_title(*(F.col(c) for c in ("original_title", "best_book_title", "work_title", "edition_title")))
    out = rolled.join(w, "work_id", "left").withColumn("publication_year", chosen_year(F.col("original_publication_year"), F.col("edition_year")))
    out = out.filter(F.col("publication_year").between(*years)).withColumn("title", C.without_brackets(title)[0]).withColumn("title_source", source)
    out = out.join(primary_author(english), "work_id", "left").join(a, "author_id", "left").join(first_series(editions), "work_id", "left").join(s, "series_id", "left")
    out = out.join(work_genres(rolled, genres), "work_id", "left")
    filled = {"author_name": "", "author_average_rating": 0.0, "author_ratings_count": 0, "genres": ""}
    names = "work_id book_id_list_en title publication_year language_codes_en num_pages_median description popular_shelves genres author_id author_name author_average_rating author_ratings_count series_id series_title series_works_count ratings_count_sum text_reviews_count_sum average_rating_weighted_mean".split()
    return out.fillna(filled).select(*names, "title_source")


def sorted_works(works: DataFrame) -> DataFrame:
    """By year, then most ratings, then id; nulls last."""
    return works.orderBy(F.asc_nulls_last("publication_year"), F.desc_nulls_last("ratings_count_sum"), F.asc_nulls_last("work_id"))


def analysis_columns(works: DataFrame) -> DataFrame:
    """The names that later steps read: genres_str, shelves_str, series_works_count_numeric, and stand_alone for works without a series."""
    renamed = works.withColumnsRenamed({"genres": "genres_str", "popular_shelves": "shelves_str"})
    own = renamed.withColumn("series_works_count_numeric", F.col("series_works_count").cast("string").try_cast("double"))
    return own.withColumn("series_id", F.coalesce("series_id", F.lit(STAND_ALONE)))


def series_flag(series_id: Column) -> Column:
    """1 for a work of a series, 0 for one that stands alone. Null counts as of a series."""
    return (F.coalesce(series_id.cast("string"), F.lit("nan")) != STAND_ALONE).cast("int")


def editions_per_work(works: DataFrame) -> DataFrame:
    """How many works have how many editions."""
    return works.groupBy(F.size("book_id_list_en").alias("n_editions")).agg(F.count("*").alias("n_works"))


def author_rollup(works: DataFrame) -> DataFrame:
    """author_id with least name and rating (they are one an author), sums of ratings and reviews, and the number of works."""
    return works.filter("author_id is not null").groupBy("author_id").agg(
        F.min("author_name").alias("author_name"), F.min("author_average_rating").alias("author_average_rating"), F.sum("ratings_count_sum").alias("ratings_count_sum"),
        F.sum("text_reviews_count_sum").alias("text_reviews_count_sum"), F.count("work_id").alias("n_works"),
    )


def book_to_work(works: DataFrame) -> DataFrame:
    """book_id, work_id; of a book in several works the last work (by id) counts."""
    return works.select("work_id", F.explode("book_id_list_en").alias("book_id")).groupBy("book_id").agg(F.max("work_id").alias("work_id"))


def books_of_works(works: DataFrame, subset: DataFrame) -> DataFrame:
    """book_id of the works that the subset names, each once."""
    return works.join(subset.select("work_id").distinct(), "work_id", "left_semi").select(F.explode("book_id_list_en").alias("book_id")).distinct()


def joined_reviews(reviews: DataFrame, works: DataFrame, how: str = "inner") -> DataFrame:
    """Reviews (review_id, book_id, review_text, rating) with their work's columns; names in both get _review and _book. how: inner, left, right or outer."""
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"how must be inner, left, right or outer, not {how!r}")
    own = reviews.withColumn("book_id", F.col("book_id").cast("string")).join(book_to_work(works), "book_id", "left")
    both = (set(own.columns) & set(works.columns)) - {"work_id"}
    left, right = own.withColumnsRenamed({c: f"{c}_review" for c in both}), works.withColumnsRenamed({c: f"{c}_book" for c in both})
    return left.join(right, "work_id", how)
