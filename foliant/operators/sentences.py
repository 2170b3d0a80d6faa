"""Sentence tables from reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .sampling import hashed
from .stats import running_counts


def unique_reviews(reviews: DataFrame, key: str = "review_id", order: str | None = None) -> DataFrame:
    """One row of each review, the first by `order` (by all columns without one). Rows without a key are one another's copies."""
    names = [order] if order else [c for c in reviews.columns if c != key]
    best = F.min_by(F.struct(*reviews.columns), F.struct(*names))
    return reviews.groupBy(F.col(key).alias("__key")).agg(best.alias("r")).select("r.*")


def split_sentences(reviews: DataFrame, least: int = 10, text: str = "review_text", key: str = "review_id") -> DataFrame:
    """sentence_text, sentence_index, n_sentences_in_review beside the reviews' other columns: sentences of at least `least` characters. A sentence ends with
    a run of . ! ? before white space. Null and blank texts have none."""
    parts = F.filter(X.sentences(F.col(text)), lambda s: F.length(s) >= least)
    rest = [c for c in reviews.columns if c != text]
    own = reviews.select(*rest, parts.alias("__s")).filter("size(__s) > 0")
    return own.select(*rest, F.size("__s").alias("n_sentences_in_review"), F.posexplode("__s").alias("sentence_index", "sentence_text"))


def clean_sentences(sentences: DataFrame, key: str = "review_id") -> DataFrame:
    """Lower case, white space squeezed; empty ones go, and n_sentences_in_review counts those that are left."""
    own = sentences.withColumn("sentence_text", F.lower(X.squeeze(F.col("sentence_text")))).filter("sentence_text != ''")
    return own.withColumn("n_sentences_in_review", F.count("*").over(Window.partitionBy(key)).cast("int"))


def numbered(sentences: DataFrame, key: str = "review_id") -> DataFrame:
    """sentences with sentence_id from 0 in order of (key, sentence_index): reviews are numbered by running sums over ranges of their hash, so that no task orders all of them."""
    counts = sentences.groupBy(key).agg(F.count("*").alias("__n")).withColumn("__h", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 13), 16, 10).cast("double"))
    # Reviews of one hash share a start; their sentences are told apart by a rank in the pair.
    starts = running_counts(counts.groupBy("__h").agg(F.sum("__n").alias("__n")), "__h", "__n").select("__h", F.col("below").alias("__start"))
    placed = sentences.withColumn("__h", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 13), 16, 10).cast("double")).join(starts, "__h")
    rank = F.row_number().over(Window.partitionBy("__h").orderBy(key, "sentence_index")) - 1
    return placed.withColumn("sentence_id", (F.col("__start") + rank).cast("long")).drop("__h", "__start")


def sentence_dataset(joined: DataFrame, least: int = 10, clean: bool = True, key: str = "review_id") -> DataFrame:
    """Joined reviews without repeats as numbered sentences, cleaned or as they are."""
    names = [c for c in ("review_id", "work_id", "pop_tier", "rating", "review_text") if c in joined.columns]
    sentences = split_sentences(unique_reviews(joined.select(*names), key), least, key=key)
    out = numbered(clean_sentences(sentences, key) if clean else sentences, key)
    return out.select(*(c for c in ("sentence_id", "sentence_text", "review_id", "work_id", "pop_tier", "rating", "sentence_index", "n_sentences_in_review") if c in out.columns))


def capped(sentences: DataFrame, most: int, key: str = "sentence_id", seed: str = "42") -> DataFrame:
    """A random sample of sentences: the `most` with least hash. A sampling operator, not a limit of the engine."""
    return sentences.orderBy(hashed(F.col(key), seed=seed), key).limit(most)


def tokens(sentences: DataFrame, text: str = "sentence_text") -> DataFrame:
    """sentences with tokens, the words between white space."""
    return sentences.withColumn("tokens", F.filter(F.split(X.squeeze(F.col(text)), " "), lambda w: w != ""))
