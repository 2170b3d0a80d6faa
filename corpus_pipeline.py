"""A corpus pipeline of five stages, each one of the training-data operators over all that the stage before it kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common, exact_dedup, near_dedup, packing, quality, suffix_dedup
from foliant.session import table


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of a numbered table whose number isn't among `dropped` (column row)."""
    return rows.join(dropped.select(F.col("row").alias(common.ROW)), common.ROW, "left_anti").drop(common.ROW)


#: Folders of the stage that ran last.
_made: list[common.Scratch] = []


def _stage(run):
    """A stage that first removes the folders of the one before: its result has been written and is read again as `docs`. Where `docs` still
    reads from them, they stay; so does the last stage's folder, as no stage comes after it."""

    @wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _made:
            read = docs.inputFiles()
            for folder in [f for f in _made if f.spark is spark and not any(f.root.split("://")[-1] in path for path in read)]:
                folder.remove()
        before = len(common.MADE)
        out = run(spark, docs, sf_dir)
        _made[:] = common.MADE[before:] if run is not STAGES[-1][1].__wrapped__ else []
        return out

    return stage


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return common.numbered(docs, common.Scratch(spark, "rows"))


@_stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under the threshold go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), teaches=quality.teaching_rows())
    return docs.filter(quality.score_column(model, docs["text"]) >= quality.THRESHOLD)


@_stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one stays."""
    rows = _numbered(spark, docs)
    return _without(rows, exact_dedup.exact_duplicates(rows).filter("not kept"))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of at least 0.8 of their five-word shingles the first (doc_id, row) stays."""
    rows = _numbered(spark, docs)
    copies = near_dedup.near_copies(rows)
    return _without(rows, copies.filter("row != keep_row"))


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more which occurred before are cut out."""
    return suffix_dedup.without_repeats(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048."""
    return packing.pack_documents(docs, packing.vocabulary())


STAGES = [("quality", quality_filter), ("exact", drop_exact_copies), ("near", drop_near_copies), ("repeats", cut_repeats), ("packing", pack)]

#: Not expressible in SQL: the classifier, fingerprints and suffix matches. Tests compare the stages and their operators with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
