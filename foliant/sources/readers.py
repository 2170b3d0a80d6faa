"""Readers with fixed schemas: JSON lines, CSV, Parquet; plain or compressed. Raw scalars come as text and are coerced later."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import coerce_number

CORRUPT = "_corrupt_record"


def json_lines(spark: SparkSession, path: str, schema: str, partitions: int | None = None, numbers: list[str] = ()) -> DataFrame:
    """Undecodable lines are dropped, blank ones ignored; `numbers` are text columns that become doubles, null where they hold none. A gzip file is one split: give
    partitions to deal it out."""
    out = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    out = out.repartition(partitions) if partitions else out
    return out.withColumns({c: coerce_number(F.col(c).cast("string")) for c in numbers})


def json_lines_with_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As json_lines(), with undecodable lines kept in column _corrupt_record."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_errors(rows: DataFrame) -> DataFrame:
    """One row: lines, and those of json_lines_with_errors() that couldn't be decoded."""
    return rows.agg(F.count("*").alias("n_lines"), F.count(CORRUPT).alias("n_errors"))


def json_lookup(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """One row of each key, the first present of `keys`; of several the last one wins: in order of the files' paths, then of their lines."""
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    # Numbers grow within a block of a file, and blocks are told apart by where they start.
    placed = raw.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("__at"))
    return last_by_key(placed, keys, F.col("__at")).drop("__at")


def last_by_key(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """One row of each key, the first present of `keys`: the one of greatest `order`."""
    key = F.coalesce(*(F.col(k) for k in keys if k in rows.columns))
    at = F.col(order) if isinstance(order, str) else order
    own = rows.withColumn("__key", key).filter("__key is not null")
    return own.groupBy("__key").agg(F.max_by(F.struct(*(F.col(c) for c in rows.columns)), at).alias("r")).select("r.*")


def csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, first: int | None = None) -> DataFrame:
    """Text fields may hold line breaks and doubled quotes; `columns` is pushed into the scan; `first` reads no more than that many rows."""
    out = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    out = out.select(*columns) if columns else out
    return out if first is None else out.limit(first)


def csv_texts(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Every column as text; names come from the header."""
    out = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    return out if first is None else out.limit(first)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a pattern names anything, on any file system."""
    return bool(matching(spark, path))


def matching(spark: SparkSession, pattern: str) -> list[tuple[int, str]]:
    """(time of change, path) of what a pattern names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return [(f.getModificationTime(), str(f.getPath().toString())) for f in found or []]


def newest(spark: SparkSession, pattern: str) -> str:
    """The path changed last of those that a pattern names, the greatest of equal ones; FileNotFoundError without any."""
    if not (found := matching(spark, pattern)):
        raise FileNotFoundError(pattern)
    return max(found)[1]


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of several places that is there."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def by_extension(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Parquet, JSON lines or CSV by the path's ending; ValueError for others. Pickles aren't read: their place is taken by Parquet."""
    name = path.rstrip("/").lower().removesuffix(".gz")
    if name.endswith(".parquet"):
        out = spark.read.parquet(path)
    elif name.endswith((".json", ".jsonl")):
        out = spark.read.json(path)
    elif name.endswith(".csv"):
        out = csv_texts(spark, path)
    else:
        raise ValueError(f"no reader for {path}")
    return out if first is None else out.limit(first)


def csv_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    return csv_texts(spark, path) if exists(spark, path) else None


def item_counts(rows: DataFrame, column: str, first: int | None = None) -> DataFrame:
    """item, n over an array column, of all rows or the first ones."""
    own = rows.select(column)
    return (own if first is None else own.limit(first)).select(F.explode(column).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def key_profile(rows: DataFrame, text: str, first: int = 1000, samples: int = 5) -> DataFrame:
    """key, n, share in percent, samples (some values as text, in their order): keys of JSON objects in a text column, of its first rows."""
    some = rows.select(text).limit(first)
    each = some.select(F.explode(F.from_json(text, "map<string,string>")).alias("key", "value"))
    total = some.agg(F.count("*").alias("total"))
    counts = each.groupBy("key").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("value")), 1, samples).alias("samples"))
    return counts.join(F.broadcast(total)).select("key", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("share"), "samples")


_COUNTS = {"processed": r"Progress: ([\d,]+) processed", "matched": r"Matched: ([\d,]+) \(", "english": r"English: ([\d,]+) \(", "written": r"Written: ([\d,]+) \("}
_SHARES = {"rate": r"Rate: ([\d.]+) reviews/sec", "matched_pct": r"Matched: [\d,]+ \(([\d.]+)%", "english_pct": r"English: [\d,]+ \(([\d.]+)%", "written_pct": r"Written: [\d,]+ \(([\d.]+)%", "elapsed_min": r"Elapsed: ([\d.]+) min"}


def progress_lines(lines: DataFrame) -> DataFrame:
    """Progress lines of a log (column value): counts with thousands separators, shares in percent, time stamp. Values that a line lacks are 0."""
    v = F.col("value")
    number = lambda p, kind: F.coalesce(F.nullif(F.replace(F.regexp_extract(v, p, 1), F.lit(","), F.lit("")), F.lit("")).try_cast(kind), F.lit(0).cast(kind))
    counts = {k: number(p, "bigint") for k, p in _COUNTS.items()} | {k: number(p, "double") for k, p in _SHARES.items()}
    return lines.filter(v.rlike(r"Progress: [\d,]+ processed")).select(*(c.alias(k) for k, c in counts.items()), F.when(v.contains(" - "), F.split_part(v, F.lit(" - "), F.lit(1))).otherwise("").alias("timestamp"))


def last_progress(spark: SparkSession, path: str) -> dict | None:
    """The furthest progress of a log file; {'completed': True} of a log that only says so; None without either."""
    if not exists(spark, path):
        return None
    lines = spark.read.text(path)
    best = progress_lines(lines).orderBy(F.desc("processed"), F.desc("timestamp")).first()
    if best:
        return best.asDict()
    return {"completed": True} if lines.filter(F.col("value").rlike("Extraction complete!|Script completed successfully!")).first() else None


def parameters(path: str) -> dict:
    """A file of parameters: JSON, or YAML where a reader of it is installed."""
    text = Path(path).read_text()
    if path.lower().endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise ValueError("reading YAML needs a YAML library; JSON works without") from e
    return yaml.safe_load(text) or {}


def array_file_to_json(source: str, target: str) -> int:
    """A NumPy array file as a JSON file of nested lists; the number of entries. Arrays of objects aren't read."""
    import numpy as np

    values = np.load(source, allow_pickle=False)
    Path(target).write_text(json.dumps(values.tolist()))
    return len(values)
