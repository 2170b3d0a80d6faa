"""What the training-data operators share: tables in the shared folder, Arrow helpers, hashing, components."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections import ChainMap
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that split words: space and 0x09 to 0x0D.
SPACES = b" \t\n\x0b\x0c\r"
#: Used only where spark.checkpoint.dir is unset and the master is local.
LOCAL_SHARED = "/tmp/checkpoints/foliant"
#: Column of row numbers; numbered() makes it.
ROW = "__foliant_row"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found := LOCAL_SHARED)
    return found.rstrip("/")


#: All folders that this process has made, in order; a caller that has read an operator's result may remove them.
MADE: list[Scratch] = []


class Scratch:
    """Tables of one operator run, under one folder of the shared directory.

    A written table cuts lineage: a lost executor costs the tasks it ran, not the steps before. drop() removes
    tables which no later step reads, so that the peak of disk is that of one or two steps.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        MADE.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: Iterable[str] = (), plain: Iterable[str] = ()) -> DataFrame:
        """`plain` columns hardly repeat: Parquet needn't look for a dictionary of them."""
        out = df.write.option("compression", "zstd").partitionBy(*partition_by)
        for c in plain:
            out = out.option(f"parquet.enable.dictionary#{c}", "false")
        out.parquet(self.path(name))
        self.collect_garbage()
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep_only(self, *names: str) -> None:
        """Drops all tables but those that the operator's result reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            self.drop(*(x for s in fs.listStatus(path) if (x := s.getPath().getName()) not in names))

    def remove(self) -> None:
        """Drops the folder; the operator's result can't be read after this."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def collect_garbage(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of finished steps: once no plan of theirs is held, here or in the JVM."""
        gc.collect()
        for _ in range(2):
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.1)


def numbered(docs: DataFrame, scratch: Scratch, name: str = "numbered") -> DataFrame:
    """docs with a number for each row (ROW), written. All steps that meet by the number read this table: numbers of two scans of one
    input need not agree, as executors come and go."""
    return docs if ROW in docs.columns else scratch.write(docs.withColumn(ROW, F.monotonically_increasing_id()), name, plain=["text"])


def buckets_for(spark: SparkSession, df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Partitions for a keyed exchange: the session's number, more if the input's size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), known // bytes_each)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, batch_mb: int = 4) -> DataFrame:
    """mapInArrow for functions that yield dicts of columns (lists or numpy arrays), with Arrow batches of bounded bytes: few for steps that
    hold many times a batch's size, more for those that fold equal values of a batch. The bound is a setting of the session, and stays."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_mb << 20))
    kinds = pa.schema([pa.field(c, t) for c, t in ((x.name, _arrow(x.dataType.simpleString())) for x in _struct(spark, schema))])

    def run(batches):
        try:
            for columns in fn(batches):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in kinds], schema=kinds)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns a worker's free memory to the system at the end of a partition: workers live on and meet other steps."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _struct(spark: SparkSession, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def _arrow(kind: str) -> pa.DataType:
    known = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}
    return known[kind]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [b"" if t is None else t for t in batch.column(name).cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo:
    """Words a worker has met, up to a limit of entries and of characters; what doesn't fit is made again when it comes. Its size
    doesn't grow with the data."""

    def __init__(self, make: Callable[[list], Iterable], limit: int = 300_000, room: int = 8 << 20):
        self.make, self.limit, self.room, self.known = make, limit, room, {}

    def lookup(self, words: Iterable) -> dict:
        """A mapping that holds all the words. Ask for many words at once: new ones are made together."""
        known = self.known
        if not (new := list({w for w in words if w not in known})):
            return known
        made = dict(zip(new, self.make(new)))
        size = sum(map(len, new))
        if len(self.known) + len(made) <= self.limit and size <= self.room:
            self.room -= size
            self.known.update(made)
            return self.known
        return ChainMap(self.known, made)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    edges: columns a, b (any one orderable type). Returns node, component (smallest node reachable), one row for
    each node of an edge. Only DataFrame operations; the smallest neighbours come from map-side combined
    aggregates, and a hub's rows meet them by a join that AQE can split. Each round is a written table. Null ends
    and self-loops are ignored; no edges give no rows.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    cur = scratch.write(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    before, k = state(cur), 0
    while before[0]:
        k += 1
        # Large star: each neighbour above a node points to the smallest of the node and its neighbours.
        around = both(cur)
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node's smaller neighbours, and the node, point to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a != b").distinct()
        cur = scratch.write(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        after = state(cur)
        if after == before:
            break
        before = after
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
