"""Operator 7: exact dedup by deterministic block naming.

A text without its white space is cut into blocks of fixed size. Blocks are sorted, and equal blocks get the same
integer name; then names of adjacent pairs are sorted and named in the same way, until each document has one
name. Equal (level, name) means equal texts: names come from comparing contents, so nothing can collide.

Before a shuffle each Arrow batch folds equal blocks into one row that lists where they occur (`refs`), so a block
that a third of all rows share is one row for each batch, and texts cross the network once. Folded rows are written with a number; only blocks and numbers are
sorted and named, and names meet the refs by number, so that a common block's places are unfolded where its batches are, not in one task. A name is
(partition, rank within its sorted partition); equal blocks are in one partition.

Null counts as empty; texts of white space only equal the empty text. Of equal texts the row with most code points, then the
smallest doc_id, then the first row stays. Repeated rows are rows like others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK = 4096
#: Where a block occurs: row, place in its document, blocks of the document; the rest describes the document.
REF = np.dtype([("row", "<i8"), ("idx", "<i4"), ("n", "<i4"), ("cp", "<i8"), ("doc", "<i8"), ("null", "?"), ("sha", "V32")])
NAMED = "row long, idx int, n int, cp long, doc_id long, sha string, name long"


FOLDED = "fold long, key binary, refs binary"


def fold(keys: list[bytes], refs: np.ndarray, first: int) -> dict:
    """One row for each distinct key of a batch, with all of its refs, numbered from `first`."""
    by: dict[bytes, list[int]] = {}
    for i, k in enumerate(keys):
        by.setdefault(k, []).append(i)
    return {"fold": np.arange(first, first + len(by)), "key": list(by), "refs": [refs[i].tobytes() for i in by.values()]}


def text_blocks(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            keys, refs = [], []
            for doc, text, row in zip(b.column(0).to_pylist(), C.texts(b), b.column(2).to_pylist()):
                body = text.encode().translate(None, C.SPACES)
                n = max(1, -(-len(body) // block))
                sha = hashlib.sha256(body).digest()
                for i in range(n):
                    keys.append(body[i * block : (i + 1) * block])
                    refs.append((row, i, n, len(text), doc or 0, doc is None, sha))
            yield fold(keys, np.array(refs, REF), at)
            at += len(keys)

    return C.arrow_map(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), (docs[C.ROW] if C.ROW in docs.columns else F.monotonically_increasing_id()).alias("row")), run, FOLDED)


def name_sorted(folded: DataFrame, parts: int) -> DataFrame:
    """fold, name: keys named by their rank in a sorted partition."""

    def run(batches):
        name, last = TaskContext.get().partitionId() << 40, None
        for b in batches:
            names = []
            for key in b.column("key").to_pylist():
                name += key != last
                last = key
                names.append(name)
            yield {"fold": b.column("fold"), "name": names}

    return C.arrow_map(folded.select("fold", "key").repartition(parts, "key").sortWithinPartitions("key"), run, "fold long, name long")


def unfolded(folded: DataFrame, parts: int) -> DataFrame:
    """One row for each place of the keys of a written table of folded rows, with the key's name."""

    def run(batches):
        for b in batches:
            names = b.column("name").to_numpy()
            refs = [np.frombuffer(x, REF) for x in b.column("refs").to_pylist()]
            r = np.concatenate(refs) if refs else np.empty(0, REF)
            yield {
                "row": r["row"], "idx": r["idx"], "n": r["n"], "cp": r["cp"], "doc_id": [None if z else d for d, z in zip(r["doc"].tolist(), r["null"].tolist())],
                "sha": [x.tobytes().hex() for x in r["sha"]], "name": np.repeat(names.astype(np.int64), [len(x) for x in refs]),
            }

    return C.arrow_map(folded.select("fold", "refs").join(name_sorted(folded, parts), "fold").select("name", "refs"), run, NAMED)


def pair_keys(names: DataFrame) -> DataFrame:
    """Adjacent names of a document as the next level's keys; an odd last name pairs with -1."""
    half = F.floor(F.col("idx") / 2).cast("int")
    pairs = names.groupBy("row", half.alias("idx")).agg(F.max("n").alias("n"), F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            refs = np.zeros(b.num_rows, REF)
            refs["row"], refs["idx"], refs["n"] = b.column("row").to_numpy(), b.column("idx").to_numpy(), (b.column("n").to_numpy() + 1) // 2
            pair = np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()], axis=1).astype(">i8")
            yield fold([x.tobytes() for x in pair], refs, at)
            at += b.num_rows

    return C.arrow_map(pairs, run, FOLDED)


def identities(docs: DataFrame, scratch: C.Scratch, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(row, level, name) of every document, and (row, cp, doc_id, sha)."""
    spark = docs.sparkSession
    parts = C.buckets_for(spark, docs)
    named = lambda folds, n, k: scratch.write(unfolded(scratch.write(folds, f"folded{k}", plain=["key", "refs"]), n), f"level{k}")
    first = named(text_blocks(docs, block), parts, 0)
    scratch.drop("folded0")
    facts = first.filter("idx = 0").select("row", "cp", "doc_id", "sha")
    level, cur, done = 0, first, [first.filter("n = 1").select("row", F.lit(0).alias("level"), "name")]
    while (more := cur.filter("n > 1")).head(1):
        level += 1
        cur = named(pair_keys(more.select("row", "idx", "n", "name")), C.buckets_for(spark, more, 8 << 20), level)
        scratch.drop(f"folded{level}")
        done.append(cur.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, facts


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, row, keep_id, group_size, kept, text_sha256: one row for each row of docs; row is that of common.numbered(docs) where docs have it."""
    scratch = C.Scratch(docs.sparkSession, "exact")
    names, facts = identities(docs, scratch, block)
    rows = scratch.write(names.join(facts, "row"), "rows")
    scratch.keep_only("rows")
    best = F.min(F.struct((-F.col("cp")).alias("cp"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))).alias("best")
    groups = rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), best)
    # Most texts have no copy; only groups of two or more need the join.
    shared = groups.filter("group_size > 1").select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    joined = rows.join(scratch.write(shared, "shared"), ["level", "name"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", "row", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def digests(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
