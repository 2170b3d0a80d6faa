"""Operator 4: SimHash near-duplicates by BK-trees.

Fingerprints within `radius` bits differ in at most `radius` of k blocks of bits, so some k - radius blocks are
equal: each choice of m of those k = radius + m blocks is a shard key, and every linked pair meets in a shard. k grows with the
number of distinct fingerprints, so that shards stay small. In a shard a BK-tree (children keyed by integer Hamming distance
to the parent) is walked breadth first from each fingerprint, following only edges within the radius; what is found
leaves the tree, so a dense cluster costs about its size, not its square. A shard yields one edge for each fingerprint found,
to the smallest of its group; components of those edges are the result. No link is lost: shards aren't capped, and
those over `large` fingerprints are dealt out again by blocks of the other bits (same argument, same radius).

Trees of a shard travel to the shard's queries by key instead of by broadcast: together they hold every fingerprint,
which has no size bound.

Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows share a component.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Distinct fingerprints in a shard, expected, above which one more block is used.
CROWDED = 48


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    body, n = b" ".join(words), max(1, len(words) - shingle + 1)
    to = (ends[-n:] - 1).tolist()
    start = [0, *ends[: n - 1].tolist()]
    h = xxhash.xxh64_intdigest
    found = np.array([h(body[a:b], SEED) for a, b in zip(start, to)], np.uint64)
    ones = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, fp (signed 64-bit)."""

    def run(batches):
        for b in batches:
            yield {"doc_id": b.column(0), "row": b.column(2), "fp": np.array([fingerprint(t, shingle) for t in C.raw_texts(b)], np.uint64).view(np.int64)}

    return C.arrow_map(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row")), run, "doc_id long, row long, fp long")


def blocks(bits: int, k: int, shift: int = 0) -> list[tuple[int, int]]:
    """k blocks that cover `bits` bits: (first bit, width)."""
    edges = [shift + bits * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def shard_keys(fp: Column, radius: int, take: int) -> list[Column]:
    """Keys of which any two fingerprints within the radius share one. `take` of radius + take blocks are equal."""
    parts = blocks(64, radius + take)
    cut = lambda a, w: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1))
    return [F.xxhash64(F.lit(n), *(cut(*parts[i]) for i in chosen)) for n, chosen in enumerate(combinations(range(radius + take), take))]


def takes(n: int, radius: int) -> int:
    take = 1
    while take < 6 and n > CROWDED << (64 * take // (radius + take)):
        take += 1
    return take


class BkTree:
    """A BK-tree of distinct integers from which values can be taken out."""

    def __init__(self, values: list[int]):
        self.values, self.alive, self.below, self.parent = values, [True] * len(values), [1] * len(values), [-1] * len(values)
        self.children: list[dict[int, int]] = [{} for _ in values]
        children, below, parent = self.children, self.below, self.parent
        for i in range(1, len(values)):
            v, at = values[i], 0
            while True:
                below[at] += 1
                d = (values[at] ^ v).bit_count()
                if (to := children[at].get(d)) is None:
                    children[at][d], parent[i] = i, at
                    break
                at = to

    def remove(self, i: int) -> None:
        self.alive[i] = False
        while i >= 0:
            self.below[i] -= 1
            i = self.parent[i]

    def near(self, v: int, radius: int) -> list[int]:
        found, todo, below = [], [0] if self.below[0] else [], self.below
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ v).bit_count()
            if d <= radius and self.alive[at]:
                found.append(at)
            low, high = d - radius, d + radius
            todo += [c for e, c in self.children[at].items() if low <= e <= high and below[c]]
        return found

    def groups(self, radius: int) -> Iterator[list[int]]:
        """Groups of at least two values that chains of steps within the radius join."""
        for i in range(len(self.values)):
            if self.alive[i]:
                self.remove(i)
                group = [i]
                for at in group:  # grows meanwhile
                    for j in self.near(self.values[at], radius):
                        self.remove(j)
                        group.append(j)
                if len(group) > 1:
                    yield [self.values[j] for j in group]


def shard_edges(keyed: DataFrame, radius: int, parts: int) -> DataFrame:
    """key, a, b: edges (b the smallest of its group) within the shards of a table (key, fp)."""

    def run(batches):
        mask, key, held = 2**64 - 1, None, []

        def flush():
            keys, edges_a, edges_b = [], [], []
            if len(held) > 1:
                for group in BkTree([v & mask for v in dict.fromkeys(held)]).groups(radius):
                    signed = [v - (1 << 64) if v >> 63 else v for v in group]
                    root = min(signed)
                    edges_a += [v for v in signed if v != root]
                    edges_b += [root] * (len(signed) - 1)
                    keys += [key] * (len(signed) - 1)
            return keys, edges_a, edges_b

        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for k, fp in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key:
                    for x, y in zip(out, flush()):
                        x += y
                    key, held = k, []
                held.append(fp)
            yield dict(zip(("key", "a", "b"), out))
        yield dict(zip(("key", "a", "b"), flush()))

    return C.arrow_map(keyed.repartition(parts, "key").sortWithinPartitions("key", "fp"), run, "key long, a long, b long")


def link(fps: DataFrame, scratch: C.Scratch, radius: int = RADIUS, large: int = 20_000) -> DataFrame:
    """node, component over a written table of distinct fingerprints (column fp), for those that have a link."""
    take, spark = takes(fps.count(), radius), fps.sparkSession
    keyed = fps.select("fp", F.explode(F.array(*shard_keys(F.col("fp"), radius, take))).alias("key"))
    crowded = scratch.write(keyed.groupBy("key").count().filter(F.col("count") > large).select("key"), "crowded")
    if crowded.head(1):
        again = keyed.join(crowded, "key", "left_semi").select("fp", F.explode(F.array(*(F.xxhash64("key", k) for k in shard_keys(F.col("fp"), radius, take + 2)))).alias("key"))
        keyed = keyed.join(crowded, "key", "left_anti").unionByName(again)
    parts = C.buckets_for(spark, fps, 1 << 20)
    return C.connected_components(shard_edges(keyed.select("key", "fp"), radius, parts).select("a", "b"), scratch)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row, fp, component_id (the smallest doc_id of the component)."""
    scratch = C.Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, shingle), "rows")
    least = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    linked = link(least, scratch, radius)
    # Of each fingerprint: the component's smallest doc_id. Only linked fingerprints take part in the inner step.
    classes = least.join(linked, F.col("fp") == F.col("node"))
    roots = classes.groupBy("component").agg(F.min("first").alias("root"))
    named = classes.join(roots, "component").select("fp", "root")
    by_fp = scratch.write(least.join(named, "fp", "left").select("fp", F.coalesce("root", "first").alias("component_id")), "by_fp")
    return rows.join(by_fp, "fp").select("doc_id", "row", "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
