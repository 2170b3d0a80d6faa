"""Operator 4 at a Jaccard similarity of five-word shingle sets, for the pipeline.

Sets that are 0.8 alike have SimHash fingerprints some 10 bits apart, up to RADIUS: too far for blocks of equal bits, of which
a shard's key would hold few. Shards are therefore the documents that share one of BANDS keys, each of WIDTH minima of hashed shingles: at a
similarity of 0.8 that is missed by 1 pair in 5,000. In each shard a BK-tree of the fingerprints follows only edges within the radius;
documents that it joins are candidates, unless their fingerprints or their sketches (one bit of each of 2048 minima) are too far apart, and every candidate is
verified on the whole sets. Within a shard's group, documents are first
compared with the group's least row; what this leaves in different components is compared in turn. Groups are components of rows, so that
doc_id may repeat or be null. A text of fewer words than a shingle is one shingle; null, empty and blank texts have none and are no one's copies.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .simhash import shard_edges
from .suffix_dedup import Hasher

SIMILAR, SHINGLE, SEED, RADIUS = 0.8, 5, 42, 16
BANDS, WIDTH = 16, 4
_DRAW = np.random.default_rng(SEED)
#: Bits of a document's sketch, in longs, and how many may differ: at a similarity of 0.8 they are 205 of 2048 on average, over 262 for 1 pair in
#: 48,000. Copies of one original that are less alike than 0.74 hardly pass, so that a large group of them doesn't make all of its pairs.
LONGS, DIFFER = 32, 262
FACTORS, ADDED = (_DRAW.integers(0, 2**64, BANDS * WIDTH, np.uint64) | np.uint64(1) for _ in range(2))
MORE_FACTORS, MORE_ADDED = (_DRAW.integers(0, 2**64, 64 * LONGS, np.uint64) | np.uint64(1) for _ in range(2))
ROW = C.ROW
class Shingles:
    """Sets of hashed shingles: sums of word hashes by place in the shingle, mixed."""

    def __init__(self, shingle: int = SHINGLE):
        self.hasher, self.shingle = Hasher(), shingle

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of a text's distinct shingles, sorted."""
        h = self.hasher.words([text.lower()])[0]
        return np.unique(self.hasher.grams(h, min(self.shingle, len(h)))) if len(h) else h


def bands(found: np.ndarray) -> list[int]:
    # The hashes are mixed already, so that odd factors alone give other orders.
    least = np.array([(found * f + a).min() for f, a in zip(FACTORS, ADDED)], np.uint64).reshape(BANDS, WIDTH)
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - 2**63 for k, x in enumerate(least)]


def fingerprint(found: np.ndarray) -> int:
    """A signed 64-bit SimHash of distinct shingles: a bit is 1 if set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(found), 8192):
        votes += np.unpackbits(np.ascontiguousarray(found[k : k + 8192]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(found)).view("<i8")[0])


def sketch(found: np.ndarray) -> np.ndarray:
    """LONGS longs of one bit of each of 64 * LONGS minima: two sketches differ in half as many bits as the sets' dissimilarity is a share of them."""
    step = max(1, (1 << 19) // len(found))
    least = [(found[None] * MORE_FACTORS[k : k + step, None] + MORE_ADDED[k : k + step, None]).min(axis=1) for k in range(0, 64 * LONGS, step)]
    return np.packbits((C.mix64(np.concatenate(least)) & np.uint64(1)).astype(bool)).view("<i8")


def sketches(text: DataFrame, shingle: int) -> DataFrame:
    """row, s0, s1, ...: sketches of candidates' texts, none of which is blank."""

    def run(batches):
        sets = Shingles(shingle)
        for b in batches:
            made = np.array([sketch(sets.of(t)) for t in C.raw_texts(b)], np.int64).reshape(-1, LONGS)
            yield {"row": b.column(ROW)} | {f"s{i}": made[:, i] for i in range(LONGS)}

    return C.arrow_map(text.select(ROW, "text"), run, "row long, " + ", ".join(f"s{i} long" for i in range(LONGS)))


def keyed_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """row, size (of the set), fp, key: BANDS rows a document."""

    def run(batches):
        sets = Shingles(shingle)
        for b in batches:
            rows, sizes, fps, keys = [], [], [], []
            for row, text in zip(b.column(0).to_pylist(), C.raw_texts(b)):
                if len(found := sets.of(text)):
                    rows += [row] * BANDS
                    sizes += [len(found)] * BANDS
                    fps += [fingerprint(found)] * BANDS
                    keys += bands(found)
            yield {"row": rows, "size": sizes, "fp": fps, "key": keys}

    return C.arrow_map(docs.select(F.col(ROW).alias("row"), "text"), run, "row long, size long, fp long, key long")


def verify(pairs: DataFrame, text: DataFrame, similar: float, shingle: int, scratch: C.Scratch, name: str) -> DataFrame:
    """Of pairs (a, b) of rows, those whose sets are at least so similar, written."""
    some = pairs.select("a", "b").distinct()

    def run(batches):
        known, last, sets = None, None, Shingles(shingle)
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), C.raw_texts(batch, "s"), C.raw_texts(batch, "t")):
                if x != last:
                    known, last = sets.of(s), x
                other = sets.of(t)
                both = len(np.intersect1d(known, other, assume_unique=True))
                if both >= similar * (len(known) + len(other) - both) - 1e-9:
                    a.append(x)
                    b.append(y)
            yield {"a": a, "b": b}

    met = some.join(text.select(F.col(ROW).alias("a"), F.col("text").alias("s")), "a").join(text.select(F.col(ROW).alias("b"), F.col("text").alias("t")), "b")
    return scratch.write(C.arrow_map(met.select("a", "b", "s", "t"), run, "a long, b long"), name)


def grouped(shards: DataFrame, scratch: C.Scratch) -> DataFrame:
    """key, row, size, fp, least, least_size, least_fp: rows of shards (key, row, size, fp) whose shard holds another one within the radius, by steps; key names shard and group.
    least is the row of the group that has most company in all its groups: copies of one original have more in common with it than with
    each other, so comparing all with it joins most of them at once."""
    prints = shards.select("key", "fp").distinct()
    edges = scratch.write(shard_edges(prints, RADIUS, C.buckets_for(prints.sparkSession, shards, 1 << 20)), "edges")
    named = shards.join(edges.withColumnsRenamed({"a": "fp", "b": "root"}), ["key", "fp"], "left").select(F.xxhash64("key", F.coalesce("root", "fp")).alias("key"), "row", "size", "fp")
    groups = named.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = scratch.write(named.join(groups, "key"), "company")
    met = met.join(met.groupBy("row").agg(F.sum("n").alias("company")), "row")
    best = met.groupBy("key").agg(F.max(F.struct("company", (-F.col("row")).alias("row"), "size", "fp")).alias("x"))
    return met.select("key", "row", "size", "fp").join(best.select("key", (-F.col("x.row")).alias("least"), F.col("x.size").alias("least_size"), F.col("x.fp").alias("least_fp")), "key")


def within(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def alike(a: str, b: str) -> Column:
    """Sketches s0a, s0b, ... near enough for sets that may be similar."""
    return sum((F.bit_count(F.col(f"s{i}{a}").bitwiseXOR(F.col(f"s{i}{b}"))) for i in range(LONGS)), F.lit(0)) <= DIFFER


def near_copies(docs: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """row, keep_row: rows of common.numbered(docs) in a group of near-duplicates, and the first (doc_id, row) of the group."""
    scratch = C.Scratch(docs.sparkSession, "near")
    docs = C.numbered(docs.select("doc_id", "text", *(c for c in [ROW] if c in docs.columns)), scratch)
    keyed = scratch.write(keyed_rows(docs, shingle), "keyed")
    shards = scratch.write(keyed.join(keyed.groupBy("key").count().filter("count > 1").select("key"), "key"), "shards")
    met = scratch.write(grouped(shards, scratch), "met")
    fits = lambda a, b: F.least(a, b) >= F.greatest(a, b) * similar - 1e-9
    text = scratch.write(docs.select(ROW, "text").join(met.select(F.col("row").alias(ROW)).distinct(), ROW, "left_semi"), "texts")
    scratch.drop("keyed", "shards", "edges", "company")
    drawn = scratch.write(sketches(text, shingle), "sketches")
    named = lambda side: drawn.withColumnsRenamed({f"s{i}": f"s{i}{side}" for i in range(LONGS)} | {"row": f"__{side}"})
    first = met.join(named("a"), F.col("row") == F.col("__a")).join(named("b"), (F.col("least") == F.col("__b")) & alike("a", "b")).filter((F.col("row") != F.col("least")) & fits("size", "least_size") & within("fp", "least_fp")).select(F.least("least", "row").alias("a"), F.greatest("least", "row").alias("b"))
    links = verify(first, text, similar, shingle, scratch, "links")
    groups = C.connected_components(links, scratch, "first")
    # At most BANDS keys a row: a pair is made at the first key that both have, and not again at the others.
    keys = met.groupBy("row").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    labelled = scratch.write(met.join(groups, F.col("row") == F.col("node"), "left").join(drawn, "row").join(keys, "row").select("key", "row", "size", "fp", "keys", F.coalesce("component", "row").alias("c"), *(f"s{i}" for i in range(LONGS))), "labelled")
    left, right = (labelled.select("key", *(F.col(x).alias(f"{x}{side}") for x in ("row", "size", "fp", "c", "keys", *(f"s{i}" for i in range(LONGS))))) for side in "ab")
    rest = left.join(right, (left.key == right.key) & (F.col("rowa") < F.col("rowb")) & (F.col("ca") != F.col("cb")) & fits("sizea", "sizeb") & within("fpa", "fpb") & alike("a", "b") & (F.array_min(F.array_intersect("keysa", "keysb")) == left.key))
    # Pairs with the key's least row have been compared already.
    rest = rest.select(F.col("rowa").alias("a"), F.col("rowb").alias("b")).distinct().join(first.distinct(), ["a", "b"], "left_anti")
    more = verify(rest, text, similar, shingle, scratch, "more")
    found = scratch.write(C.connected_components(links.unionByName(more), scratch, "last"), "groups")
    members = scratch.write(docs.select("doc_id", F.col(ROW).alias("row")).join(found, F.col("row") == F.col("node")).select("doc_id", "row", "component"), "members")
    scratch.keep_only("members")
    return members.join(members.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("f")), "component").select("row", F.col("f.row").alias("keep_row"))
