"""Operator 2: suffix-array dedup with sparse suffix arrays.

Texts are sequences of words. Of every stretch of `span` words (50) the position with the least hash of `gram` words,
the minimiser, is retained: equal stretches retain equal positions, so any passage of at least `span` words which occurs twice keeps a
suffix at the same place in both. Suffixes that share their first `gram` words with another are brought together, sorted by what follows,
and compared with their neighbours; runs of neighbours that agree to the right are then split by what stands to the left.
This gives, for each stretch around a suffix, all of its occurrences and the first one (by doc_id, row, position). Stretches with an
earlier occurrence are repeats; overlapping ones join into spans, so matches longer than `span` are extended left and right to their ends.

First pass: (key, row) of retained suffixes only, a few bytes each. Keys that occur once go. Second pass: context (50 words right, 38 left, as 32-bit word hashes) of the
others. Equal contexts are folded into one row with its first place before they are grouped, so exact copies in any number are one row a key.

Null and empty texts, and texts of fewer words than `span`, have no spans. Words are runs without [\\x20\\x09-\\x0D], compared by hash
(64 bits for the first `gram` words and 32 for each word beyond). Repetitions inside one document count too. Rows with equal doc_id are apart.
Rows are numbered in a written table once; every later step reads that table.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPAN, GRAM = 50, 12
ROW = C.ROW
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class Hasher:
    """Word hashes, and hashes of runs of words by differences of prefix sums modulo 2^64."""

    def __init__(self):
        self.memo = C.Memo(lambda words: [xxhash.xxh64_intdigest(w) for w in words], 1_000_000, 64 << 20)
        self.powers()

    def powers(self, n: int = 1 << 12) -> None:
        up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def words(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.split() for t in texts]
        known = self.memo.lookup(w for s in split for w in s)
        return [np.fromiter(map(known.__getitem__, s), np.uint64, len(s)) for s in split]

    def grams(self, h: np.ndarray, k: int) -> np.ndarray:
        while len(h) >= len(self.up):
            self.powers(2 * len(self.up))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.down[: len(h)], dtype=np.uint64)])
        return C.mix64((sums[k:] - sums[:-k]) * self.up[: len(sums) - k])


def retained(grams: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of minimisers, and the first and last stretch that each of them is the minimiser of."""
    width = span - gram + 1
    if len(grams) < width:
        none = np.empty(0, np.int64)
        return none, none, none
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.concatenate([first[1:], [len(at)]]) - 1


def suffixes(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """key, row: the retained suffixes of every text."""

    def run(batches):
        hasher = Hasher()
        for b in batches:
            keys, who = [], []
            for row, h in zip(b.column(1).to_pylist(), hasher.words(C.raw_texts(b))):
                if len(h) >= span:
                    g = hasher.grams(h, gram)
                    at = retained(g, span, gram)[0]
                    keys.append(g[at].view(np.int64))
                    who.append(np.full(len(at), row))
            yield {"key": np.concatenate(keys) if keys else [], "row": np.concatenate(who) if who else []}

    return C.arrow_map(rows.select("text", ROW), run, "key long, row long")


def contexts(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """Of suffixes whose key is in `keys`: key, cid (hash of the context), doc_id, row, pos, low and high (words of a stretch that may stand
    to the left), context (right words, then left words nearest first, big-endian so that bytes sort like words)."""
    back = span - gram

    def run(batches):
        hasher = Hasher()
        for b in batches:
            out: dict = {k: [] for k in ("key", "cid", "doc_id", "row", "pos", "low", "high", "context")}
            for doc, row, keys, h in zip(b.column("doc_id").to_pylist(), b.column(ROW).to_pylist(), b.column("keys").to_pylist(), hasher.words(C.raw_texts(b))):
                g = hasher.grams(h, gram)
                at, first, last = retained(g, span, gram)
                mine = np.isin(g[at].view(np.int64), np.array(keys, np.int64))
                at, first, last = at[mine], first[mine], last[mine]
                padded = np.concatenate([np.zeros(back, np.uint32), (h >> np.uint64(32)).astype(np.uint32), np.zeros(span, np.uint32)])
                wide = np.concatenate([at[:, None] + back + np.arange(span), at[:, None] + back - 1 - np.arange(back)], axis=1)
                # Words beyond those that a stretch of this suffix can reach don't count as context.
                low, high = at - last, at - first
                used = np.concatenate([np.arange(span) < span - low[:, None], np.arange(back) < high[:, None]], axis=1)
                ctx = np.where(used, padded[wide], 0).astype(">u4")
                raw = [x.tobytes() for x in ctx]
                for k, v in zip(out, (g[at].view(np.int64).tolist(), [xxhash.xxh64_intdigest(x + bytes([lo, hi])) - (1 << 63) for x, lo, hi in zip(raw, low.tolist(), high.tolist())], [doc] * len(at), [row] * len(at), at.tolist(), low.tolist(), high.tolist(), raw)):
                    out[k] += v
            yield out

    return C.arrow_map(rows, run, "key long, cid long, doc_id long, row long, pos int, low int, high int, context binary")


def equal_stretches(ctx: np.ndarray, low: np.ndarray, high: np.ndarray, span: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Over the suffixes of one key, sorted by right words: for each number o of words to the left, (o, members, class of each)."""
    right, left = ctx[:, :span], ctx[:, span:]
    same = np.ones((len(ctx) - 1, span), bool) if len(ctx) < 2 else right[1:] == right[:-1]
    agree = np.where(same.all(axis=1), span, (~same).argmax(axis=1)) if len(ctx) > 1 else np.empty(0, np.int64)
    weights = np.cumprod(np.full(max(1, left.shape[1]), BASE, np.uint64), dtype=np.uint64)
    prefix = np.concatenate([np.zeros((len(ctx), 1), np.uint64), np.cumsum(left.astype(np.uint64) * weights[: left.shape[1]], axis=1, dtype=np.uint64)], axis=1)
    out = []
    for o in range(int(low.min()), int(high.max()) + 1):
        run = np.concatenate([[0], np.cumsum(agree < span - o)]).astype(np.uint64)
        members = np.flatnonzero((low <= o) & (o <= high))
        out.append((o, members, C.mix64(prefix[members, o]) ^ C.mix64(run[members] + np.uint64(1))))
    return out


def runs_of_key(group: list[dict], span: int) -> list[tuple]:
    """(cid, from, to, first_row, first_pos): numbers of words to the left for which a stretch occurs more than once, and its first place."""
    low, high = (np.array([r[k] for r in group]) for k in ("low", "high"))
    if len(group) == 1:
        r = group[0]
        return [(r["cid"], r["low"], r["high"], r["first_row"], r["first_pos"])] if r["n"] > 1 else []
    ctx = np.frombuffer(b"".join(r["context"] for r in group), ">u4").reshape(len(group), -1).astype(np.uint32)
    n = np.array([r["n"] for r in group])
    order = sorted(range(len(group)), key=lambda i: (group[i]["first_doc"] is None, group[i]["first_doc"], group[i]["first_row"], group[i]["first_pos"]))
    place = np.empty(len(group), np.int64)
    place[order] = np.arange(len(group))
    found: dict[int, list] = {}
    for o, members, classes in equal_stretches(ctx, low, high, span):
        _, inverse = np.unique(classes, return_inverse=True)
        total = np.bincount(inverse, n[members])
        first = np.full(len(total), len(group))
        np.minimum.at(first, inverse, place[members])
        for i, f in zip(members[total[inverse] > 1].tolist(), first[inverse][total[inverse] > 1].tolist()):
            runs = found.setdefault(i, [])
            if runs and runs[-1][1] == o - 1 and runs[-1][2] == f:
                runs[-1][1] = o
            else:
                runs.append([o, o, f])
    return [(group[i]["cid"], a, b, group[order[f]]["first_row"], group[order[f]]["first_pos"]) for i, runs in found.items() for a, b, f in runs]


def repeated_runs(folded: DataFrame, span: int, parts: int) -> DataFrame:
    def run(batches):
        names = ("key", "cid", "low_o", "high_o", "first_row", "first_pos")
        out: list[tuple] = []
        rows = (r for b in batches for r in b.to_pylist())
        for key, group in groupby(rows, key=lambda r: r["key"]):
            out += [(key, *x) for x in runs_of_key(list(group), span)]
            if len(out) > 10_000:
                yield dict(zip(names, zip(*out)))
                out = []
        yield dict(zip(names, zip(*out))) if out else {k: [] for k in names}

    return C.arrow_map(folded.repartition(parts, "key").sortWithinPartitions("key", "context", "first_doc", "first_row", "first_pos"), run, "key long, cid long, low_o int, high_o int, first_row long, first_pos int")


def merge_spans(pieces: DataFrame, parts: int) -> DataFrame:
    """Joins overlapping or adjacent spans of a row, repeats and first occurrences apart."""

    def run(batches):
        names, cur, out = ("doc_id", "row", "start_word", "end_word", "is_first"), None, []
        for b in batches:
            for row, first, start, end, doc in zip(*(b.column(c).to_pylist() for c in ("row", "is_first", "start_word", "end_word", "doc_id"))):
                if cur and cur[:2] == [row, first] and start <= cur[3]:
                    cur[3] = max(cur[3], end)
                    continue
                if cur:
                    out.append((cur[4], cur[0], cur[2], cur[3], cur[1]))
                cur = [row, first, start, end, doc]
            yield dict(zip(names, zip(*out))) if out else {k: [] for k in names}
            out = []
        if cur:
            yield {"doc_id": [cur[4]], "row": [cur[0]], "start_word": [cur[2]], "end_word": [cur[3]], "is_first": [cur[1]]}

    return C.arrow_map(pieces.repartition(parts, "row").sortWithinPartitions("row", "is_first", "start_word", "end_word"), run, "doc_id long, row long, start_word int, end_word int, is_first boolean")


def repeated_spans(rows: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, row, start_word, end_word, is_first over common.numbered(docs): maximal spans of repeated stretches. is_first spans hold the
    first occurrences, which stay; the others occurred before."""
    spark = rows.sparkSession
    scratch = C.Scratch(spark, "suffix")
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", ROW)
    parts = C.buckets_for(spark, texts)
    kept = scratch.write(suffixes(texts, span, gram), "suffixes")
    shared = scratch.write(kept.groupBy("key").count().filter("count > 1").select("key"), "shared")
    # Written before it is grouped by row, so that the join can split the rows of a hot key.
    hits = scratch.write(kept.join(shared, "key", "left_semi"), "hits")
    scratch.drop("suffixes", "shared")
    wanted = scratch.write(hits.groupBy("row").agg(F.collect_set("key").alias("keys")), "wanted")  # a document's own keys
    scratch.drop("hits")
    met = scratch.write(contexts(texts.join(wanted.withColumnRenamed("row", ROW), ROW), span, gram), "contexts")
    scratch.drop("wanted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "pos")).alias("f")
    folded = met.groupBy("key", "cid").agg(first, F.count("*").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("context").alias("context"))
    folded = folded.select("key", "cid", "n", "low", "high", "context", F.col("f.doc_id").alias("first_doc"), F.col("f.row").alias("first_row"), F.col("f.pos").alias("first_pos"))
    found = scratch.write(repeated_runs(folded, span, parts), "runs")
    places = met.select("key", "cid", "doc_id", "row", "pos").join(found, ["key", "cid"])
    pieces = places.select(
        "doc_id", "row", (F.col("pos") - F.col("high_o")).alias("start_word"), (F.col("pos") - F.col("low_o") + span).alias("end_word"),
        ((F.col("row") == F.col("first_row")) & (F.col("pos") == F.col("first_pos"))).alias("is_first"),
    )
    return merge_spans(pieces, parts)


_WORD = re.compile("[^\x20\x09-\x0d]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (and the white space after each)."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : max(at, starts[a])])
        at = max(at, starts[b])
    return "".join(out) + text[at:]


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """docs with the same columns and rows; words of repeated spans are cut out of `text`, first occurrences stay, and
    n_chars, where there is one, counts the new text's code points."""
    rows = C.numbered(docs, C.Scratch(docs.sparkSession, "rows"))
    spans = repeated_spans(rows, span, gram).filter("not is_first").groupBy("row").agg(F.collect_list(F.struct("start_word", "end_word")).alias("__foliant_spans"))
    spans = spans.withColumnRenamed("row", ROW)

    @F.pandas_udf("string")
    def shorter(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if f is None or t is None else cut(t, [(x["start_word"], x["end_word"]) for x in f]) for t, f in zip(text, found)])

    joined = rows.join(spans, ROW, "left")
    out = joined.withColumn("text", F.when(F.col("__foliant_spans").isNull(), F.col("text")).otherwise(shorter("text", "__foliant_spans")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__foliant_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)


def spans_query(docs: DataFrame) -> DataFrame:
    found = repeated_spans(C.numbered(docs.select("doc_id", "text"), C.Scratch(docs.sparkSession, "rows")))
    return found.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"), F.col("is_first").alias("kept"))
