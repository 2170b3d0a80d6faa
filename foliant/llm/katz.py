"""Operator 3: LM scoring by a Katz backoff bigram model.

Counts are Good-Turing discounted up to DISCOUNTED; each history's backoff weight is what its discounted counts leave,
divided by the unigram mass of the words it was not seen with, so that the probabilities of any history sum to one over
the V known types and one unknown type. A token's probability is evaluated recursively: bigram, else weight times unigram,
else weight times the unknown type's mass.

How it is distributed. A map task turns each Arrow batch of whole texts into one `seq` row and, for each bucket of the hash space, one message with
the batch's distinct words (or bigrams) and their training counts: counts are combined before they move, and a frequent
word is one entry a batch. A bucket adds up its messages, keeps its part of the model table, and answers each batch in the order it
asked. The first batch that asks for a bigram owns it, and sends its discounted count and unigram mass on to the history's bucket;
this gives exact backoff weights without gathering a history's successors anywhere. All steps are written tables,
partitioned by kind and keyed by bucket; nothing of the model is broadcast but its discounts (a dozen numbers).

Words are known by 64-bit hashes (of words, and of word pairs). Null and empty texts are the end token alone. A
null doc_id counts as the empty text, which is held out (its crc32 is 0). Without training tokens every token has probability 1.
Repeated rows are learned and scored as often as they come.
"""

from __future__ import annotations

import json
import zlib
from itertools import groupby

import numpy as np
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DISCOUNTED, FOLDS = 5, 10
END, BEGIN = 0, 1  # local numbers of a batch; hashes of theirs no word has but by chance
MARKS = np.array([xxhash.xxh64_intdigest(b"\n end"), xxhash.xxh64_intdigest(b"\n begin")], np.uint64)
ROW = "kind string, batch long, bucket int, a binary, b binary"
#: Beside local word numbers in the code of a bigram.
WIDE = np.uint64(1 << 32)


def squeeze(x: np.ndarray) -> bytes:
    """zstd of an array's bytes, plane by plane."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1) if len(x) else b""


def expand(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).reshape(-1).view(kind) if b else np.empty(0, kind)


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, "<u8"), dtype=np.uint64)


def cuts(keys: np.ndarray, buckets: int) -> list[int]:
    """Where each bucket of sorted hashes begins and ends: equal ranges of the upper 32 bits."""
    edges = [(i << 32) // buckets << 32 for i in range(1, buckets)]
    return [0, *np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]


class Batch:
    """A batch's tokens by local word numbers, and the order in which its words and bigrams are asked for."""

    def __init__(self, docs: list, sizes: np.ndarray, tokens: np.ndarray, words: np.ndarray):
        self.docs, self.sizes, self.tokens, self.words = docs, sizes, tokens, words
        self.ends = np.cumsum(sizes)
        self.held = np.array([zlib.crc32(str("" if d is None else d).encode()) % FOLDS == 0 for d in docs], bool)
        self.word_order = np.argsort(words, kind="stable")

    @classmethod
    def of_texts(cls, docs: list, texts: list[bytes]) -> Batch:
        local: dict = {}
        parts = []
        for t in texts:
            parts.append(np.array([local.setdefault(w, len(local) + 2) for w in t.lower().split()] + [END], np.uint32))
        words = np.concatenate([MARKS, np.fromiter((xxhash.xxh64_intdigest(w) for w in local), np.uint64, len(local))])
        return cls(docs, np.array([len(p) for p in parts], np.int64), np.concatenate(parts) if parts else np.empty(0, np.uint32), words)

    def pack(self) -> tuple[bytes, bytes]:
        sizes = squeeze(self.sizes)
        return squeeze(self.tokens), json.dumps([self.docs, len(sizes)]).encode() + b"\n" + sizes + self.words.astype("<u8").tobytes()

    @classmethod
    def unpack(cls, a: bytes, b: bytes) -> Batch:
        head, _, rest = b.partition(b"\n")
        docs, n = json.loads(head)
        return cls(docs, expand(rest[:n], "<i8"), expand(a, "<u4"), np.frombuffer(rest[n:], "<u8"))

    def pairs(self) -> None:
        before = np.roll(self.tokens, 1)
        before[np.concatenate([[0], self.ends[:-1]]).astype(np.int64)] = BEGIN
        self.before = before
        codes, self.of_token = np.unique(before.astype(np.uint64) * WIDE + self.tokens, return_inverse=True)
        self.left, self.right = (codes // WIDE).astype(np.int64), (codes % WIDE).astype(np.int64)
        keys = C.mix64(self.words[self.left] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.right])
        self.pair_order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_order]

    def train_tokens(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)


def messages(kind: str, batch: int, keys: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple]:
    at = cuts(keys, buckets)
    return [(kind, batch, i, squeeze_sorted(keys[a:b]), squeeze(values[a:b])) for i, (a, b) in enumerate(zip(at, at[1:])) if b > a]


def columns(rows: list[tuple]) -> dict:
    return dict(zip(("kind", "batch", "bucket", "a", "b"), map(list, zip(*rows)))) if rows else {k: [] for k in ("kind", "batch", "bucket", "a", "b")}


def ask(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of kinds seq, word, pair."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            own = Batch.of_texts(b.column(0).to_pylist(), C.raw_texts(b))
            batch, n = part << 32 | n, n + 1
            own.pairs()
            train = own.train_tokens()
            counts = np.bincount(own.tokens[train], minlength=len(own.words)).astype("<u4")
            counts[BEGIN] = (~own.held).sum()
            pair_counts = np.bincount(own.of_token[train], minlength=len(own.left)).astype("<u4")
            rows = [("seq", batch, 0, *own.pack())]
            rows += messages("word", batch, own.words[own.word_order], counts[own.word_order], buckets)
            rows += messages("pair", batch, own.pair_keys, pair_counts[own.pair_order], buckets)
            yield columns(rows)

    return C.arrow_map(docs.select(docs.doc_id.cast("long").alias("doc_id"), "text"), run, ROW, batch_mb=16)


def grouped(batches, key: str):
    """(key, rows of that key) from rows sorted by key; a group is one bucket or one batch, both of bounded size."""
    rows = ((r[key], r) for b in batches for r in b.to_pylist())
    return groupby(rows, key=lambda x: x[0])


def answer(asked: DataFrame, kind: str, parts: int) -> DataFrame:
    """Rows of kinds `kind`_counts (counts in the order asked; which of them the batch owns) and `kind`_facts."""

    def run(batches):
        for bucket, group in grouped(batches, "bucket"):
            got = [r for _, r in group]
            keys = [expand_sorted(r["a"]) for r in got]
            known, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            total = np.bincount(inverse, np.concatenate([expand(r["b"], "<u4") for r in got]), len(known)).astype("<u4")
            owner = np.zeros(len(inverse), bool)
            owner[first[total > 0]] = True
            rows, at = [], 0
            for r, k in zip(got, keys):
                rows.append((f"{kind}_counts", r["batch"], bucket, squeeze(total[inverse[at : at + len(k)]]), np.packbits(owner[at : at + len(k)]).tobytes()))
                at += len(k)
            real = total[~np.isin(known, MARKS[1:])] if kind == "word" else total
            facts = {"types": int((real > 0).sum()), "tokens": int(real.sum(dtype=np.int64)), "of": np.bincount(np.minimum(real, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2].tolist()}
            rows.append((f"{kind}_facts", -1, bucket, json.dumps(facts).encode(), b""))
            yield columns(rows)

    own = asked.filter(F.col("kind") == kind).select("batch", "bucket", "a", "b")
    return C.arrow_map(own.repartition(parts, "bucket").sortWithinPartitions("bucket", "batch"), run, ROW, batch_mb=16)


def gather_facts(answers: DataFrame, kind: str) -> dict:
    """Sums of a few numbers a bucket, added up by Spark."""
    shape = "types long, tokens long, of array<long>"
    x = F.from_json(F.col("a").cast("string"), shape)
    row = answers.filter(F.col("kind") == f"{kind}_facts").select(x.alias("x")).agg(F.sum("x.types").alias("types"), F.sum("x.tokens").alias("tokens"), *(F.sum(F.col("x.of")[r]).alias(f"n{r}") for r in range(DISCOUNTED + 2))).first()
    return {"types": row["types"] or 0, "tokens": row["tokens"] or 0, "of": [row[f"n{r}"] or 0 for r in range(DISCOUNTED + 2)]}


def smoothed(of: list[int]) -> np.ndarray | None:
    """Counts of counts by Gale's fit of log Z_r on log r, None where it doesn't fall faster than 1 / r, as it must for discounts."""
    met = [r for r in range(1, DISCOUNTED + 2) if of[r] > 0]
    if len(met) < 2:
        return None
    before, after = [0, *met[:-1]], [*met[1:], 2 * met[-1] - met[-2]]
    z = [2 * of[r] / (t - q) for q, r, t in zip(before, met, after)]
    slope, level = np.polyfit(np.log(met), np.log(z), 1)
    return np.exp(level + slope * np.log(np.arange(1, DISCOUNTED + 2))) if slope < -1 else None


def katz_formula(n: list) -> np.ndarray:
    """d_1 to d_k from n_1 to n_k+1."""
    k = DISCOUNTED
    top = (k + 1) * n[k] / n[0]
    return np.array([((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top) for r in range(1, k + 1)])


def discounts(of: list[int]) -> np.ndarray:
    """Katz's d_r for r up to DISCOUNTED from counts of counts, 1 above. Where the counts as they are give a number outside (0, 1),
    as groups of copies make them do, the counts of counts are smoothed first; only where these don't fall at all like
    counts of counts, which tiny samples do, half a count is taken off instead."""
    k = DISCOUNTED
    d = np.ones(k + 2)
    fits = lambda x: bool(((x > 0) & (x < 1)).all())
    try:
        d[1 : k + 1] = katz_formula(of[1:])
    except ZeroDivisionError:
        d[1] = 0
    if not fits(d[1 : k + 1]):
        n = smoothed(of)
        d[1 : k + 1] = [(r - 0.5) / r for r in range(1, k + 1)] if n is None else katz_formula(n)
    return d


class Model:
    """The few global numbers: discounts of words and of pairs, N, V and the unknown type's mass."""

    def __init__(self, words: dict, pairs: dict):
        self.n, self.v = words["tokens"], words["types"]
        self.word_d, self.pair_d = discounts(words["of"]), discounts(pairs["of"])
        self.rest = sum((1 - self.word_d[r]) * r * words["of"][r] for r in range(1, DISCOUNTED + 1))
        self.total = self.n if self.rest else self.n + 1
        self.rest = self.rest or 1.0

    def unigram(self, c: np.ndarray) -> np.ndarray:
        seen = self.word_d[np.minimum(c, DISCOUNTED + 1)] * c
        return np.where(c > 0, seen, self.rest) / self.total

    def seen(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts of pairs."""
        return self.pair_d[np.minimum(c, DISCOUNTED + 1)] * c

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))


def with_answers(rows: list[dict]) -> tuple[Batch, dict[str, np.ndarray]]:
    """A batch and its answers in local order, from its rows sorted by kind and bucket."""
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["kind"], []).append(r)
    own = Batch.unpack(by["seq"][0]["a"], by["seq"][0]["b"])
    own.pairs()
    join = lambda kind, t: np.concatenate([expand(r["a"], t) for r in by[kind]])
    got = {"words": np.empty(len(own.words), np.int64), "pairs": np.empty(len(own.left), np.int64), "owned": np.empty(len(own.left), bool)}
    got["words"][own.word_order], got["pairs"][own.pair_order] = join("word_counts", "<u4"), join("pair_counts", "<u4")
    got["owned"][own.pair_order] = np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8), count=len(expand(r["a"], "<u4"))) for r in by["pair_counts"]]).astype(bool)
    if "weight" in by:
        got["weights"] = np.empty(len(own.words))
        got["weights"][own.word_order] = join("weight", "<f8")
    return own, got


def history_sums(rows: DataFrame, model: Model, buckets: int, parts: int) -> DataFrame:
    """Rows of kind sums: for histories of owned bigrams, discounted counts and the unigram mass of what followed."""

    def run(batches):
        for batch, group in grouped(batches, "batch"):
            own, got = with_answers([r for _, r in group])
            mine = got["owned"] & (got["pairs"] > 0)
            left, n = own.left[mine], len(own.words)
            seen = np.bincount(left, model.seen(got["pairs"][mine]), n)
            mass = np.bincount(left, model.unigram(got["words"][own.right[mine]]), n)
            order = own.word_order[seen[own.word_order] > 0]
            yield columns(messages("sums", batch, own.words[order], np.stack([seen[order], mass[order]], axis=1).ravel().view("<c16"), buckets))

    return C.arrow_map(rows.repartition(parts, "batch").sortWithinPartitions("batch", "kind", "bucket"), run, ROW, batch_mb=16)


def weights(asked: DataFrame, sums: DataFrame, parts: int) -> DataFrame:
    """Rows of kind weight: each history's backoff weight, in the order asked. A history whose counts leave nothing gets one more
    in its denominator; a negative weight says so."""

    def run(batches):
        for bucket, group in grouped(batches, "bucket"):
            rows = [r for _, r in group]
            words, added = [r for r in rows if r["kind"] == "word"], [r for r in rows if r["kind"] == "sums"]
            keys = [expand_sorted(r["a"]) for r in words]
            known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(inverse, np.concatenate([expand(r["b"], "<u4") for r in words]), len(known))
            seen, mass = np.zeros(len(known)), np.zeros(len(known))
            for r in added:
                at, x = np.searchsorted(known, expand_sorted(r["a"])), expand(r["b"], "<c16")
                np.add.at(seen, at, x.real)
                np.add.at(mass, at, x.imag)
            left = count - seen
            bare = (count > 0) & (left <= 1e-9 * count)
            share = np.where(bare, 1 / (count + 1), left / np.maximum(count, 1))
            alpha = np.where(seen > 0, share / np.maximum(1 - mass, 1e-300), 1.0)
            alpha = np.where(bare, -alpha, alpha)
            at, out = 0, []
            for r, k in zip(words, keys):
                out.append(("weight", r["batch"], bucket, squeeze(alpha[inverse[at : at + len(k)]]), b""))
                at += len(k)
            yield columns(out)

    both = asked.filter("kind = 'word'").unionByName(sums)
    return C.arrow_map(both.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "batch"), run, ROW, batch_mb=16)


def scores(rows: DataFrame, model: Model, parts: int) -> DataFrame:
    def run(batches):
        for _, group in grouped(batches, "batch"):
            own, got = with_answers([r for _, r in group])
            c, p, w = got["words"], got["pairs"], got["weights"]
            unigram, hist = model.unigram(c), c[own.left]
            weight = w[own.left]
            prob = np.where(p > 0, model.seen(p) / np.maximum(hist + (weight < 0), 1), np.abs(weight) * unigram[own.right])
            starts = (own.ends - own.sizes).astype(np.int64)
            add = lambda x: np.add.reduceat(x, starts)
            tok = own.tokens
            yield {
                "doc_id": own.docs, "held_out": own.held, "n_tokens": own.sizes, "n_known": add((c > 0)[tok].astype(np.int64)), "train_tokens": np.full(len(own.docs), model.n, np.int64),
                "base_score": add(model.base(c)[tok]), "score": add(np.log10(prob)[own.of_token]),
            }

    return C.arrow_map(rows.repartition(parts, "batch").sortWithinPartitions("batch", "kind", "bucket"), run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", batch_mb=16)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "katz")
    buckets = C.buckets_for(spark, docs)
    asked = scratch.write(ask(docs, buckets), "asked", ["kind"])
    word_answers = scratch.write(answer(asked, "word", buckets), "words", ["kind"])
    pair_answers = scratch.write(answer(asked, "pair", buckets), "pairs", ["kind"])
    scratch.drop("asked/kind=pair")  # answered; no later step reads these messages
    model = Model(gather_facts(word_answers, "word"), gather_facts(pair_answers, "pair"))
    answered = asked.filter("kind = 'seq'").unionByName(word_answers.filter("kind = 'word_counts'")).unionByName(pair_answers.filter("kind = 'pair_counts'"))
    sums = scratch.write(history_sums(answered, model, buckets, buckets), "sums")
    weighed = scratch.write(weights(asked, sums, buckets), "weights")
    scratch.drop("sums", "asked/kind=word")
    return scores(answered.unionByName(weighed), model, buckets)
