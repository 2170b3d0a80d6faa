"""Operator 8: packing token sequences by shortest-pack-first over the length histogram.

A document's ids (and one end id) are cut at multiples of the sequence length; full pieces are sequences of their
own, the rests are packed. Only the histogram of rest lengths (at most `size` entries, whatever the corpus) comes to
the driver. Lengths are placed longest first; each time the open pattern with the least filled room that still
takes the length (the shortest pack) gets it, and counts of patterns are updated rather than single packs. Patterns
come back to the pieces by rank within a length; ranks are counted over salted groups, so a length that a third of
all documents share is not ranked in one task.

Null and empty texts are one piece that holds the end id. Nothing is dropped; repeated rows are packed as often as
they come; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .merges import PairTable

SIZE, END = 2048, 1
#: Pieces of one length that a task ranks, about.
RANKED = 200_000


class WordTokenizer:
    """Ids of a `tokenizers` file of byte-level merges with word ends, as the library gives them.

    Texts of common Latin characters are normalised here (NFC, lower case), split by the file's own pattern and
    merged many words at once (merges.py), with a memo. A text with any other character goes through the library whole.
    """

    #: No character here is special to the normalizer beyond NFC and lower case.
    PLAIN = regex.compile("[\t\n\r\x20-\x7e\xa0-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.table = PairTable(((vocab[a], vocab[b], i) for i, (a, b) in enumerate(pairs)), np.array([vocab[a + b] for a, b in pairs]), max(vocab.values()) + 1)
        names = byte_names()
        self.inner, self.final = (np.array([vocab[n + s] for n in names], np.int32) for s in ("", suffix))
        self.memo = C.Memo(self.words, 1_000_000, 64 << 20)

    def words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        body = np.frombuffer(b"".join(raw), np.uint8)
        symbols, last = self.inner[body], np.cumsum(size) - 1
        symbols[last] = self.final[body[last]]
        return self.table.merge((symbols, size))

    def ids_of_many(self, texts: list[str]) -> list[bytes]:
        """Unsigned 32-bit little-endian ids of whole texts."""
        plain = [bool(self.PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        split = [self.pattern.findall(unicodedata.normalize("NFC", t).lower()) if p else [] for t, p in zip(texts, plain)]
        known = self.memo.lookup(w for s in split for w in s)
        return [b"".join([known[w] for w in s]) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, p, s in zip(texts, plain, split)]


def byte_names() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte: itself, or 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache(2)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers as P

    return P.path(name)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, row (of docs), start, length, ids_crc32, doc_tokens: every document cut at multiples of size."""

    def run(batches):
        tok, tail = load(path), np.array([end], "<u4").tobytes()
        for b in batches:
            out: dict = {k: [] for k in ("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens")}
            for doc, row, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), tok.ids_of_many(C.texts(b))):
                ids = memoryview(body + tail)
                for at in range(0, len(ids), 4 * size):
                    part = ids[at : at + 4 * size]
                    for k, v in zip(out, (doc, row, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)):
                        out[k].append(v)
            yield out

    return C.arrow_map(docs.select(docs.doc_id.cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row")), run, "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used: (lengths, longest first), count.

    Patterns are kept by the room they have left. A length goes to the pattern with the most room left of those
    that it fits in, as often as counts allow; what finds no open pattern opens new ones.
    """
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], size
        while left:
            while room >= length and not open_[room]:
                room -= 1
            if room < length or room == size:
                taken, pattern, n = left, (), left
            else:
                pattern, n = next(iter(open_[room].items()))
                taken = min(left, n)
                if taken == n:
                    del open_[room][pattern]
                else:
                    open_[room][pattern] = n - taken
            grown = (*pattern, length)
            rest = (room if pattern else size) - length
            open_[rest][grown] = open_[rest].get(grown, 0) + taken
            left -= taken
            room = max(room, rest)
    return [(p, n) for by in open_ for p, n in by.items()]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """By length: first ranks, first sequence ids and offsets of the runs of ranks that a place in a pattern takes."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            ranks, seqs, offsets = out.setdefault(length, ([], [], []))
            ranks.append(taken.get(length, 0))
            seqs.append(base)
            offsets.append(offset)
            taken[length] = taken.get(length, 0) + count
            offset += length
        base += count
    return out


def pack(cut: DataFrame, scratch: C.Scratch, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    spark = cut.sparkSession
    # Full pieces are sequences of their own and are counted like the others, as the length `size`.
    # Common lengths, such as full pieces, are dealt out to as many tasks as their count asks for.
    of_length = scratch.write(cut.groupBy("length").agg((F.floor(F.count("*") / RANKED) + 1).alias("salts")), "lengths")  # at most size rows
    salted = cut.join(F.broadcast(of_length), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "start"), F.col("salts"))).drop("salts")
    counts = salted.groupBy("length", "salt").count().orderBy("length", "salt").collect()  # at most size, and one for each RANKED pieces
    first, histogram = [], {}
    for r in counts:
        first.append((r["length"], r["salt"], histogram.get(r["length"], 0)))
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["count"]
    found = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, size)))  # bounded by the histogram
    starts = spark.createDataFrame(first, "length long, salt long, first long")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "row", "start")
    ranked = salted.withColumn("n", F.row_number().over(order)).join(F.broadcast(starts), ["length", "salt"]).withColumn("rank", F.col("first") + F.col("n") - 1)
    columns = [c for c in cut.columns if c != "row"]

    def place(batches):
        where = found.value
        for b in batches:
            seq, off = [], []
            for length, rank in zip(b.column("length").to_pylist(), b.column("rank").to_pylist()):
                ranks, seqs, offsets = where[length]
                k = bisect_right(ranks, rank) - 1
                seq.append(seqs[k] + rank - ranks[k])
                off.append(offsets[k])
            yield {c: b.column(c) for c in columns} | {"sequence_id": seq, "offset": off}

    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return C.arrow_map(ranked.select(*columns, "rank"), place, schema)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    scratch = C.Scratch(docs.sparkSession, "packing")
    return pack(scratch.write(pieces(docs, path, size, end), "pieces"), scratch, size)
