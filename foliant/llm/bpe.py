"""Operator 1: byte-level BPE encoding and decoding.

Pretokens that a worker has not met lately are encoded together: they are put into padded numpy matrices by
length, and in each round every row merges its leftmost pair of least rank. Pairs are looked up in an
open-addressing table; finished rows leave the matrix, and since each active row loses just one symbol a round,
the matrix is compacted by one column a round. A bounded memo holds pretokens already encoded.

Null and empty texts have no tokens. Very long pretokens (over merges.LONG bytes) merge by a heap with the same order
(rank, then place), so that their time isn't quadratic. Texts are never cut; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from . import common as C
from .merges import PairTable


class Bpe:
    """A rank vocabulary: encode_many() and decode(). A pair merges if its bytes together are in the vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for t, i in ranks.items():
            self.tokens[i] = t
        self.decimal = [str(i) for i in range(size)]
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        halves = ((ranks.get(t[:cut]), ranks.get(t[cut:]), i) for t, i in ranks.items() for cut in range(1, len(t)))
        self.table = PairTable((x for x in halves if None not in x), np.arange(size), size)
        self.memo = C.Memo(self.encode_pretokens, 1_000_000, 64 << 20)

    def encode_pretokens(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        return self.table.merge((self.byte[np.frombuffer(b"".join(raw), np.uint8)], np.array([len(r) for r in raw], np.int64)))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        known = self.memo.lookup(p for s in split for p in s)
        return [np.frombuffer(b"".join([known[p] for p in s]), "<u4") for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(2)
def load(path: str, pattern: str) -> Bpe:
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of a public rank vocabulary; the package is installed on every worker."""
    import public_tokenizers as P

    return P.path(name), P.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (binary: unsigned 32-bit little-endian), one row for each row of docs."""

    def run(batches):
        bpe = load(path, pattern)
        for b in batches:
            yield {"id": b.column(0), "ids": [x.tobytes() for x in bpe.encode_many(C.texts(b))]}

    return C.arrow_map(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), run, "id long, ids binary", batch_mb=16).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text: the inverse of encode(); bytes that aren't UTF-8 become replacement characters."""

    def run(batches):
        bpe = load(path, pattern)
        for b in batches:
            yield {"id": b.column(0), "text": [bpe.decode(np.frombuffer(x or b"", "<u4")).decode(errors="replace") for x in b.column(1).to_pylist()]}

    return C.arrow_map(encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].alias("ids")), run, "id long, text string", batch_mb=16).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every whole text and decodes the ids again."""

    def run(batches):
        bpe = load(path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_many(C.texts(b)):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield {"doc_id": b.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return C.arrow_map(docs.select(docs.doc_id.cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", batch_mb=16)
