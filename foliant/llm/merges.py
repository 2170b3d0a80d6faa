"""Byte-pair merging of many short symbol rows at once, in padded numpy matrices."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np

NONE = np.int32(2**31 - 1)
#: Rows of more symbols than this merge by a heap in the same order (rank, then place): not quadratic.
LONG = 512


class PairTable:
    """Pairs of symbols and the rank of their merge, in an open-addressing table; into[rank] is the merged symbol."""

    def __init__(self, pairs: Iterable[tuple[int, int, int]], into: np.ndarray, size: int):
        rows = np.array(list(pairs), np.int64).reshape(-1, 3)
        self.size, self.into = size, into.astype(np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rows)) * 4))))
        self.keys, self.ranks = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, NONE, np.int32)
        keys, left, self.probes = (rows[:, 0] * size + rows[:, 1]).astype(np.uint64), np.arange(len(rows)), 0
        at = self._slot(keys)
        while len(left):
            self.probes += 1
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = first & (self.ranks[at] == NONE)
            self.keys[at[put]], self.ranks[at[put]] = keys[left[put]], rows[left[put], 2]
            left, at = left[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for those that don't merge; a symbol under 0 is padding."""
        keys = a.astype(np.uint64) * np.uint64(self.size) + b.astype(np.uint64)
        at = self._slot(keys)
        hit = self.keys[at] == keys
        out = np.where(hit, self.ranks[at], NONE)
        miss = np.flatnonzero(~hit & (self.ranks[at] != NONE))
        for _ in range(1, self.probes):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[miss]] == keys[miss]
            out[miss[hit]] = self.ranks[at[miss[hit]]]
            miss = miss[~hit & (self.ranks[at[miss]] != NONE)]
        out[(a < 0) | (b < 0)] = NONE
        return out

    def merge(self, rows: list[np.ndarray] | tuple[np.ndarray, np.ndarray]) -> list[bytes]:
        """Merges rows, given as (all symbols, length of each); gives unsigned 32-bit little-endian symbols."""
        flat, size = rows
        starts = np.cumsum(size) - size
        out: list = [b""] * len(size)
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self._heap(flat[starts[i] : starts[i] + size[i]])
        order = np.flatnonzero((size <= LONG) & (size > 0))
        order = order[np.argsort(size[order], kind="stable")]
        sorted_size, at = size[order], 0
        while at < len(order):  # a bucket: lengths within an eighth of each other, at most 2^18 symbols
            low = int(sorted_size[at])
            high = low + low // 8
            end = min(int(np.searchsorted(sorted_size, high, "right")), at + max(1, (1 << 18) // high))
            who = order[at:end]
            width = int(sorted_size[end - 1])
            cols = np.arange(width)
            real = cols < size[who][:, None]
            ids = np.where(real, flat[np.minimum(starts[who][:, None] + cols, len(flat) - 1)], -1).astype(np.int32)
            self._matrix(ids, who, out)
            at = end
        return out

    def _matrix(self, ids: np.ndarray, who: np.ndarray, out: list) -> None:
        def leave(x, owners):
            real = x >= 0
            ends = (4 * np.cumsum(real.sum(axis=1))).tolist()
            body, at = x[real].astype("<u4").tobytes(), 0
            for i, end in zip(owners.tolist(), ends):
                out[i] = body[at:end]
                at = end

        width = ids.shape[1]
        ranks = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1) if width > 1 else None
        while width > 1:
            at = ranks.argmin(axis=1)
            n = np.arange(len(ids))
            best = ranks[n, at]
            if (done := best == NONE).any():
                leave(ids[done], who[done])
                on = ~done
                ids, ranks, who, at, best = ids[on], ranks[on], who[on], at[on], best[on]
                if not len(ids):
                    return
                n = n[: len(ids)]
            # Each row loses the right symbol of its pair, and the pair's rank.
            ids[n, at] = self.into[best]
            keep = np.ones(ids.shape, bool)
            keep[n, at + 1] = False
            ids = ids[keep].reshape(len(ids), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[n, at] = False
            ranks = ranks[keep].reshape(len(ids), width - 2)
            width -= 1
            if width > 1:
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
                ranks[left, at[left] - 1] = self.lookup(ids[left, at[left] - 1], ids[left, at[left]])
                ranks[right, at[right]] = self.lookup(ids[right, at[right]], ids[right, at[right] + 1])
        leave(ids, who)

    def _heap(self, symbols: np.ndarray) -> bytes:
        now = self.lookup(symbols[:-1], symbols[1:]).tolist()
        ids, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now.append(int(NONE))
        heap = [(r, i) for i, r in enumerate(now) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], now[j] = int(self.into[r]), -1, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            now[i] = int(NONE)
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    now[x] = int(self.lookup(np.array([ids[x]], np.int32), np.array([ids[y]], np.int32))[0])
                    if now[x] != NONE:
                        heapq.heappush(heap, (now[x], x))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()
