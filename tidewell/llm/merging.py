"""Pair merging for many words at once.

Every word is a row of symbol ids. In each round every row takes the best candidate of its agenda, the adjacent pair with the
least rank, the leftmost of equals, and replaces it by the merged symbol, until no row has a candidate. The pairs are
looked up in a hash table. With a rate, a candidate whose keyed hash falls below it is skipped: the hash depends on the
word's key and on the span of first symbols that the merge would cover, so it doesn't depend on the other words.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
PAD = 0xFFFF  #: the symbol of padding
_FREE = np.uint32(0xFFFFFFFF)
_BITS = 20
_COLUMN_BITS = 6


class PairTable:
    """Rank by pair of symbols, and merged symbol by rank; symbols are below 2**16, a rank has one merged symbol."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        bits = max(_BITS, int(np.ceil(np.log2(8 * max(1, len(pairs))))))
        self.shift = np.uint32(32 - bits)
        size = (1 << bits) + 64
        self.keys = np.full(size, _FREE, np.uint32)
        self.ranks = np.full(size, NONE, np.int32)
        self.merged = np.zeros(int(ranks.max(initial=0)) + 1, np.int32)
        self.merged[ranks] = merged
        if (self.merged[ranks] != merged).any() or len(self.merged) > NONE >> _COLUMN_BITS:
            raise ValueError("a rank has more than one merged symbol, or there are too many")
        left, at = np.arange(len(pairs)), self._slot(pairs)
        while len(left):  # linear probing, one step for all that are left
            free = self.keys[at] == _FREE
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.ranks[at[first]] = pairs[left[first]], ranks[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], at[rest] + 1
            if len(at) and at.max() >= size:
                raise ValueError("the pair table is too full")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, NONE without a merge; the symbol of padding has no pairs."""
        keys = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = self._slot(keys)
        seen = self.keys[at]
        ranks = np.where(seen == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != _FREE))
        at = at[open_]
        while open_.size:
            at += 1
            seen = self.keys[at]
            hit = seen == keys[open_]
            ranks[open_[hit]] = self.ranks[at[hit]]
            more = ~hit & (seen != _FREE)
            open_, at = open_[more], at[more]
        return ranks


def _skipped(keys: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int) -> np.ndarray:
    h = keys ^ (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)) < np.uint64(limit)


def merge_rows(table: PairTable, symbols: np.ndarray, keys: np.ndarray | None = None, limit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The merged symbols of rows padded with PAD, one row after the other, and their number in each row.

    A row has fewer than 64 symbols. keys (unsigned 64 bits, one for each row) and limit (of 2**32) make the agenda skip.
    """
    n, width = symbols.shape
    out = np.full((n, width), PAD, np.int32)
    rows = np.arange(n)
    sym = np.ascontiguousarray(symbols.T).astype(np.int32)  # columns first: each step works along many rows
    columns = np.arange(width, dtype=np.int32)[:, None]
    starts = None
    if limit:  # starts[i] is the place of symbol i in the word, that of the first padding the word's end
        starts = np.minimum(np.arange(width + 2, dtype=np.int32)[:, None], (sym != PAD).sum(0, dtype=np.int32)[None, :])
    rank = np.full((width, n), NONE, np.int32)
    if width > 1:
        found = table.find(sym[:-1].ravel(), sym[1:].ravel())
        if limit:
            found[_skipped(np.tile(keys, width - 1), starts[: width - 1].ravel(), starts[2 : width + 1].ravel(), limit)] = NONE
        rank[:-1] = found.reshape(width - 1, n)
    while len(rows):
        best = np.min(np.where(rank == NONE, NONE, (rank << _COLUMN_BITS) | columns), axis=0)
        live = best != NONE
        if not live.all():
            out[rows[~live]] = sym[:, ~live].T
            rows, sym, rank, best = rows[live], sym[:, live], rank[:, live], best[live]
            if limit:
                starts, keys = starts[:, live], keys[live]
            if not len(rows):
                break
        p, at = best & ((1 << _COLUMN_BITS) - 1), np.arange(len(rows))
        sym[p, at] = table.merged[best >> _COLUMN_BITS]
        after = columns[:-1] > p[None, :]
        np.copyto(sym[:-1], sym[1:].copy(), where=after)
        sym[-1] = PAD
        np.copyto(rank[:-1], rank[1:].copy(), where=after)
        rank[-1] = NONE
        if limit:
            np.copyto(starts[:-1], starts[1:].copy(), where=np.arange(len(starts) - 1)[:, None] > p[None, :])
        # the pairs to the left and to the right of the merged symbol are new
        before, behind = np.maximum(p - 1, 0), np.minimum(p + 1, width - 1)
        own = sym[p, at]
        right = np.where(p + 1 < width, sym[behind, at], PAD)
        found = table.find(np.concatenate((sym[before, at], own)), np.concatenate((own, right)))
        if limit:
            spans = np.concatenate((starts[before, at], starts[p, at])), np.concatenate((starts[p + 1, at], starts[np.minimum(p + 2, width + 1), at]))
            found[_skipped(np.concatenate((keys, keys)), *spans, limit)] = NONE
        rank[p, at] = found[len(at) :]
        inner = p > 0
        rank[before[inner], at[inner]] = found[: len(at)][inner]
    mask = out != PAD
    return out[mask], mask.sum(1)
