"""BPE merges of many short pieces at once: every step merges the best pair of each piece, in array operations."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max
#: Ids below which pairs have a table.
FIRST = 512
#: Sizes of pieces that share a table, and what fills up the shorter ones: an id that has no merges.
STEP, EMPTY = 4, -1


class BatchMerger:
    """merges: (left id, right id, merged id) in order of rank."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        triples = np.array(merges, np.int64).reshape(-1, 3)
        keys = triples[:, 0] << 32 | triples[:, 1]
        keys, first = np.unique(keys, return_index=True)  # the lowest rank of a pair that is listed twice
        self.keys, self.ranks = keys, first.astype(np.int32)
        self.new = triples[:, 2].astype(np.int32)
        # pairs of the first ids, those of single bytes, are looked up directly; EMPTY finds the last row or column
        self.small = np.full((FIRST + 1, FIRST + 1), NONE, np.int32)
        low = (keys >> 32 < FIRST) & (keys & 0xFFFFFFFF < FIRST)
        self.small[keys[low] >> 32, keys[low] & 0xFFFFFFFF] = self.ranks[low]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def merge(self, ids: np.ndarray, sizes: np.ndarray, kind: str = "<i4") -> list[bytes]:
        """The encodings, as bytes of a kind, of pieces given as ids on end: the lowest rank first, the leftmost of equals."""
        out: list = [b""] * len(sizes)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        order = order[np.searchsorted(sizes[order], 1) :]
        # pieces of about the same size share a table, the shorter ones filled up
        edges = np.flatnonzero(np.diff((sizes[order] - 1) // STEP)) + 1
        for rows in np.split(order, edges):
            if len(rows):
                place = np.arange(sizes[rows[-1]])
                at = starts[rows][:, None] + place
                table = np.where(place < sizes[rows][:, None], ids[np.minimum(at, len(ids) - 1)], EMPTY).astype(np.int32)
                self._table(table, sizes[rows], rows, out, kind)
        return out

    def _table(self, table: np.ndarray, sizes: np.ndarray, rows: np.ndarray, out: list, kind: str) -> None:
        ranks = self.small[table[:, :-1], table[:, 1:]] if table.max() < FIRST else self.rank(table[:, :-1], table[:, 1:])
        width = np.dtype(kind).itemsize
        while True:
            size = table.shape[1]
            line = np.arange(len(rows))
            if size > 1:
                at = ranks.argmin(1)
                best = ranks[line, at]
                done = np.flatnonzero(best == NONE)
            else:
                done = line
            if len(done):
                ended = table[done]
                blob = ended[ended != EMPTY].astype(kind).tobytes()
                first = 0
                for i, last in zip(rows[done].tolist(), (np.cumsum(sizes[done]) * width).tolist(), strict=True):
                    out[i] = blob[first:last]
                    first = last
                if len(done) == len(rows):
                    return
                going = np.flatnonzero(best != NONE)
                table, ranks, rows, sizes, at, best = table[going], ranks[going], rows[going], sizes[going], at[going], best[going]
                line = line[: len(rows)]
            sizes = sizes - 1
            place = np.arange(size - 1)[None, :]
            table[line, at] = self.new[best]
            table = np.take_along_axis(table, place + (place > at[:, None]), 1)
            if size > 2:
                place = place[:, :-1]
                ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), 1)
                left = np.flatnonzero(at > 0)
                ranks[left, at[left] - 1] = self.rank(table[left, at[left] - 1], table[left, at[left]])
                right = np.flatnonzero(at < size - 2)
                ranks[right, at[right]] = self.rank(table[right, at[right]], table[right, at[right] + 1])
