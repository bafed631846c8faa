"""Merge tables for byte-pair encoders: a vectorised open-addressing hash table of
symbol pairs, and rounds of merges over one long sequence."""

from __future__ import annotations

import heapq

import numpy as np

#: Rank of a pair that does not merge.
NEVER = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> (rank, merged id), looked up for whole arrays at once.

    Linear probing over a table at most half full; a lookup probes until every key of
    the array has met itself or an empty slot.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._slots = np.full(1 << bits, 2**64 - 1, np.uint64)
        self._rank = np.full(1 << bits, NEVER, np.int32)
        self._merged = np.full(1 << bits, -1, np.int32)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self._slots[at[todo]] == np.uint64(2**64 - 1)
            spots, first = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][first]
            self._slots[spots], self._rank[spots], self._merged[spots] = keys[placed], rank[placed], merged[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + 1) & self._mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self._shift).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or of an empty slot."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._home(keys)
        found = self._slots[at]
        miss = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        for _ in range(len(self._slots)):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & self._mask
            found = self._slots[at[miss]]
            miss = miss[(found != keys[miss]) & (found != np.uint64(2**64 - 1))]
        return at

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self._rank[self._find(left, right)]

    def ranks_and_merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._find(left, right)
        return self._rank[at], self._merged[at]


def merge_long(rows: list[np.ndarray], table: PairTable) -> list[np.ndarray]:
    """The merges of long sequences: lowest rank first, and leftmost among equals, in each.

    Rounds over one flat array of all rows, with links between what is left. A round takes
    the lowest rank and merges its places from the left, all at once, up to the first that
    makes a pair of no higher rank, which comes first then. Places are kept by rank, so
    that a round costs what it merges and not the whole length.
    """
    # a symbol that is none on either side of each row: its pairs never merge
    if not rows:
        return []
    none = np.full(1, -1, np.int64)
    ids = np.concatenate([none, *(x for row in rows for x in (row.astype(np.int64), none))])
    n = len(ids)
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    rank, into = np.full(n, NEVER, np.int32), np.full(n, -1, np.int32)
    real, alive = ids >= 0, np.ones(n, bool)
    places: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def look(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and results of pairs."""
        r, m = np.full(len(left), NEVER, np.int32), np.full(len(left), -1, np.int32)
        both = (left >= 0) & (right >= 0)
        r[both], m[both] = table.ranks_and_merged(left[both], right[both])
        return r, m

    def put(r: int, at: np.ndarray) -> None:
        if r not in places:
            places[r] = []
            heapq.heappush(waiting, r)
        places[r].append(at)

    def ranked(at: np.ndarray) -> None:
        """Look up the pairs that begin at these places, and keep the places by rank."""
        rank[at], into[at] = look(ids[at], ids[after[at]])
        at = at[rank[at] != NEVER]
        order = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            put(int(rank[part[0]]), part)

    ranked(np.flatnonzero(real))
    while waiting:
        r = heapq.heappop(waiting)
        every = np.unique(np.concatenate(places.pop(r)))
        every = every[rank[every] == r]  # the others have merged otherwise
        if not len(every):
            continue
        # of places that overlap, every other one from the left of their run
        nth = np.arange(len(every))
        run = np.maximum.accumulate(np.where(np.r_[True, after[every[:-1]] != every[1:]], nth, 0))
        at = every[(nth - run) % 2 == 0]
        right, merged = after[at], into[at].astype(np.int64)
        # when one is merged, what is left of it has been, and what is right of it has not
        left_id = ids[before[at]]
        touching = np.r_[False, after[right[:-1]] == at[1:]]
        left_id[touching] = merged[:-1][touching[1:]]
        sooner = (look(left_id, merged)[0] <= r) | (look(merged, ids[after[right]])[0] <= r)
        if sooner.any():
            end = int(sooner.argmax()) + 1
            at, right, merged = at[:end], right[:end], merged[:end]
            if len(rest := every[every > right[-1]]):
                put(r, rest)
        ids[at] = merged
        rank[right], alive[right] = NEVER, False
        following = after[right]
        after[at], before[following] = following, at
        touched = np.unique(np.concatenate([at, before[at]]))
        ranked(touched[real[touched]])
    keep = alive[real]
    return np.split(ids[real][keep], np.cumsum(np.bincount(row_of[keep], minlength=len(rows)))[:-1])
