"""What both byte-pair operators share: the table of mergeable pairs and the plain merge of one sequence."""

from __future__ import annotations

import heapq

import numpy as np

#: Rank of a pair that does not merge.
NEVER = np.int32(2**31 - 1)
#: Pairs looked up at a time, so that what a lookup needs besides its result stays small.
PART = 1 << 16


class Pairs:
    """Pairs of symbols whose joined text is a symbol: rank of the merge (lowest first) and the joined symbol."""

    def __init__(self, symbols: dict, rank: list[int]):
        """``symbols``: text or bytes to number; ``rank`` by number. Every way to cut a symbol in two is a pair."""
        found = {}
        for text, whole in symbols.items():
            for cut in range(1, len(text)):
                left, right = symbols.get(text[:cut]), symbols.get(text[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = whole
        self.keys = np.array(sorted(found), np.int64)
        self.whole = np.array([found[k] for k in self.keys.tolist()], np.int32)
        self.rank = np.array(rank, np.int32)[self.whole] if len(found) else np.zeros(0, np.int32)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined symbol of each pair, ``NEVER`` where there is none."""
        if not len(self.keys):
            return np.full(len(left), NEVER), np.zeros(len(left), np.int32)
        if len(left) > PART:
            found = [self.find(left[i : i + PART], right[i : i + PART]) for i in range(0, len(left), PART)]
            return np.concatenate([r for r, _ in found]), np.concatenate([w for _, w in found])
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER), self.whole[at]

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The sequence after all merges: always the lowest rank next, the leftmost of equal ones."""
        n = len(symbols)
        symbols, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
        ranks, wholes = (x.tolist() for x in self.find(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64)))
        heap = [(r, i, symbols[i], symbols[i + 1], w) for i, (r, w) in enumerate(zip(ranks, wholes)) if r != NEVER]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, whole = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = whole, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            near = [(a, b) for a, b in ((before[i], i), (i, after[i])) if a >= 0 and b >= 0]
            if near:
                found = self.find(np.array([symbols[a] for a, _ in near]), np.array([symbols[b] for _, b in near]))
                for (a, b), r, w in zip(near, found[0].tolist(), found[1].tolist()):
                    if r != NEVER:
                        heapq.heappush(heap, (r, a, symbols[a], symbols[b], w))
        return [s for s in symbols if s >= 0]


def leftmost(follows: np.ndarray) -> np.ndarray:
    """Which of the sorted positions merge when each overlaps the one before it where ``follows``: every other of a run."""
    n = np.arange(len(follows))
    run = np.maximum.accumulate(np.where(follows, 0, n))
    return (n - run) % 2 == 0


class Numbers(dict):
    """Numbers things in the order of their first appearance."""

    def __missing__(self, thing):
        self[thing] = n = len(self)
        return n
