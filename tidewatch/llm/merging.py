"""Exact BPE merging of many short words at once, on arrays."""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
_SLOTS, _FACTOR = 20, np.uint64(0x9E3779B97F4A7C15)


class Merger:
    """Merges by rank. ``merges`` are (left, right, merged) token ids, lowest rank first."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.keys = np.zeros(1 << _SLOTS, np.uint64)  # 0: free
        self.ranks = np.full(1 << _SLOTS, NONE, np.int32)
        self.made = np.array([m for _, _, m in merges], np.int32)
        codes = self._codes(np.array([a for a, _, _ in merges], np.int64), np.array([b for _, b, _ in merges], np.int64))
        for code, slot, rank in zip(codes.tolist(), self._slots(codes).tolist(), range(len(merges))):
            while self.keys[slot] and self.keys[slot] != code:
                slot = (slot + 1) % (1 << _SLOTS)
            if not self.keys[slot]:
                self.keys[slot], self.ranks[slot] = code, rank

    @staticmethod
    def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) + np.uint64(1)) << np.uint64(32) | (b.astype(np.uint64) + np.uint64(1))

    @staticmethod
    def _slots(codes: np.ndarray) -> np.ndarray:
        return ((codes * _FACTOR) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it doesn't merge (or an end is -1)."""
        codes = self._codes(a, b)
        slots = self._slots(codes)
        keys = self.keys[slots]
        out = np.where(keys == codes, self.ranks[slots], NONE)
        todo = np.flatnonzero((keys != codes) & (keys != 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) % (1 << _SLOTS)
            keys = self.keys[slots[todo]]
            hit = keys == codes[todo]
            out[todo[hit]] = self.ranks[slots[todo[hit]]]
            todo = todo[~hit & (keys != 0)]
        return np.where((a < 0) | (b < 0), NONE, out)

    def merge(self, tokens: np.ndarray) -> np.ndarray:
        """Rows of tokens, -1 past their end, after all merges: in each round every row's lowest rank, leftmost."""
        out = tokens.astype(np.int32)
        rows = np.arange(len(out))
        t = out.copy()
        width = t.shape[1]
        if width < 2 or not len(t):
            return out
        r = self.rank(t[:, :-1].ravel(), t[:, 1:].ravel()).reshape(len(t), width - 1)
        place = np.arange(width)
        while len(rows):
            best = r.argmin(1)
            k = np.arange(len(rows))
            low = r[k, best]
            live = low < NONE
            out[rows[~live]] = t[~live]
            rows, t, r, best, low = rows[live], t[live], r[live], best[live], low[live]
            if not len(rows):
                break
            k = np.arange(len(rows))
            t[k, best] = self.made[low]
            # close the gap after the merged pair
            later = place[None, :] > best[:, None]
            t = np.where(later, np.concatenate([t[:, 1:], np.full((len(t), 1), -1, np.int32)], 1), t)
            r = np.where(later[:, :-1], np.concatenate([r[:, 1:], np.full((len(r), 1), NONE, np.int32)], 1), r)
            before = np.maximum(best - 1, 0)
            r[k, before] = np.where(best > 0, self.rank(t[k, before], t[k, best]), r[k, before])
            after = np.minimum(best + 1, width - 1)
            at = np.minimum(best, width - 2)
            r[k, at] = np.where(best < width - 1, self.rank(t[k, best], t[k, after]), r[k, at])
        return out


def token_rows(words: list[bytes], width: int, token_of_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of tokens per word, a token a byte, -1 past its end; and the words' lengths."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    rows = np.full((len(words), width), -1, np.int32)
    rows[np.arange(width)[None, :] < lens[:, None]] = token_of_byte[np.frombuffer(b"".join(words), np.uint8)]
    return rows, lens
