"""Maximal periodic runs of words, by minimizers at several scales.

Inside a run the content repeats at the distance of its period, so the minima of windows over hashed word n-grams do too. A scale
with base P serves periods above P up to 2 P: n-grams of about 0.3 P words, windows of P / 5, and pairs of equal minimizers at such a
distance are the seeds, each extended word by word to its whole run. Periods of at most 32 words are scanned lag by lag, at places
so far apart that no run lies between them.

Why no run is missed: with windows of w places, n-grams of k = w + d + 1 words and minimizers that repeat within d places left out, a run of period q > P and
at least 3 q words holds a stretch of q places whose minimizers depend on the run alone. Were all of them repeats within d, their n-grams would chain to a stretch longer than
q + d of period d or less, and q would not be the smallest period. So one remains, and so does its copy q places on; equal ones are more than d
apart, so only 2 P / d partners within reach have to be looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Periods up to which lags are scanned directly; words of a run at least, and its periods at least.
SHORT, LEAST_WORDS, LEAST_PERIODS = 32, 24, 3
#: Words worked on together; a longer text is alone.
TOGETHER = 400_000
#: Primes and bases of the rolling hash.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 69_069_069)


def powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), prime))
        out = np.concatenate([out, out * step % np.uint64(prime)])
    return out[:n]


class Grams:
    """Hashes of the n-grams of one array of words, of any length, in 62 bits."""

    def __init__(self, words: np.ndarray, seed: int = 12):
        n = len(words)
        # a word's value is a mix of its number, so that numbers in sequence don't cancel
        mixed = (words.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        self.parts = []
        for prime, base in zip(PRIMES, BASES):
            p = np.uint64(prime)
            pw = powers(base, prime, n + 1)
            self.parts.append((np.concatenate([[np.uint64(0)], np.cumsum(mixed % p * pw[:n] % p)]), pw[::-1].copy(), p))

    def of(self, k: int) -> np.ndarray:
        out = None
        for sums, back, p in self.parts:
            h = (sums[k:] - sums[:-k]) % p * back[: len(sums) - k] % p
            out = h if out is None else (out << np.uint64(31)) | h
        return out.astype(np.int64)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Places that are the leftmost least of some window of w places."""
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    bits = max(1, int(n).bit_length())
    key = (h >> bits << bits) | np.arange(n)  # ties of the high bits fall to the left
    full = -(-n // w) * w
    padded = np.concatenate([key, np.full(full - n, np.iinfo(np.int64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & ((1 << bits) - 1)
    return least[np.concatenate([[True], least[1:] != least[:-1]])]


def minimizer_seeds(h: np.ndarray, w: int, near: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of pairs of equal minimizers whose lag is above ``low`` and at most ``high``; repeats within ``near`` places don't count."""
    at = window_minima(h, w)
    at = at[np.lexsort((at, h[at]))]
    repeat = np.concatenate([[False], (h[at[1:]] == h[at[:-1]]) & (at[1:] - at[:-1] <= near)]) if len(at) else np.zeros(0, bool)
    at = at[~repeat]
    value, seeds, lags, step = h[at], [], [], 1
    while step < len(at):
        same = value[step:] == value[:-step]
        lag = at[step:] - at[:-step]
        if not (same & (lag <= high)).any():
            break
        fine = same & (lag > low) & (lag <= high)
        seeds.append(at[:-step][fine])
        lags.append(lag[fine])
        step += 1
    return (np.concatenate(seeds), np.concatenate(lags)) if seeds else (np.zeros(0, np.int64),) * 2


def reach(x: np.ndarray, at: np.ndarray, lag: np.ndarray, way: int, most: np.ndarray | None = None) -> np.ndarray:
    """How many words on from ``at`` (``way`` 1; before it: -1) equal the one ``lag`` later, each; looked at only until ``most``."""
    out, live, step = np.zeros(len(at), np.int64), np.arange(len(at)), 16
    while len(live):
        go = []
        for part in np.array_split(live, max(1, len(live) * step // 2_000_000)):
            a = at[part, None] + (out[part, None] + np.arange(step)[None, :] + (way < 0)) * way
            b = a + lag[part, None]
            same = (a >= 0) & (b < len(x))
            same &= x[np.where(same, a, 0)] == x[np.where(same, b, 0)]
            n = np.where(same.all(1), step, (~same).argmax(1))
            out[part] += n
            go.append(part[(n == step) if most is None else (n == step) & (out[part] < most[part])])
        live = np.concatenate(go)
        step = min(step * 4, 65_536)
    return out


def extended(x: np.ndarray, at: np.ndarray, lag: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the stretches of at least LEAST_WORDS words and LEAST_PERIODS periods around seeds.

    A group's seeds (one lag of one text) that reach the next one are one stretch with it, so each word is looked at a bounded number of times a lag.
    """
    if not len(at):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((at, group))
    at, lag, group = at[order], lag[order], group[order]
    gap = np.concatenate([np.where(group[1:] == group[:-1], at[1:] - at[:-1], len(x)), [len(x)]])
    right = reach(x, at, lag, 1, gap)
    last = right < gap
    first = np.concatenate([[True], last[:-1]])
    q = lag[first]
    start = at[first] - reach(x, at[first], q, -1)
    rows = np.stack([start, at[last] + right[last] - start + q, q], 1)
    return rows[(rows[:, 1] >= LEAST_WORDS) & (rows[:, 1] >= LEAST_PERIODS * rows[:, 2])]


def runs_of(texts: list[np.ndarray]) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of several texts, given as arrays of word numbers of 0 or more, by text, start and period."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    return _runs(texts, lens, np.arange(len(texts))) if lens.sum() else np.zeros((0, 4), np.int64)


def _joined(texts: list[np.ndarray], which: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end, each followed by a word of its own, and where each begins."""
    flat = np.concatenate([y for i in which.tolist() for y in (texts[i], np.array([-1 - i], np.int64))])
    begins = np.cumsum(lens[which] + 1) - (lens[which] + 1)
    return flat, begins


def _runs(texts: list[np.ndarray], lens: np.ndarray, which: np.ndarray) -> np.ndarray:
    found = []

    def note(x: np.ndarray, begins: np.ndarray, own: np.ndarray, at: np.ndarray, lag: np.ndarray) -> None:
        owner = np.searchsorted(begins, at, "right") - 1
        rows = extended(x, at, lag, owner * (int(lag.max()) + 1 if len(lag) else 1) + lag)
        if len(rows):
            owner = np.searchsorted(begins, rows[:, 0], "right") - 1
            found.append(np.column_stack([own[owner], rows[:, 0] - begins[owner], rows[:, 1:]]))

    which = which[lens[which] >= LEAST_WORDS]
    if not len(which):
        return np.zeros((0, 4), np.int64)
    x, begins = _joined(texts, which, lens)
    # direct scans: a run of period q has this many words in a row that equal the one q later, so places that far apart meet it
    for q in range(1, min(SHORT, int(lens[which].max()) // LEAST_PERIODS) + 1):
        stride = max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q)
        at = np.arange(0, len(x) - q, stride)
        at = at[x[at] == x[at + q]]
        # one of the sides of a place in a run is long
        in_row = lambda i: (i >= 0) & (i + q < len(x)) & (x[np.clip(i, 0, len(x) - 1)] == x[np.clip(i + q, 0, len(x) - 1)])
        near = range(1, (stride - 1) // 2 + 1)[:3]
        after, before = np.ones(len(at), bool), np.ones(len(at), bool)
        for j in near:
            after &= in_row(at + j)
            before &= in_row(at - j)
        at = at[after | before]
        note(x, begins, which, at, np.full(len(at), q))
    base = SHORT
    while True:
        which = which[lens[which] > LEAST_PERIODS * base]
        if not len(which):
            break
        x, begins = _joined(texts, which, lens)
        near, w = base // 10, base // 5
        at, lag = minimizer_seeds(Grams(x).of(w + near + 1), w, near, base, 2 * base)
        note(x, begins, which, at, lag)
        base *= 2
    if not found:
        return np.zeros((0, 4), np.int64)
    # a stretch has multiples of its period as periods too: the smallest counts
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def planted(words: list, doc_id: int | None) -> list:
    """The words with a run written into those of every tenth document by the checksum of its id (null id: none)."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


SCHEMA = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def described(words: list[bytes], runs: np.ndarray) -> tuple:
    """What SCHEMA says of one text; ``runs`` are its rows (start, length, period) by start and period."""
    if not len(runs):
        return len(words), 0, None, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    listed = runs.tolist()
    best = min(listed, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in listed)
    return len(words), len(listed), *best, 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def describe_texts(texts: list[str], ids: list[int | None] | None = None) -> list[tuple]:
    """Rows as in SCHEMA, in the order of ``texts``; with ids, of texts with runs written into them (``planted``)."""
    out: list[tuple] = []
    begin = 0
    while begin < len(texts):
        numbers: dict[bytes, int] = {}
        words, coded, size = [], [], 0
        while begin < len(texts) and (not words or size + len(texts[begin]) // 5 < TOGETHER):
            own = texts[begin].encode().split()  # exactly the blanks of [\x20\x09-\x0D]
            if ids is not None:
                own = planted(own, ids[begin])
            words.append(own)
            coded.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in own), np.int64, len(own)))
            size += len(own)
            begin += 1
        rows = runs_of(coded)
        ends = np.searchsorted(rows[:, 0], np.arange(len(words) + 1))
        out += [described(own, rows[ends[i] : ends[i + 1], 1:]) for i, own in enumerate(words)]
    return out


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """``doc_id`` and SCHEMA's columns for every document: its runs of words of a smallest period q that are at least 24 words and 3 q long and that no neighbour extends; of these the
    number, the one of most periods, a digest of all, and a digest of the text with each run cut to its first period.

    ``plant`` writes runs into every tenth text first. One narrow pass: a text is one row, texts are worked on in groups of about TOGETHER words, and
    the work is linear in the words but for a factor of log n scales. Null texts have no words, like empty ones; null ids get no planted run; repeated rows stay.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ids = [None if pd.isna(i) else int(i) for i in pdf["doc_id"].astype("object")]
            out = pd.DataFrame(describe_texts(pdf["text"].fillna("").tolist(), ids if plant else None), columns=[f.split()[0] for f in SCHEMA.split(", ")])
            for name in ("start", "length", "period", "exponent_milli"):
                out[name] = out[name].astype("Int64")
            out.insert(0, "doc_id", pd.array(ids, "Int64"))
            yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, " + SCHEMA)
