"""Token counts by rank-synchronous merging on ragged arrays.

Words are laid end to end in one flat array of symbols. In each round every word's lowest-ranked pair is found by a
segmented minimum and all its places are merged at once; words without a pair that merges leave, and their count is the number of
symbols that survive. Nothing is decoded or listed: only numbers of symbols are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.bpe import ByteBPE, Numbered, chunks, codec
from tidewatch.llm.merging import NONE

#: Words and characters of words remembered at most in one Python worker, and bytes of new words that are merged together.
MAX_WORDS, MAX_CHARS, TOGETHER = 700_000, 16_000_000, 2_000_000


def in_order(bpe: ByteBPE) -> bool:
    """Whether every merge ranks after those that make its parts. Then merging all places of a word's lowest pair at once is what
    merging them one by one gives."""
    halves = np.array([[r, bpe.made[a], bpe.made[b]] for (a, b), (r, _) in bpe.rank.items()], np.int64).reshape(-1, 3)
    return bool((halves[:, 1:] < halves[:, :1]).all())


class TokenCounter:
    """Numbers of tokens of texts under a byte-level vocabulary."""

    def __init__(self, path: str):
        self.bpe = codec(path)
        self.together = in_order(self.bpe)
        self.forget()

    def forget(self) -> None:
        self.words, self.chars, self.counts = Numbered(), 0, np.zeros(0, np.int64)

    def merged_counts(self, symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Symbols left of each word; ``lens`` says how many of ``symbols`` each has (one at least)."""
        merger = self.bpe.merger
        out = lens.copy()
        t, word = symbols.astype(np.int32), np.repeat(np.arange(len(lens)), lens)
        rank = np.full(len(t), NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = merger.rank(t[inner], t[inner + 1])
        while len(t):
            begins = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            size = np.diff(begins, append=len(t))
            low = np.minimum.reduceat(rank, begins)
            done = low == NONE
            if done.any():
                out[word[begins[done]]] = size[done]
                stay = np.repeat(~done, size)
                t, word, rank, low, size = t[stay], word[stay], rank[stay], low[~done], size[~done]
                if not len(t):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            if self.together:
                # places one after another overlap (a pair of like symbols): every second one from the left merges
                first = np.concatenate([[True], at[1:] != at[:-1] + 1])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            else:
                at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            t[at] = merger.made[rank[at]]
            stay = np.ones(len(t), bool)
            stay[at + 1] = False
            t, word, rank = t[stay], word[stay], rank[stay]
            at = at - np.arange(len(at))
            for left in (at[at > 0] - 1, at[at + 1 < len(t)]):
                same = word[left] == word[left + 1]
                rank[left] = np.where(same, merger.rank(t[left], t[left + 1]), NONE)
            rank[-1] = NONE
        return out

    def learn(self, words: list[str]) -> None:
        self.chars += sum(map(len, words))
        found, raw, begin = [], [w.encode() for w in words], 0
        while begin < len(raw):
            end, size = begin, 0
            while end < len(raw) and (end == begin or size + len(raw[end]) <= TOGETHER):
                size += len(raw[end])
                end += 1
            part = raw[begin:end]
            lens = np.fromiter(map(len, part), np.int64, len(part))
            found.append(self.merged_counts(self.bpe.byte_tokens[np.frombuffer(b"".join(part), np.uint8)], lens))
            begin = end
        counts = np.concatenate(found)
        if self.bpe.special:
            counts[[w in self.bpe.special for w in words]] = 1
        self.counts = np.concatenate([self.counts, counts])

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.words) > MAX_WORDS or self.chars > MAX_CHARS:
            self.forget()
        get, places = self.words.__getitem__, []
        for text in texts:
            pieces = self.bpe.pieces(text)
            places.append(np.fromiter(map(get, pieces), np.int64, len(pieces)))
        if self.words.new:
            self.learn(self.words.new)
            self.words.new = []
        return np.array([self.counts[p].sum() for p in places], np.int64)


_loaded: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _loaded:
        _loaded[path] = TokenCounter(path)
    return _loaded[path]


def count_column(path: str, text: str = "text"):
    """A column: the number of tokens of a text column under the vocabulary at ``path`` (a byte-level one in JSON). Null counts as empty: 0.
    Special tokens' strings count as one token each."""

    @F.pandas_udf("long")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for s in it:
            texts = s.fillna("").tolist()
            parts = [own.count(texts[b:e]) for b, e in chunks(texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return run(F.col(text).cast("string"))


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text: UTF-8 bytes, tokens, and whether there are more than ``limit``.

    One narrow pass without a shuffle. A null text counts as empty (0 bytes, 0 tokens); repeated rows and ids stay as they are and
    other columns are not read. A word of any length is merged in as many rounds as it has different merges. An empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count_column(path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
