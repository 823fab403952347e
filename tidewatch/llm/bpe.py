"""Byte-level BPE by speculation and verification.

A word's greedy longest-match segmentation is a guess at its BPE encoding. A sequence of tokens is
what BPE gives exactly if every adjacent pair is what BPE gives for that pair alone, so one
vectorised check over all adjacent pairs of all new words says which guesses hold. Only the words
that fail are merged by rank. Words are remembered per Python worker, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.merging import Merger, token_rows

#: The pre-tokeniser's pattern of the byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text worked on at a time, words and characters of words remembered at most, in one Python worker; bytes of a word up to which it is merged on arrays.
CHUNK_CHARS, MAX_WORDS, MAX_CHARS, WIDE = 1_500_000, 700_000, 16_000_000, 32


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Numbered(dict):
    """Word to number; a word not met before gets the next one and is noted in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class ByteBPE:
    """Encoder and decoder for a byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.find = regex.compile(PIECES).findall
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.token[i] = s.encode() if s in self.special else bytes(byte_of[c] for c in s)
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.id = {self.token[i]: i for s, i in vocab.items() if s not in self.special}
        self.longest: dict[bytes, int] = {}  # by first two bytes, of tokens of two or more
        for t in self.id:
            self.longest[t[:2]] = max(len(t), self.longest.get(t[:2], 0))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.merger = Merger([(a, b, t) for (a, b), (_, t) in self.rank.items()])
        self.byte_id = [self.id[bytes([b])] for b in range(256)]
        self.byte_tokens = np.array(self.byte_id, np.int32)
        # by token: rank of the merge that makes it (-1: a byte), and its two halves
        self.made, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        for (a, b), (r, t) in self.rank.items():
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = r, a, b
        codes = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(codes)
        self.size, self.codes, self.code_rank = size, codes[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.lens = np.array([len(t) for t in self.token], np.int64)
        self.pool = np.frombuffer(b"".join(self.token), np.uint8)
        self.at = np.cumsum(self.lens) - self.lens
        self.forget()

    def forget(self) -> None:
        self.words, self.chars = Numbered(), 0
        self.word_ids = np.zeros(0, np.uint32)
        self.word_at, self.word_len = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, ids, longest = [], 0, len(word), self.id, self.longest
        while i < n:
            for j in range(min(n, i + longest.get(word[i : i + 2], 1)), i, -1):
                if (t := ids.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                raise ValueError(f"byte {word[i]} is not in the vocabulary")
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a with b; a large number where they don't merge."""
        code = a * self.size + b
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[k] == code, self.code_rank[k], np.int64(1) << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the boundary between tokens a and b, for each pair.

        The later of the two merges touching the boundary is undone again and again. The boundary
        falls if the parts now at it would have merged before the merge just undone.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        # what must not be beaten: the merge that removed the present right part of a / left part of b
        bound = np.full(len(a), np.int64(1) << 39)
        strict = np.ones(len(a), bool)
        while len(live):
            r = self.pair_rank(a, b)
            # a merge of equal rank is found from the left: it beats one that began right of it
            bad = np.where(strict, r < bound, r <= bound)
            ok[live[bad]] = False
            ma, mb = self.made[a], self.made[b]
            go = ~bad & ((ma >= 0) | (mb >= 0))
            live, a, b, ma, mb = live[go], a[go], b[go], ma[go], mb[go]
            undo_a = ma >= mb
            # undoing a's merge: a pair at the boundary of that same rank starts right of it, so it comes later
            bound, strict = np.where(undo_a, ma, mb), undo_a
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def merged(self, word: bytes) -> list[int]:
        """Exact merging by rank, leftmost first: a heap of the pairs that merge over a linked list of tokens."""
        ids = [self.byte_id[b] for b in word]
        n, rank = len(ids), self.rank
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (found := rank.get((a, b)))]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            # a pair whose tokens have been merged since is stale
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := rank.get((ids[i], ids[k])):
                    heappush(heap, (found[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (found := rank.get((ids[h], ids[i]))):
                heappush(heap, (found[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        guess = [self.greedy(w) for w in raw]
        lens = np.array([len(g) for g in guess], np.int64)
        flat = np.array([t for g in guess for t in g], np.int64)
        owner = np.repeat(np.arange(len(guess)), lens)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        code, which = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fine = self.compatible(code // self.size, code % self.size)[which] if len(code) else np.zeros(0, bool)
        failed = np.unique(owner[inner[~fine]])
        size = np.array([len(raw[i]) for i in failed], np.int64)
        for lo, width in ((0, 12), (12, WIDE)):
            own = failed[(size > lo) & (size <= width)]
            rows, _ = token_rows([raw[i] for i in own], width, self.byte_tokens)
            rows = self.merger.merge(rows)
            for i, row, n in zip(own.tolist(), rows.tolist(), (rows >= 0).sum(1).tolist()):
                guess[i] = row[:n]
        for i in failed[size > WIDE]:
            guess[i] = self.merged(raw[i])
        return guess

    def learn(self, words: list[str]) -> None:
        self.chars += sum(map(len, words))
        ids = self.encode_words([w for w in words if w not in self.special])
        if len(ids) < len(words):
            rest = iter(ids)
            ids = [[self.special[w]] if w in self.special else next(rest) for w in words]
        lens = np.array([len(x) for x in ids], np.int64)
        at = len(self.word_ids) + np.cumsum(lens) - lens
        self.word_ids = np.concatenate([self.word_ids, np.array([t for x in ids for t in x], np.uint32)])
        self.word_at, self.word_len = np.concatenate([self.word_at, at]), np.concatenate([self.word_len, lens])

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; a special token's text stands for itself."""
        if not any(s in text for s in self.special):
            return self.find(text)
        at, s = min((text.find(s), s) for s in self.special if s in text)
        return [*self.find(text[:at]), s, *self.pieces(text[at + len(s) :])] if text.count(s) < 200 else self._many(text)

    def _many(self, text: str) -> list[str]:
        import regex

        cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        return [p for part in cut.split(text) if part for p in ([part] if part in self.special else self.find(part))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > MAX_WORDS or self.chars > MAX_CHARS:
            self.forget()
        get = self.words.__getitem__
        places = []
        for t in texts:
            f = self.pieces(t)
            places.append(np.fromiter(map(get, f), np.int64, len(f)))
        if self.words.new:
            self.learn(self.words.new)
            self.words.new = []
        return [self.word_ids[spread(self.word_at[k], self.word_len[k])] for k in places]

    def decode(self, ids: np.ndarray) -> str:
        k = ids.astype(np.int64)
        return self.pool[spread(self.at[k], self.lens[k])].tobytes().decode("utf-8", "replace")


def spread(at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices of the runs that begin at ``at`` and are ``lens`` long, one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(at - (ends - lens), lens)


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together; a longer text is alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


_loaded: dict[str, ByteBPE] = {}


def codec(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_column(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids array<long>``: the encoding of the whole text. Null counts as empty (no ids)."""

    @F.pandas_udf("array<long>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = codec(path)
        for s in it:
            texts = s.fillna("").tolist()
            yield pd.Series([x.astype(np.int64) for b, e in chunks(texts) for x in bpe.encode(texts[b:e])], dtype=object)

    return df.withColumn(ids, run(F.col(text)))


def decode_column(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds ``text``: the decoded ids, special tokens included. Null ids give an empty text."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = codec(path)
        for s in it:
            yield pd.Series([bpe.decode(np.asarray(x if x is not None else [], np.uint32)) for x in s], dtype=object)

    return df.withColumn(text, run(F.col(ids)))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    One narrow pass without a shuffle. Null texts count as empty: no tokens. Repeated rows and ids
    stay as they are; other columns are not read. A word of any length (a text without blanks) is merged
    in time n log n of its bytes.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(path)
        for pdf in it:
            texts = pdf["text"].fillna("").tolist()
            rows = []
            for b, e in chunks(texts):
                for ids in bpe.encode(texts[b:e]):
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
