"""Best-fit packing with exact-complement hashing.

Which documents share a sequence depends only on their lengths, and there are at most ``capacity``
different lengths. So the plan is made from the length histogram (a fixed number of counters, however
large the corpus) as patterns of lengths with a multiplicity, and the pieces are dealt to the pattern
slots by their rank among the pieces of their length, which Spark computes in two levels.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.bpe import Numbered, byte_symbols, chunks, spread
from tidewatch.llm.merging import Merger, token_rows
from tidewatch.llm.shared import cut, parts

#: Words and their characters remembered at most in one Python worker; bytes of a word up to which it is merged on arrays.
MAX_WORDS, MAX_CHARS, WIDE = 900_000, 16_000_000, 32


class WordTokenizer:
    """A tokenizers model that lower-cases and drops white space, applied to each distinct word once.

    Its pre-tokeniser never matches across white space, so a text's ids are those of its words,
    one after another. A word of letters is one pre-token, and with a full stop or comma after it two, so
    new words of this kind are merged together on arrays, by the model's own merges.
    """

    def __init__(self, path: str):
        # a task has one core; the library's own threads would take those of other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        vocab, end = spec["vocab"], spec["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        self.merger = Merger([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.zeros(len(vocab), np.int32)  # by a byte's token: that of the byte at a word's end
        self.last[self.first] = [vocab[s + end] for s in symbols]
        self.marks = {m: vocab[m + end] for m in ".,"}
        self.forget()

    def forget(self) -> None:
        self.words, self.chars = Numbered(), 0
        self.ids, self.at, self.len = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Ids of the new words: those of letters alone (but for a mark) merged together on arrays, the rest by the library."""
        new, marks = self.words.new, self.marks
        self.chars += sum(map(len, new))
        self.words.new = []
        bare, marked, simple = [], [], []
        for w in new:
            x, m = (w[:-1], marks[w[-1]]) if w[-1] in marks else (w, -1)
            low = x.lower()
            letters = low.isalpha() and (low.isascii() or "\u03c3" not in low and "\u03c2" not in low and is_normalized("NFC", x))
            raw = low.encode() if letters else b""
            simple.append(letters and len(raw) <= WIDE)
            bare.append(raw)
            marked.append(m)
        ok = np.array(simple, bool)
        marked_, size = np.array(marked, np.int64), np.fromiter(map(len, bare), np.int64, len(bare))
        lens = np.zeros(len(new), np.int64)
        order, flat = [], []
        for lo, width in ((0, 12), (12, WIDE)):
            own = np.flatnonzero(ok & (size > lo) & (size <= width))
            rows, n = token_rows([bare[i] for i in own], width + 1, self.first)
            k = np.arange(len(own))
            rows[k, n - 1] = self.last[rows[k, n - 1]]
            rows = self.merger.merge(rows)
            n = (rows >= 0).sum(1)
            rows[k, np.minimum(n, width)] = np.where(marked_[own] >= 0, marked_[own], rows[k, np.minimum(n, width)])
            lens[own] = (rows >= 0).sum(1)
            order.append(own)
            flat.append(rows[rows >= 0])
        rest = np.flatnonzero(~ok)
        for b in range(0, len(rest), 20_000):
            part = rest[b : b + 20_000]
            got = [e.ids for e in self.model.encode_batch_fast([new[i] for i in part], add_special_tokens=False)]
            lens[part] = [len(x) for x in got]
            flat.append(np.array([t for x in got for t in x], np.int64))
            order.append(part)
        order_ = np.concatenate(order)
        at = np.zeros(len(new), np.int64)
        at[order_] = np.cumsum(lens[order_]) - lens[order_]
        self.at = np.concatenate([self.at, len(self.ids) + at])
        self.len = np.concatenate([self.len, lens])
        self.ids = np.concatenate([self.ids, *[x.astype(np.uint32) for x in flat]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > MAX_WORDS or self.chars > MAX_CHARS:
            self.forget()
        get = self.words.__getitem__
        places: list[np.ndarray | None] = []
        for t in texts:
            # str.split also splits at the separators 0x1C-0x1F, which aren't white space to the model
            if "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t:
                places.append(None)
            else:
                f = t.split()
                places.append(np.fromiter(map(get, f), np.int64, len(f)))
        if self.words.new:
            self._learn()
        return [np.array(self.model.encode(t, add_special_tokens=False).ids, np.uint32) if k is None else self.ids[spread(self.at[k], self.len[k])] for t, k in zip(texts, places)]


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``.

    A document is its ids and then ``end_id``; only documents longer than ``capacity`` are cut.
    Null texts count as empty (one piece, holding ``end_id`` alone).
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        tail = np.array([end_id], np.uint32)
        for pdf in it:
            texts, rows = pdf["text"].fillna("").tolist(), []
            names = pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            for b, e in chunks(texts):
                for name, ids in zip(names[b:e], tok.encode(texts[b:e])):
                    ids = np.concatenate([ids, tail]).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        rows.append((name, k, at, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def exact_complements(n: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns that fill a sequence exactly, with multiplicities; ``n``, the counts by length, are taken down by what they use.

    For each length, longest first and of any size, the gap it leaves is looked up among the single lengths no longer; once all lengths have had their singles, among the
    sums of two, then of three, as far as such pieces are still there. A hit is taken as often as the counts allow. Small pieces that fill one gap alone aren't used up
    in threes before longer ones have had them.
    """
    capacity = len(n) - 1
    done: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        k = min(int(n[x]) // c for x, c in need.items())
        if k:
            for x, c in need.items():
                n[x] -= k * c
            done.append((lengths, k))

    def pairs(gap: int, below: int) -> Iterator[tuple[int, int]]:
        """Pairs a >= b of lengths there are, a at most below, whose sum is gap; a descending."""
        a = np.arange(min(gap - 1, below), (gap + 1) // 2 - 1, -1)
        for x in a[(n[a] > 0) & (n[gap - a] > 0)].tolist():
            yield x, gap - x

    def single(length: int, gap: int) -> None:
        if gap <= length and n[gap]:
            take((length, gap) if gap else (length,))

    def two(length: int, gap: int) -> None:
        for p in pairs(gap, length):
            if not n[length]:
                break
            take((length, *p))

    def three(length: int, gap: int) -> None:
        there = (n[: gap + 1] > 0).astype(np.int64)
        there[length + 1 :] = 0
        sums = np.convolve(there, there)[: gap + 1] > 0
        for a in range(min(gap - 2, length), (gap + 2) // 3 - 1, -1):
            if not n[length]:
                break
            if n[a] and sums[gap - a]:
                for b, c in pairs(gap - a, a):
                    if not n[length] or not n[a]:
                        break
                    take((length, a, b, c))

    n[0] = 1  # a gap of nothing is filled by nothing
    for many, fill in enumerate((single, two, three), 1):
        # the pieces beside a longest one are no longer than it
        for length in range(capacity, -(-capacity // (many + 1)) - 1, -1):
            if n[length] and (many == 1 or capacity - length >= many):
                fill(length, capacity - length)
    n[0] = 0
    return done


def best_fit(n: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with multiplicities for all pieces, longest first, each into the fullest sequence that it fits."""
    capacity = len(n) - 1
    bins: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        left = int(n[length])
        while left:
            gap = min((g for g in bins if g >= length), default=None)
            if gap is None:
                fits = capacity // length
                full, rest = divmod(left, fits)
                for pattern, count in (((length,) * fits, full), ((length,) * rest, 1)):
                    if pattern and count:
                        bins.setdefault(capacity - length * len(pattern), []).append([pattern, count])
                break
            pattern, count = bins[gap].pop()
            k = min(count, left)
            left -= k
            if count > k:
                bins[gap].append([pattern, count - k])
            if not bins[gap]:
                del bins[gap]
            bins.setdefault(gap - length, []).append([(*pattern, length), k])
    return [(tuple(p), k) for held in bins.values() for p, k in held]


def plan(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with multiplicities that use up the histogram.

    Exact complements first, then best fit, longest first, for what finds none; with complements of one, of up to two and of up to three pieces, and with none at all, of which the
    plan of the fewest sequences counts (the most complements, if several). So it is never worse than best fit.
    """
    n = np.zeros(capacity + 1, np.int64)
    for length, count in hist.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        n[length] += count
    plans, exact = [], exact_complements(n.copy())
    for most in (4, 3, 2, 0):
        done, rest = [p for p in exact if len(p[0]) <= most], n.copy()
        for lengths, k in done:
            for x in lengths:
                rest[x] -= k
        plans.append(done + best_fit(rest))
    return min(plans, key=lambda p: sum(k for _, k in p))


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` are written with the number of a bucket, as they are read for the histogram and again for the placing. Only
    the histogram (at most ``capacity`` numbers) goes to the driver and only the patterns come
    back. Rows of one length are ranked by bucket, so that a very common length is shared by all
    tasks. Equal rows get different places. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    buckets = max(8, parts(spark))
    keyed = cut(pieces.withColumn("_bucket", F.pmod(F.spark_partition_id(), F.lit(buckets)).cast("int")))
    counts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    patterns = plan(hist, capacity)
    slots, base = [], 0
    used: dict[int, int] = {}
    for lengths, k in patterns:
        offset = 0
        for x in lengths:
            slots.append((x, used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + k
            offset += x
        base += k
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    codes = (table[:, 0] << 44) | table[:, 1]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rank = pdf["_rank"].to_numpy(np.int64)
            k = np.searchsorted(codes, (pdf["length"].to_numpy(np.int64) << 44) | rank, side="right") - 1
            pdf["sequence_id"] = table[k, 2] + rank - table[k, 1]
            pdf["offset"] = table[k, 3]
            yield pdf.drop(columns="_rank")

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_bucket", "length").orderBy(*[c for c in pieces.columns if c != "length"])
    ranked = keyed.withColumn("_in", F.row_number().over(inside) - 1).join(starts, ["_bucket", "length"])
    ranked = ranked.select(*[F.col(c) for c in pieces.columns], (F.col("_in") + F.col("_before")).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise whole documents and pack them: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null texts count as empty. Repeated rows are packed as often as they occur. A word of any length is encoded whole; words
    are remembered up to MAX_WORDS and MAX_CHARS a worker.
    """
    return place(token_pieces(docs, path, capacity, end_id), capacity)
