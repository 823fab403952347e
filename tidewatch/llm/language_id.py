"""Language identification with a blended-spectrum string kernel.

k(x, y) counts the n-grams of 1 to 3 characters present in both texts, over the n-grams the landmarks
have, scaled so that k(x, x) = 1. Landmarks are passages of texts drawn by hash. Nystroem features from the landmarks' kernel matrix go into one
ridge regression per language against the rest. A text's kernel row, features and scores are products
of matrices over a batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of what is fitted: training texts per language, their length, landmarks in all and their length. So a model holds at
#: most LANDMARKS x LANDMARK_CHARS x ORDER n-gram places (2.3 MB) whatever the languages and scripts.
PER_LANGUAGE, MAX_CHARS, LANDMARKS, LANDMARK_CHARS = 150, 20_000, 96, 2_000
RIDGE, SHARPNESS, ORDER = 1e-2, 6.0, 3
#: Numbers of n-grams below which a column is looked up in a table, else in the sorted n-grams; both are exact.
SLOTS = 1 << 22
#: Rows of a batch's presence matrix at most, its cells, and characters.
BATCH_ROWS, BATCH_CELLS, BATCH_CHARS = 128, 1 << 24, 1_000_000
UNKNOWN = "und"


class KernelModel:
    """Fitted on labelled texts; scores any texts. Plain arrays of bounded size, so it can be sent to tasks."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.classes = sorted(set(labels))
        if not self.classes:
            return
        own = {c: [i for i, x in enumerate(labels) if x == c] for c in self.classes}
        per = max(2, landmarks // len(self.classes))
        lows = [t.lower() for t in texts]
        chosen = [passage(lows[i], i) for c in self.classes for i in own[c][:per]]
        self.points = np.unique(np.concatenate([codes(t) for t in chosen]))  # the alphabet: characters of the landmarks
        rows = [np.unique(self.grams(codes(t))) for t in chosen]
        rows = [r[r > 0] for r in rows]
        self.vocabulary = np.unique(np.concatenate(rows))
        # sparse: the columns of each landmark's n-grams, one landmark after another
        self.columns = np.concatenate([np.searchsorted(self.vocabulary, r) for r in rows]).astype(np.int32)
        self.sizes = np.array([len(r) for r in rows], np.int64)
        landmarks_ = self.tables()[2]
        w, v = np.linalg.eigh((landmarks_ @ landmarks_.T).astype(np.float64))
        good = w > 1e-6 * w.max()
        self.whiten = (v[:, good] / np.sqrt(w[good])).astype(np.float32)
        z = self.features(lows)
        z1 = np.hstack([z, np.ones((len(z), 1), np.float32)]).astype(np.float64)
        y = np.array([[1.0 if x == c else -1.0 for c in self.classes] for x in labels])
        # classes weigh the same, however many texts each has
        s = np.array([len(labels) / (len(self.classes) * len(own[x])) for x in labels])[:, None]
        penalty = ridge * np.eye(z1.shape[1]) * len(z1) / len(self.classes)
        penalty[-1, -1] = 0
        self.weights = np.linalg.solve(z1.T @ (s * z1) + penalty + 1e-9 * np.eye(len(penalty)), z1.T @ (s * y)).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def tables(self) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Character to number in the alphabet (0: none), n-gram to column (-1: none; None if they are too many for a
        table), and the landmarks' scaled presence rows."""
        if "_tables" not in self.__dict__:
            column = None
            if (len(self.points) + 1) ** ORDER <= SLOTS:
                column = np.full(SLOTS, -1, np.int32)
                column[self.vocabulary] = np.arange(len(self.vocabulary))
            dense = np.zeros((len(self.sizes), len(self.vocabulary)), np.float32)
            dense[np.repeat(np.arange(len(self.sizes)), self.sizes), self.columns] = 1
            dense /= np.maximum(np.sqrt(dense.sum(1, keepdims=True)), 1)
            self._tables = self.letters(), column, dense
        return self._tables

    def letters(self) -> np.ndarray:
        letter = np.zeros(0x110000, np.int32)
        letter[self.points] = np.arange(1, len(self.points) + 1)
        return letter

    def grams(self, c: np.ndarray) -> np.ndarray:
        """The numbers of the n-grams at each place, one order after another; 0 where a character isn't in the alphabet.

        An n-gram's number has its characters' numbers as digits in base alphabet + 1, so no two share one.
        """
        k = np.minimum(np.searchsorted(self.points, c), len(self.points) - 1)
        a = np.where(self.points[k] == c, k + 1, 0)
        return np.concatenate([np.where(ok, gram, 0) for gram, ok in self._orders(a)])

    def _orders(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        gram, ok = a.astype(np.int64), a > 0
        for n in range(1, ORDER + 1):
            if n > 1:
                gram, ok = gram[:-1] * (len(self.points) + 1) + a[n - 1 :], ok[:-1] & (a[n - 1 :] > 0)
            yield gram, ok

    def presence(self, lows: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of presence rows (0 or 1, a column per n-gram) and the share of each text's places of ORDER characters
        that hold an n-gram of the landmarks (1 for a text without such places)."""
        letter, column, _ = self.tables()
        most = max(1, min(BATCH_ROWS, BATCH_CELLS // max(1, len(self.vocabulary))))
        begin = 0
        while begin < len(lows):
            end, size = begin, 0
            while end < len(lows) and end - begin < most and (size == 0 or size + len(lows[end]) <= BATCH_CHARS):
                size += len(lows[end])
                end += 1
            rows = np.zeros((end - begin, len(self.vocabulary)), np.float32)
            known = np.zeros(end - begin)
            # texts are joined with a character outside the alphabet, which no n-gram spans
            c = codes("\0".join(lows[begin:end]))
            lens = np.array([len(t) for t in lows[begin:end]], np.int64)
            owner = np.repeat(np.arange(end - begin), lens + 1)[: len(c)]
            for lo in range(0, len(c), 1 << 20):  # blocks overlap by ORDER - 1
                o = owner[lo : lo + (1 << 20) + ORDER - 1]
                for gram, ok in self._orders(letter[c[lo : lo + (1 << 20) + ORDER - 1]].astype(np.int64)):
                    if column is not None:
                        k = column[np.where(ok, gram, 0)]
                    else:
                        k = np.minimum(np.searchsorted(self.vocabulary, gram), len(self.vocabulary) - 1)
                        k = np.where(self.vocabulary[k] == gram, k, -1)
                    hit = ok & (k >= 0)
                    rows[o[: len(k)][hit], k[hit]] = 1
                known += np.bincount(o[: len(k)][hit], minlength=end - begin)
            places = lens - ORDER + 1
            yield rows, np.where(places > 0, known / np.maximum(places, 1), 1.0)
            begin = end

    def features(self, lows: list[str]) -> np.ndarray:
        return self.described(lows)[0]

    def described(self, lows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nystroem features, and the share of places with an n-gram of the landmarks."""
        out, known = [np.zeros((0, self.whiten.shape[1]), np.float32)], [np.zeros(0)]
        for rows, share in self.presence(lows):
            norm = np.maximum(np.sqrt(rows.sum(1, keepdims=True)), 1)
            out.append(((rows @ self.tables()[2].T) / norm) @ self.whiten)
            known.append(share)
        return np.concatenate(out), np.concatenate(known)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score (0 to 1) of each whole text, UNKNOWN and 0 without any letter; and the share of its places
        whose ORDER characters some landmark has, which is low for languages and scripts that weren't learned."""
        if not texts:
            return [], np.zeros(0), np.zeros(0)
        has = np.array([any(map(str.isalpha, t)) for t in texts])
        if not self.classes:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        z, known = self.described([t.lower() for t in texts])
        f = SHARPNESS * (z @ self.weights[:-1] + self.weights[-1])
        p = np.exp(f - f.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.classes[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, p.max(1), 0.0).astype(float), np.where(has, known, 0.0)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def passage(text: str, draw: int) -> str:
    """The text, or LANDMARK_CHARS characters of it from a place drawn by its number."""
    return text if len(text) <= LANDMARK_CHARS else text[(at := draw * 7919 % (len(text) - LANDMARK_CHARS + 1)) : at + LANDMARK_CHARS]


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS, landmarks: int = LANDMARKS) -> KernelModel:
    """Fit on a bounded sample of labelled rows that aren't held out.

    Of each language up to ``per_language`` rows (smallest hash of the id) with a letter and at most
    ``max_chars`` characters are learned from, so what reaches the driver is at most languages x
    per_language x max_chars characters. Languages are counted over all rows first, which sets the
    hash bound, so that ranking within a language sees a few rows only.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(~held_out())
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.join(F.broadcast(counts), "lang").where(spread < F.lit(2.0 * per_language + 20) / F.col("n"))
    ranked = drawn.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct(spread.alias("s"), "doc_id", "text"))).alias("all"))
    got = ranked.select("lang", F.explode(F.slice("all", 1, per_language)).alias("r")).select("lang", "r.*").collect()
    # within a language in order of the hash, so that the first ones are a sample for the landmarks
    got = sorted(((r["lang"], r["s"], r["doc_id"], r["text"]) for r in got), key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3]))
    return KernelModel([r[3] for r in got], [r[0] for r in got], landmarks)


def identify(docs: DataFrame, model: KernelModel) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``, ``known``, from the whole text alone. Narrow: no shuffle.

    ``known`` is the share of a text's places of three characters that the landmarks have. Null and letterless texts give ``und``, 0 and 0. Columns of those names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double,known:double>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            names, scores, known = sent.value.predict(s.fillna("").tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores, "known": known})

    kept = docs.drop("lang_pred", "score", "known")
    return kept.select("*", run(F.col("text").cast("string")).alias("_language")).select(*kept.columns, "_language.lang_pred", "_language.score", "_language.known")
