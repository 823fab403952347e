"""Document fingerprints that follow edit distance.

A shared random walk reads a text: at each step of time a character is shown and then, by a coin that
depends on time and the character alone, left behind or shown again. Texts a few edits apart soon walk
in step again, so the number of times at which the walks show different characters (a Hamming distance)
follows their edit distance. A fingerprint holds a hexadecimal digit for the character shown at each of a
shared sample of times, as many in each doubling of time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import buckets
from tidewatch.llm.shared import bit_map, cut, marked, parts, stored

#: Sampled times in each octave of time; the walk's coins repeat after PERIOD times and tell CLASSES of characters apart.
PER_OCTAVE, PERIOD, CLASSES = 64, 4096, 64
#: Octave 0 covers times 0 to FIRST - 1, each later one as much again as all before it.
FIRST = 64
#: Cells of the matrix of texts walked together, at most (but for one very long text).
CELLS = 2_000_000
#: Chance that digits of different characters agree.
CHANCE = 1 / 16
#: Characters in a bucket of neighbouring ids, about; likeness of near copies; bands and their digits; growth of lengths from one level to the next.
BUCKET, LEAST, BANDS, DIGITS, LEVEL = 1 << 28, 0.8, 21, 8, 1.25
#: Digits of a sketch, 16 to a number, and how many of two sketches may differ: at the bound more do with a chance of 1 in 70,000.
SKETCH, UNLIKE = 32, 16
#: Bytes of text walked together, at most (but for one very long text).
STEP = 16_000_000
#: Members of a band's bucket up to which all its pairs are verified, and in a block of a larger one.
CROWDED, BLOCK = 16, 128


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that scatters its input."""
    x = x.astype(np.uint64)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def _stays() -> np.ndarray:
    """By time (modulo PERIOD) and class of character: how long the walk stays once it gets there."""
    coin = _mix(np.arange(PERIOD * CLASSES)).reshape(PERIOD, CLASSES) & np.uint64(1) > 0
    coin[0] = True  # so that every stay ends
    stay = np.ones((2 * PERIOD, CLASSES), np.int32)
    for t in range(2 * PERIOD - 2, -1, -1):
        stay[t] = np.where(coin[t % PERIOD], 1, stay[t + 1] + 1)
    return stay[:PERIOD].ravel()


def sample_times(octave: int) -> np.ndarray:
    lo, hi = (0, FIRST) if octave == 0 else (FIRST << octave - 1, FIRST << octave)
    draws = np.random.RandomState(1000 + octave)
    return np.sort(draws.choice(hi - lo, PER_OCTAVE, replace=False) + lo) if hi - lo <= 1 << 20 else np.unique(np.sort(draws.randint(lo, hi, 2 * PER_OCTAVE)))[:PER_OCTAVE]


class Walker:
    def __init__(self) -> None:
        self.stay = _stays()
        self.classes = (_mix(np.arange(1 << 16)) & np.uint64(CLASSES - 1)).astype(np.uint8)  # of the characters below 65536
        self.times = np.zeros(0, np.int64)
        self.octaves = 0

    def sampled(self, end: int) -> np.ndarray:
        """Sampled times of all octaves that begin before ``end``."""
        while self.octaves == 0 or FIRST << self.octaves - 1 < end:
            self.times = np.concatenate([self.times, sample_times(self.octaves)])
            self.octaves += 1
        n = 1
        while FIRST << n - 1 < end:
            n += 1
        return self.times[: n * PER_OCTAVE]

    def fingerprints(self, texts: list[str]) -> list[str]:
        """A fingerprint per text, whole texts: as many digits as its walk's octaves need; ``-`` past the end."""
        return [f for f, _ in self.walks(texts)]

    def walks(self, texts: list[str], marks: list[int] | None = None, heads: list[tuple[str, int]] | None = None) -> list[tuple[str, int]]:
        """A fingerprint per text and the time at which its walk has passed ``marks[i]`` characters (0 without marks).

        With ``heads`` (a fingerprint and a time of each) a text goes on where another's walk stood at that
        time: the fingerprint is that of the other's characters passed by then and this text after them.
        """
        out: list[tuple[str, int]] = [("", 0)] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        b = len(order)
        while b:
            longest = max(1, len(texts[order[b - 1]]))
            a = max(0, b - max(1, CELLS // longest))
            own = order[a:b]
            for i, x in zip(own, self._walk([texts[i] for i in own], [marks[i] if marks else 0 for i in own], [heads[i] if heads else ("", 0) for i in own])):
                out[i] = x
            b = a
        return out

    def _walk(self, texts: list[str], marks: list[int], heads: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """Texts in order of length, walked together, a character of each at a time."""
        lens = np.array([len(t) for t in texts], np.int64)
        longest = int(lens.max()) if len(lens) else 0
        chars = np.zeros((longest, len(texts)), np.uint32)
        for i, t in enumerate(texts):
            chars[: len(t), i] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(chars) and int(chars.max()) < len(self.classes):
            kind = self.classes[chars]
        else:
            kind = (_mix(chars) & np.uint64(CLASSES - 1)).astype(np.uint8)
        t = np.array([h for _, h in heads], np.int64)
        small = not len(t) or int(t.max()) + 20 * longest < 1 << 31
        until = np.empty((longest, len(texts)), np.int32 if small else np.int64)
        t = t.astype(until.dtype)
        firsts = np.searchsorted(lens, np.arange(longest), side="right")  # texts from here on have a character at this place
        for i in range(longest):
            f = firsts[i]
            now = t[f:]
            now += self.stay[(now & (PERIOD - 1)) * CLASSES + kind[i, f:]]
            until[i, f:] = now
        out = []
        for i, n in enumerate(lens):
            print_, begin = heads[i]
            end = int(until[n - 1, i]) if n else begin
            if not end:
                out.append(("", 0))
                continue
            times = self.sampled(end)
            before = int(np.searchsorted(times, begin))
            digits = np.full(len(times), 45, np.uint8)
            digits[:before] = np.frombuffer(print_[:before].encode(), np.uint8)
            if n:
                own = times[before:]
                k = np.searchsorted(until[:n, i], own, side="right")
                live = k < n
                digit = (_mix(chars[np.minimum(k, n - 1), i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + own.astype(np.uint64)) >> np.uint64(7) & np.uint64(15)).astype(np.int64)
                digits[before:] = HEX[np.where(live, digit, 16)]
            out.append((digits.tobytes().decode(), int(until[marks[i] - 1, i]) if marks[i] else begin))
        return out


HEX = np.frombuffer(b"0123456789abcdef-", np.uint8)


def likeness(a: str, b: str) -> float:
    """0 to 1: the estimated share of time at which two walks show the same character, chance taken off.

    Octaves count by the time they stand for, as far as the longer walk goes; 1 for equal fingerprints.
    """
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    if not min(len(a), len(b)):
        return 0.0
    x, y = (np.frombuffer(s.ljust(n, "-").encode(), np.uint8).reshape(-1, PER_OCTAVE) for s in (a, b))
    held = (x != 45) | (y != 45)
    same = (x == y) & held
    weight = FIRST * 2.0 ** np.maximum(np.arange(len(x)) - 1, 0) / PER_OCTAVE
    share = (weight @ same.sum(1)) / max(weight @ held.sum(1), 1e-9)
    return float(max(0.0, (share - CHANCE) / (1 - CHANCE)))


def kept(text: str) -> int:
    """How many characters of a text its edited text keeps: all but the last third."""
    return len(text) - len(text) // 3


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by the first as many of the following text."""
    return text[: kept(text)] + following[: len(text) // 3]


_walker: list[Walker] = []


def walker() -> Walker:
    if not _walker:
        _walker.append(Walker())
    return _walker[0]


def add_fingerprint(docs: DataFrame) -> DataFrame:
    """All columns and ``fingerprint`` of the whole text (null: empty, whose fingerprint is empty)."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(walker().fingerprints(s.fillna("").tolist()), dtype=object)

    return docs.drop("fingerprint").withColumn("fingerprint", run(F.col("text").cast("string")))


def sampled_digits(level: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of places in a fingerprint per band, and the places of a sketch: times drawn evenly below LEVEL ** level, the same for all fingerprints."""
    end, draws = max(1.0, LEVEL**level), np.random.RandomState(level)
    bands = _places_of(draws.random_sample((BANDS, DIGITS)) * end)
    return bands, _places_of((np.arange(SKETCH) + draws.random_sample(SKETCH)) / SKETCH * end)


def _places_of(at: np.ndarray) -> np.ndarray:
    octave = np.where(at < FIRST, 0, np.floor(np.log2(np.maximum(at, FIRST) / FIRST)).astype(int) + 1)
    begin = np.where(octave == 0, 0, FIRST * 2.0 ** (octave - 1))
    size = np.where(octave == 0, FIRST, begin)
    return octave * PER_OCTAVE + np.minimum(((at - begin) / size * PER_OCTAVE).astype(int), PER_OCTAVE - 1)


def band_rows(fingerprints: list[str], nodes: np.ndarray) -> pd.DataFrame:
    """``key, node, s1, s2``: a 64-bit key per band of each fingerprint, in its level of length and the next, and its sketch in
    that level. Two whose lengths differ by up to a factor of LEVEL share a level. None for the empty fingerprint."""
    width = max(map(len, fingerprints), default=0) + 1
    digits = np.frombuffer("".join(f.ljust(width, "-") for f in fingerprints).encode(), np.uint8).reshape(-1, width)
    shown = np.array([len(f.rstrip("-")) for f in fingerprints], np.int64)
    times = walker().sampled(1 << 40)
    level = np.where(shown > 0, np.log(times[shown - 1] + 1.0) / np.log(LEVEL), -9).astype(int)
    out = [np.zeros((4, 0), np.int64)]
    for k in sorted({x for n in set(level[shown > 0].tolist()) for x in (n, n + 1)}):
        own = np.flatnonzero((shown > 0) & ((level == k) | (level == k - 1)))
        bands, sketch = (np.minimum(x, width - 1) for x in sampled_digits(k))
        code = np.zeros((len(own), BANDS), np.uint64)
        for at in bands.T:
            code = _mix(code * np.uint64(31) + digits[own][:, at] + np.uint64(1))
        keys = _mix(code + np.arange(BANDS, dtype=np.uint64) + np.uint64(k * BANDS)).view(np.int64)
        shifted = VALUE[digits[own][:, sketch]] << (np.arange(SKETCH, dtype=np.uint64) % np.uint64(16) * np.uint64(4))
        s1, s2 = (x.sum(1, dtype=np.uint64).view(np.int64) for x in np.split(shifted, 2, axis=1))
        out.append(np.stack([keys.ravel(), *(np.repeat(x, BANDS) for x in (nodes[own], s1, s2))]))
    return pd.DataFrame(dict(zip(("key", "node", "s1", "s2"), np.concatenate(out, axis=1))))


#: By the byte of a digit: its value, 0 past the end.
VALUE = np.zeros(256, np.uint64)
VALUE[HEX[:16]] = np.arange(16)


def sketched(n, m):
    """Whether sketches ``n`` and ``m`` (columns of two numbers) differ in UNLIKE digits or fewer."""
    differ = F.lit(0)
    for s in ("s1", "s2"):
        x = n[s].bitwiseXOR(m[s])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ += F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    return differ <= UNLIKE


def alike(x: pd.Series, y: pd.Series) -> np.ndarray:
    return np.array([likeness(a, b) >= LEAST for a, b in zip(x, y)], bool)


def forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between members of different components of two blocks that join all that are alike."""
    pdf = pdf.drop_duplicates("node")
    left = list(zip(pdf["node"], pdf["component"], pdf["data"]))
    links = []
    while left:
        group = left[0][1]
        front, left = [x for x in left if x[1] == group], [x for x in left if x[1] != group]
        while front and left:
            node, _, data = front.pop()
            hit = {x[1]: x for x in left if likeness(data, x[2]) >= LEAST}
            links += [(node, x[0]) for x in hit.values()]
            front += [x for x in left if x[1] in hit]
            left = [x for x in left if x[1] not in hit]
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def near_groups(prints: DataFrame) -> DataFrame:
    """``node, near_group``: every node of ``prints(doc_id, fingerprint, node)`` once, with the smallest doc_id among those linked with it; and ``shared``, whether
    others are. A node is the hash of a fingerprint. ``prints`` should be materialised.

    Fingerprints with a likeness of LEAST or more are linked, equal ones are one. Bit-sampled banding: a band is DIGITS digits at
    times drawn evenly from a walk's length, so two walks that are alike at a share p of all times agree on a band with a chance
    of p ** DIGITS; at the bound p is 0.81 and one of the BANDS bands meets with 0.988. Unlike texts that meet by chance are told by
    their sketches, digits at other times, before fingerprints are fetched. Keys that one fingerprint alone has, which are nearly all, are told by their
    least and largest node and go no further. Members of a bucket are
    verified as in ``buckets.linked``: none is left out of one that is large. Null ids name no group.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf = pdf.drop_duplicates("node")
            yield band_rows(pdf["fingerprint"].tolist(), pdf["node"].to_numpy(np.int64))

    firsts = cut(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    keyed = stored(prints.select("fingerprint", "node").mapInPandas(run, "key long, node long, s1 long, s2 long"), "keys")
    met = cut(keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key"))
    kept = cut(marked(keyed, "key", bit_map(met, "key"), "_met").where("_met").join(met, "key").select("key", "node", F.struct("s1", "s2").alias("n")).distinct())

    def payload(wanted: DataFrame) -> DataFrame:
        few = marked(prints.select("node", "fingerprint"), "node", bit_map(wanted, "node"), "_asked").where("_asked").drop("_asked")
        return few.groupBy("node").agg(F.min("fingerprint").alias("data")).join(wanted, "node", "left_semi")

    named = buckets.linked(kept, payload, alike, forest, CROWDED, BLOCK, sketched)
    roots = cut(firsts.join(named, "node", "left").select("node", "first", ((F.col("rows") > 1) | F.col("component").isNotNull()).alias("shared"), F.coalesce("component", "node").alias("root")))
    least = cut(roots.groupBy("root").agg(F.min("first").alias("near_group")))
    return roots.join(least, "root").select("node", "near_group", "shared")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows dealt to buckets of falling doc_id: ``bucket, none, rev, mark, guard, doc_id, body``, each bucket a partition, in order.

    Bucket bounds are those of a range partitioning of the ids (and hashes of the texts, which order rows of equal or null ids), with about
    BUCKET characters a bucket, however many buckets that takes. The row that begins a bucket is sent to
    the bucket before as well, as its guard (the first bucket's to the last), so that each
    row's successor is in its own bucket. Null ids come last. ``body`` is the text's compressed bytes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # rising order of these is falling order of ids
    base = base.select("doc_id", "text", F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("rev"), F.xxhash64("text").alias("mark"))
    spark = docs.sparkSession
    chars = base.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = max(2 * parts(spark), -(-chars // BUCKET))
    keys = base.select("none", "rev", "mark").repartitionByRange(n, "none", "rev", "mark")
    heads = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("none", "rev", "mark")).alias("head")).collect()
    bounds = sorted({(r["head"]["none"], r["head"]["rev"], r["head"]["mark"]) for r in heads})
    schema = "bucket int, none int, rev long, mark long, guard boolean, doc_id long, body binary"
    if not bounds:
        return spark.createDataFrame([], schema)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=1).compress
        for pdf in it:
            rows = []
            names = pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            for key, name, x in zip(zip(pdf["none"].tolist(), pdf["rev"].tolist(), pdf["mark"].tolist()), names, pdf["text"]):
                k, body = bisect_right(bounds, key) - 1, pack(x.encode())
                rows.append((k, *key, False, name, body))
                if bounds[k] == key:
                    rows.append(((k - 1) % len(bounds), *key, True, name, body))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in schema.split(", ")])

    dealt = base.mapInPandas(run, schema).repartitionById(len(bounds), F.col("bucket"))
    # a guard comes after its bucket's own rows, of several equal ones the first counts
    return dealt.sortWithinPartitions("bucket", "guard", "none", "rev", "mark")


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likenesses.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The next
    document is the one with the next smaller doc_id (after the last, the first; a single row is its own
    next). Null ids sort last, rows of equal id by a hash of their text; null texts are empty. Texts are shuffled
    once, compressed, into buckets of neighbouring ids; a task walks its bucket in order, a batch at a time,
    and keeps one row back. An empty table gives an empty result.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        w, held = walker(), None  # the row that waits for its successor: bucket, id, text, fingerprint
        for pdf in it:
            step = max(1, min(len(pdf), STEP // max(1, 3 * int(pdf["body"].str.len().mean()))))
            for b in range(0, len(pdf), step):
                part = pdf.iloc[b : b + step]
                texts = [unpack(x).decode() for x in part["body"]]
                fps = w.walks(texts, [kept(t) for t in texts])
                rows, previous = [], held
                names = part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
                for bucket, name, text, guard, fp in zip(part["bucket"], names, texts, part["guard"], fps):
                    if previous is not None and previous[0] == bucket:
                        rows.append((*previous[1:], text, fp))
                    previous = None if guard else (bucket, name, text, fp)
                held = previous
                # an edited text's walk is its text's up to the edit, so it goes on from there
                changed = [edited(text, following) for _, text, _, following, _ in rows]
                others = w.walks([c[kept(text) :] for (_, text, _, _, _), c in zip(rows, changed)], heads=[fp for _, _, fp, _, _ in rows])
                out = [(name, len(text), hashlib.sha256(c.encode()).hexdigest(), fp[0], o, likeness(fp[0], o), likeness(fp[0], after[0])) for (name, text, fp, _, after), c, (o, _) in zip(rows, changed, others)]
                yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in schema.split(", ")])

    return in_order(docs).mapInPandas(run, schema)


def near_edits(docs: DataFrame) -> DataFrame:
    """``edit_fingerprints`` and ``near_group``, the smallest doc_id of the documents linked by fingerprints with a likeness of LEAST or
    more (null where none of them has an id). Every row has one; texts like no other name their own."""
    rows = stored(edit_fingerprints(docs).withColumn("node", F.xxhash64("fingerprint")), "prints")
    # materialised, so that a fingerprint with very many rows can be split; rows like no other stay where they are
    groups = cut(near_groups(rows).where("shared"))
    names = [x for x in rows.columns if x != "node"]
    rows = marked(rows, "node", bit_map(groups, "node"), "_shared")
    named = rows.where("_shared").join(groups, "node", "left").select(*names, F.when(F.col("shared"), F.col("near_group")).otherwise(F.col("doc_id")).alias("near_group"))
    return named.unionByName(rows.where("NOT _shared").select(*names, F.col("doc_id").alias("near_group")))
