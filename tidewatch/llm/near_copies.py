"""Near copies by the Jaccard similarity of word shingles, verified by whole sets.

Candidates are first those whose SimHash fingerprints differ in MOST bits or fewer, by the pigeonhole search of
``simhash``. A Jaccard similarity of 0.8 is a distance of about 10 bits, which that search can't reach, so
MinHash bands then find what it left apart.

Two sets of similarity J agree on a band of ROWS minima with probability J^ROWS, so a pair of similarity
0.8 shares none of BANDS bands with probability (1 - 0.8^4)^24, 3 in a million, a more alike pair less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import buckets, simhash
from tidewatch.llm.shared import cut

BANDS, ROWS = 24, 4
#: Differing bits of SimHash fingerprints up to which they are candidates: beyond it three groups need two flips each, some 700 probes a row.
MOST = 5
#: Two sets are near copies if their Jaccard similarity is ALIKE / WHOLE or more.
ALIKE, WHOLE = 4, 5
#: Members of a bucket up to which all its pairs are joined; larger ones are searched in blocks of BLOCK.
CROWDED, BLOCK = 16, 256
#: Shingles whose minima are taken at once; bits of the map of texts whose sets are wanted, which bears on cost alone.
STEP, SLOTS = 4096, 1 << 24


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles, words and shingles as in ``simhash.fingerprints``."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()
    grams = zip(*[w[i:] for i in range(shingle)]) if len(w) >= shingle else [w] if w else []
    return np.unique(np.array([xxh64_intdigest(b" ".join(g), seed) for g in grams], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; none for the empty set, which is alike to itself only."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    draws = np.random.RandomState(7).randint(0, 1 << 62, BANDS * ROWS + ROWS + BANDS, dtype=np.int64).view(np.uint64) << np.uint64(1) | np.uint64(1)
    factors, weights, own = np.split(draws, [BANDS * ROWS, BANDS * ROWS + ROWS])
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), STEP):
        np.minimum(least, (hashes[None, i : i + STEP] * factors[:, None]).min(1), out=least)
    mixed = least ^ (least >> np.uint64(31))
    return ((mixed.reshape(BANDS, ROWS) * weights).sum(1, dtype=np.uint64) * own + own).view(np.int64)


def alike(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of ``a`` and ``b`` members with ``shared`` in common are near copies, in whole numbers."""
    return shared * (ALIKE + WHOLE) >= ALIKE * (a + b)


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, mark``: the rows with a hash of each text, null texts empty."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), body.alias("text"), F.xxhash64(body).alias("mark"))


def _node(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), 1)


def hashed(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, mark, node, n, fingerprint, keys``: a row per row of ``docs``. Rows of equal shingle sets have one ``node`` and one SimHash ``fingerprint``."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = []
            for text in pdf["text"]:
                s = shingle_hashes(text, shingle)
                found.append((_node(s), len(s), simhash.majority(s, np.array([len(s)]))[0], band_keys(s)))
            names = pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            nodes = np.array([x[0] for x in found], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": names, "mark": pdf["mark"], "node": nodes, "n": np.array([x[1] for x in found], np.int64), "fingerprint": np.array([x[2] for x in found], np.int64), "keys": [x[3] for x in found]})

    return _texts(docs).mapInPandas(run, "doc_id long, mark long, node long, n long, fingerprint long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, data``: the whole set of each of ``wanted(node, mark)``, ``mark`` the hash of a text that has it.

    Texts are hashed again where they lie, so that neither they nor the sets of all of them are stored or
    shuffled. Which are hashed is told by a bit map of fixed size; it may let others through, which the join drops.
    """
    slot = F.pmod(F.col("mark"), F.lit(SLOTS))
    words = wanted.groupBy(F.expr(f"cast(pmod(mark, {SLOTS}) / 64 as int)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(mark, {SLOTS}) % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(SLOTS // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            at = pdf["slot"].to_numpy(np.int64)
            pdf = pdf[(bitmap[at // 64] >> (at % 64)) & 1 == 1]
            sets = [shingle_hashes(t, shingle) for t in pdf["text"]]
            yield pd.DataFrame({"node": np.array([_node(s) for s in sets], np.uint64).view(np.int64), "mark": pdf["mark"].to_numpy(np.int64), "data": [s.tobytes() for s in sets]})

    again = _texts(docs).select("text", "mark", slot.alias("slot")).mapInPandas(run, "node long, mark long, data binary")
    # copies of a text are combined before the shuffle
    return again.groupBy("node", "mark").agg(F.first("data").alias("data")).join(wanted, ["node", "mark"]).select("node", "data")


def _fits(n, m):
    """Whether sets of ``n`` and ``m`` members can be near copies at all."""
    return WHOLE * F.least(n, m) >= ALIKE * F.greatest(n, m)


def simhash_candidates(nodes: DataFrame) -> DataFrame:
    """``a, b``: pairs of ``nodes(node, n, fingerprint)`` whose fingerprints are linked by MOST differing bits or fewer and whose sizes fit.

    A fingerprint stands for its smallest node, with which its other nodes are paired; fingerprints in very large
    buckets are linked by a spanning forest, as ``simhash.linked`` gives it. What these pairs leave apart is for the bands to find.
    """
    full = nodes.where("n > 0")
    heads = cut(full.groupBy("fingerprint").agg(F.min_by(F.struct("node", "n"), "node").alias("head")))
    own = full.join(heads, "fingerprint").select(F.col("head").alias("x"), F.struct("node", "n").alias("y"))
    links = simhash.linked(heads.select("fingerprint"), MOST)
    links = links.join(heads.select(F.col("fingerprint").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fingerprint").alias("b"), F.col("head").alias("y")), "b")
    pairs = own.unionByName(links.select("x", "y")).where((F.col("x.node") != F.col("y.node")) & _fits(F.col("x.n"), F.col("y.n")))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def alike_sets(x: pd.Series, y: pd.Series) -> np.ndarray:
    keep = np.zeros(len(x), bool)
    for i, (a, b) in enumerate(zip(x, y)):
        a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        keep[i] = alike(np.intersect1d(a, b, assume_unique=True).size, len(a), len(b))
    return keep


def forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the members of two blocks that join all of their near copies, groups already found
    (``component``) taken as joined."""
    pdf = pdf.drop_duplicates("node").reset_index(drop=True)
    sets = [np.frombuffer(g, np.uint64) for g in pdf["data"]]
    sizes, node = np.array([len(s) for s in sets]), pdf["node"].to_numpy(np.int64)
    group = np.unique(pdf["component"].to_numpy(np.int64), return_inverse=True)[1]
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    flag, left, a, b = np.zeros(codes.max(initial=0) + 1, bool), np.ones(len(pdf), bool), [], []
    while left.any():
        front = np.flatnonzero(group == group[left.argmax()]).tolist()
        left[front] = False
        while front and left.any():
            x = front.pop()
            own = codes[ends[x] - sizes[x] : ends[x]]
            flag[own] = True
            hit = np.flatnonzero(left & alike(np.add.reduceat(flag[codes], ends - sizes, dtype=np.int64), sizes, sizes[x]))
            flag[own] = False
            a += [node[x]] * len(hit)
            b += node[hit].tolist()
            new = np.flatnonzero(left & np.isin(group, group[hit]))
            left[new] = False
            front += new.tolist()
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def near_copy_groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``doc_id, mark, component_id, is_first``: the near-copy group of every row, the smallest doc_id in it.

    ``mark`` is a hash of the row's text. ``is_first`` holds for one (doc_id, mark) of each group, the smallest, ids that
    are null after all others; so exactly one text of a group is first, whatever ids repeat.

    Rows whose shingle sets have a Jaccard similarity of 0.8 or more are linked, and only these; equal sets are
    one node. SimHash candidates are verified first, then those of the bands that no link joins yet. Buckets are searched as in
    ``buckets.linked``; no candidate is dropped. Rows without a doc_id are grouped but never
    name a group. An empty table gives none.
    """
    rows = cut(hashed(docs, shingle))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    nodes = cut(rows.groupBy("node").agg(F.min(place).alias("first"), F.min("mark").alias("mark"), F.min("n").alias("n"), F.min("fingerprint").alias("fingerprint")))
    keyed = rows.select("node", "n", F.explode("keys").alias("key")).distinct()
    sets = lambda wanted: sets_of(docs, cut(nodes.join(wanted, "node", "left_semi").select("node", "mark")), shingle)
    asked = cut(simhash_candidates(nodes))
    close = cut(buckets.verified(asked, cut(sets(asked.select(F.explode(F.array("a", "b")).alias("node")).distinct())), alike_sets))
    named = buckets.linked(keyed, sets, alike_sets, forest, CROWDED, BLOCK, _fits, known=close)

    roots = cut(nodes.join(named, "node", "left").select("node", "first", F.coalesce("component", "node").alias("root")))
    # both sides of these joins come from plain shuffles, so that a group or a set with very many rows can be split
    least = cut(roots.groupBy("root").agg(F.min("first").alias("least")))
    label = cut(roots.join(least, "root").select("node", "least"))
    out = rows.select("doc_id", "mark", "node").join(label, "node")
    return out.select("doc_id", "mark", F.col("least.doc_id").alias("component_id"), (place == F.col("least")).alias("is_first"))


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` that are first in their near-copy group, one row a group, all columns kept.

    Rows are chosen by id and text together, so rows that share an id are told apart. Of rows with equal id and text that with
    the least other columns stays. Texts are shuffled once.
    """
    first = near_copy_groups(docs, shingle).where("is_first").select(F.col("doc_id").alias("_nc_id"), F.col("mark").alias("_nc_mark")).distinct()
    first = cut(first.select(F.coalesce("_nc_id", F.lit(0)).alias("_nc_id"), F.col("_nc_id").isNull().alias("_nc_none"), "_nc_mark"))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = docs.columns
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_nc_id"), F.col("doc_id").isNull().alias("_nc_none"), F.xxhash64(body).alias("_nc_mark"), F.struct(*names).alias("_nc_row"))
    kept = keyed.groupBy("_nc_id", "_nc_none", "_nc_mark").agg(F.min("_nc_row").alias("_nc_row"))
    return kept.join(first, ["_nc_id", "_nc_none", "_nc_mark"], "left_semi").select("_nc_row.*")
