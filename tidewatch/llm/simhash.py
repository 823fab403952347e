"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints within ``most`` differing bits are found through ``m`` groups of bits with thresholds
t_1..t_m, -1 or more, whose sum is ``most - m + 1``: two fingerprints that differ in more than t_i bits
in every group i differ in more than ``most`` altogether. Correlated bits share a group, and a
dynamic programme over estimated candidate counts deals out the thresholds, which may be unequal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.bpe import chunks
from tidewatch.llm.shared import components, cut

BITS = 64
WEIGHTS = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
#: Fingerprints from which candidate counts are estimated; bears on cost alone, never on what is found.
SAMPLE = 2048
#: Index rows of a bucket up to which it is joined; larger ones are searched in blocks of BLOCK.
CROWDED, BLOCK = 128, 4096


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``counts`` of the unsigned ``hashes``: the bits set in over half of them (of none: zero)."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros((len(counts), BITS), np.int64)
    if full := np.flatnonzero(counts).tolist():
        total[full] = np.add.reduceat(bits, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.int64)
    return ((2 * total > counts[:, None]) * WEIGHTS).sum(1, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint``: the 64-bit SimHash (a signed long) of each whole text.

    A-Z are lower-cased, words are runs of other than ASCII white space, shingles are ``shingle``
    words joined by spaces, repeats included (fewer words: all of them; none or null: zero). A bit is
    1 if it is set in over half the XXH64 values.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for pdf in it:
            texts, out = pdf["text"].fillna("").tolist(), []
            for b, e in chunks(texts):
                hashes, counts = [], []
                for t in texts[b:e]:
                    w = t.encode().lower().split()
                    grams = zip(*[w[i:] for i in range(shingle)]) if len(w) >= shingle else [w] if w else []
                    h = [xxh64_intdigest(b" ".join(g), seed) for g in grams]
                    hashes += h
                    counts.append(len(h))
                out.append(majority(np.array(hashes, np.uint64), np.array(counts, np.int64)))
            names = pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            yield pd.DataFrame({"doc_id": names, "fingerprint": np.concatenate(out) if out else np.zeros(0, np.int64)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, fingerprint long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """For each two bits, over all fingerprints, in how many both are 1 (64 x 64), summed per task."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for pdf in it:
            bits = np.unpackbits(pdf["fingerprint"].to_numpy(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += bits.T @ bits
        yield pd.DataFrame({"row": range(BITS), "counts": list(total)})

    rows = fps.select("fingerprint").mapInPandas(run, "row int, counts array<double>")
    got = rows.groupBy("row").agg(*[F.sum(F.col("counts")[j]).alias(f"c{j}") for j in range(BITS)]).collect()
    total = np.zeros((BITS, BITS))
    for r in got:
        total[r["row"]] = [r[f"c{j}"] for j in range(BITS)]
    return total


def group_bits(counts: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Deal bits (0: highest) to ``m`` groups of near equal size, each seeded with the free bit of least
    total correlation and filled with the bits most correlated with its members."""
    p = counts / max(n, 1)
    mean = np.diag(p)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((p - np.outer(mean, mean)) / np.outer(sd, sd))
    free, groups = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        own = [min(free, key=lambda b: (round(sum(corr[b, c] for c in free), 9), b))]
        free.discard(own[0])
        while len(own) < size:
            best = max(free, key=lambda b: (round(sum(corr[b, c] for c in own), 9), -b))
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def mask(bits: list[int]) -> int:
    return sum(1 << (63 - b) for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(width: int, radius: int) -> int:
    """How many values are within ``radius`` of one of ``width`` bits."""
    return sum(len(list(combinations(range(width), r))) for r in range(radius + 1)) if radius >= 0 else 0


def allocate(sample: np.ndarray, groups: list[list[int]], most: int, n: int) -> tuple[list[int], float]:
    """Thresholds of least estimated cost, by dynamic programming over groups and threshold sums.

    The cost of a group at threshold t is its probes (t flips or fewer) plus its candidates, of
    which the share of sample pairs within t bits there is the estimate; it is at least that of
    evenly spread values.
    """
    pairs = max(len(sample) * (len(sample) - 1), 1)
    cost: list[dict[int, float]] = []
    for g in groups:
        v = sample & np.uint64(mask(g))
        d = np.bincount(np.concatenate([np.bitwise_count(v[i : i + 256, None] ^ v[None]).ravel() for i in range(0, len(v), 256)]) if len(v) else np.zeros(0, np.int64), minlength=BITS + 1).cumsum() - len(v)
        cost.append({-1: 0.0} | {t: n * ball(len(g), t) * 1.0 + 0.2 * n * n * max(d[t] / pairs, ball(len(g), t) / 2 ** len(g)) for t in range(min(most, 2) + 1)})
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        now: dict[int, tuple[float, list[int]]] = {}
        for total, (so_far, ts) in best.items():
            for t, x in c.items():
                k = total + t
                if k not in now or so_far + x < now[k][0]:
                    now[k] = (so_far + x, [*ts, t])
        best = now
    found = best.get(most - len(groups) + 1)
    return (found[1], found[0]) if found else ([], float("inf"))


def search_plan(fps: DataFrame, most: int) -> list[tuple[int, list[int], int]]:
    """``(mask, bits, threshold)`` of each group that is searched, for the cheapest number of groups."""
    n = fps.count()
    counts = bit_counts(fps)
    got = fps.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE).collect()
    sample = np.array([r["fingerprint"] for r in got], np.int64).view(np.uint64)
    plans = []
    for m in range(1, most + 2):
        groups = group_bits(counts, n, m)
        ts, cost = allocate(sample, groups, most, n)
        if ts:
            plans.append((cost, [(mask(g), g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def linked(fps: DataFrame, most: int) -> DataFrame:
    """Edges ``(a, b)`` between different fingerprints at most ``most`` bits apart that leave the connected
    components as all such edges would.

    A fingerprint is an index row and, for thresholds above 0, probe rows in each group searched.
    Buckets with few index rows are joined, the distance being part of the join condition. The
    rest are dealt into blocks and every two blocks of a bucket are searched in one task, which
    gives only the edges of a spanning forest, so that neither memory nor output grows with the
    square of a group's size.
    """
    searched = search_plan(fps, most)
    fp = F.col("fingerprint")
    probes = []
    for i, (m, bits, t) in enumerate(searched):
        key = fp.bitwiseAND(F.lit(signed(m)))
        flips = [signed(sum(1 << (63 - b) for b in c)) for r in range(t + 1) for c in combinations(bits, r)]
        probes += [F.struct(F.lit(i).alias("part"), key.bitwiseXOR(F.lit(x)).alias("key")) for x in flips]
    index = fps.select(fp, F.explode(F.array(*[F.struct(F.lit(i).alias("part"), fp.bitwiseAND(F.lit(signed(m))).alias("key")) for i, (m, _, _) in enumerate(searched)])).alias("k")).select("k.*", "fingerprint")
    probe = fps.select(fp, F.explode(F.array(*probes)).alias("k")).select("k.*", fp.alias("probe"))
    crowded = cut(index.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED))
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("probe"))) <= most
    few = index.join(crowded, ["part", "key"], "left_anti")
    joined = few.alias("i").join(probe.alias("p"), (F.col("i.part") == F.col("p.part")) & (F.col("i.key") == F.col("p.key")) & (F.col("fingerprint") < F.col("probe")) & near)
    edges = joined.select(F.col("fingerprint").alias("a"), F.col("probe").alias("b"))
    if crowded.isEmpty():
        return edges

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        """A spanning forest of the links between the members of two blocks, breadth first."""
        left = np.unique(pdf["fingerprint"].to_numpy(np.int64)).view(np.uint64)
        a, b = [], []
        while len(left):
            front, left = left[:1], left[1:]
            while len(front) and len(left):
                hit = np.full(len(left), -1)
                for i in range(0, len(front), 64):
                    near_ = np.bitwise_count(front[i : i + 64, None] ^ left[None]) <= most
                    new = (hit < 0) & near_.any(0)
                    hit[new] = i + near_[:, new].argmax(0)
                got = hit >= 0
                a.append(front[hit[got]])
                b.append(left[got])
                front, left = left[got], left[~got]
        cat = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"a": cat(a), "b": cat(b)})

    members = index.unionByName(probe.withColumnRenamed("probe", "fingerprint")).join(crowded.drop("n"), ["part", "key"]).distinct()
    sizes = members.groupBy("part", "key").agg(F.count("*").alias("n"))
    members = members.join(sizes, ["part", "key"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.withColumn("mine", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("lo"), F.greatest("mine", o).alias("hi")))
    dealt = members.select("part", "key", "fingerprint", F.explode(both).alias("pair")).select("part", "key", "pair.*", "fingerprint")
    return edges.unionByName(dealt.groupBy("part", "key", "lo", "hi").applyInPandas(forest, "a long, b long"))


def simhash_groups(docs: DataFrame, shingle: int = 3, most: int = 2, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint, component_id``: the near-duplicate group of every row.

    Fingerprints at most ``most`` bits apart are linked; ``component_id`` is the smallest doc_id
    reachable, itself included. Equal fingerprints are one node, so copies add no pairs. Rows without a
    doc_id are grouped like others but never name a group (null if no member has an id). Null and
    empty texts have fingerprint zero and are linked like any other. An empty table gives none.
    """
    fp = cut(fingerprints(docs, shingle, seed))
    nodes = cut(fp.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    named = components(linked(nodes.select("fingerprint"), most)).withColumnRenamed("node", "fingerprint")
    roots = cut(nodes.join(named, "fingerprint", "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("root")))
    # both sides of these joins come from plain shuffles, so that a component or a fingerprint with very many rows can be split
    least = cut(roots.groupBy("root").agg(F.min("first").alias("component_id")))
    label = cut(roots.join(least, "root").select("fingerprint", "component_id"))
    out = fp.join(label, "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
