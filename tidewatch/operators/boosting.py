"""Gradient-boosted trees on histogram bins, one class against the rest, kept as a table.

Features are whole numbers as in ``isolation``, gains are compared rounded and ties fall to the first feature and bin, so the same rows give the same trees.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.isolation import PRIME, drawn_by, quantised

#: Rounds, learning rate and depth.
ROUNDS, RATE, DEPTH = 300, 0.08, 6
#: Rows a class is learned from at most (drawn by checksum), bins of a feature, rows of a leaf at least, and what is added to curvatures.
PER_CLASS, BINS, LEAST, RIDGE = 5_000, 64, 5, 1.0
NODE = "class string, tree int, node int, feature int, threshold long, value double"


def binned(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bins of each column (a value is in the bin of the first edge that is not below it), and the edges: values of the column, evenly by rank."""
    edges = []
    for col in x.T:
        values = np.unique(col)
        if len(values) > BINS:
            values = np.unique(np.sort(col)[np.linspace(0, len(col) - 1, BINS).astype(int)])
        edges.append(values[:-1])
    return np.stack([np.searchsorted(e, col) for e, col in zip(edges, x.T)], 1), edges


def grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> tuple[list[tuple], np.ndarray]:
    """One tree on gradients and curvatures: nodes (node, feature, threshold, value), node i with children 2 i and 2 i + 1, feature -1 for leaves; and the value of each row."""
    n, width = bins.shape
    at, out, value, live = np.ones(n, np.int64), [], np.zeros(n), np.arange(n)
    columns = np.ascontiguousarray(bins.T)  # counted feature by feature, which keeps what is read at once small
    for level in range(depth + 1):
        nodes, own = np.unique(at[live], return_inverse=True)
        if not len(nodes):
            break
        first, own_g, own_h, hist = own * BINS, g[live], h[live], np.zeros((3, width, len(nodes) * BINS))
        for f in range(width if level < depth else 1):  # leaves need totals alone
            cell = first + (columns[f] if len(live) == n else columns[f][live])
            for k, v in enumerate((own_g, own_h, None)):
                hist[k, f] = np.bincount(cell, v, len(nodes) * BINS)
        hist = hist.reshape(3, width, len(nodes), BINS).transpose(0, 2, 1, 3).cumsum(3)
        (gl, hl, nl), (gt, ht, nt) = hist, [v[:, :1, -1:] for v in hist]
        gain = gl * gl / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt * gt / (ht + RIDGE)
        fine = (nl >= LEAST) & (nt - nl >= LEAST) & (level < depth)
        gain = np.where(fine, np.round(gain, 9), 0.0).reshape(len(nodes), -1)
        best = gain.argmax(1)
        split = gain[np.arange(len(nodes)), best] > 1e-7
        feature, edge = best // BINS, best % BINS
        leaf = np.round(rate * gt[:, 0, 0] / (ht[:, 0, 0] + RIDGE), 9)
        for i, node in enumerate(nodes.tolist()):
            out.append((node, int(feature[i]), int(edges[feature[i]][edge[i]]), 0.0) if split[i] else (node, -1, 0, float(leaf[i])))
        done = ~split[own]
        value[live[done]] = leaf[own[done]]
        live, own = live[~done], own[~done]
        at[live] = 2 * at[live] + (bins[live, feature[own]] > edge[own])
    return out, value


def fit(rows: DataFrame, label: str, names: tuple[str, ...], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, per_class: int = PER_CLASS) -> DataFrame | None:
    """Trees per class as a table, a row per node; tree -1 is what scores start from. None if there are fewer than two classes (``rows`` without a label don't count).

    Classes weigh the same. Each class is learned from at most about ``per_class`` rows, drawn by a checksum of the event id, by a task of its own, so what a task
    holds is bounded by (classes x per_class).
    """
    known = rows.where(F.col(label).isNotNull())
    counts = known.groupBy(F.col(label).alias("own")).agg(F.count("*").alias("_n"))
    classes = sorted(r["own"] for r in counts.select("own").collect())  # a label is one of a few attacks
    if len(classes) < 2:
        return None
    check = F.conv(F.substring(F.md5("event_id"), 1, 15), 16, 10).cast("long") % PRIME
    drawn = known.select("event_id", F.col(label).alias("own"), check.alias("_u"), *[quantised(n).alias(n) for n in names]).join(counts, "own").where(drawn_by(F.col("_u"), F.lit(0).cast("long"), F.col("_n"), per_class))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id")
        name = pdf["class"].iloc[0]
        x, own = pdf[list(names)].to_numpy(np.int64), pdf["own"].to_numpy()
        bins, edges = binned(x)
        kinds, which = np.unique(own, return_inverse=True)
        weight = (len(own) / len(kinds) / np.bincount(which))[which]
        y = (own == name).astype(float)
        share = float((weight * y).sum() / weight.sum())
        start = round(float(np.log(share / (1 - share))), 9) if 0 < share < 1 else 0.0
        out, score = [(-1, 1, -1, 0, start)], np.full(len(y), start)
        for t in range(rounds):
            p = 1 / (1 + np.exp(-score))
            nodes, value = grow(bins, edges, weight * (y - p), weight * p * (1 - p), depth, rate)
            out += [(t, *node) for node in nodes]
            score += value
        made = pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "value"])
        made.insert(0, "class", name)
        return made

    # by ranges, since of hashes of so few classes several would meet in a task
    each = drawn.withColumn("class", F.explode(F.array(*[F.lit(k) for k in classes]))).repartitionByRange(len(classes), "class")
    return each.groupBy("class").applyInPandas(run, NODE)


def predict(trees: DataFrame, names: tuple[str, ...]) -> Column:
    """Struct ``attack_type, confidence``: the class whose trees score highest (ties: the first by name), and its probability among all classes'.

    The trees are collected: their number is (classes x rounds), their size bounded by the depth.
    """
    table = trees.toPandas()
    classes = sorted(table["class"].unique())
    keys, tree = np.unique(table["class"].map(classes.index).to_numpy(np.int64) * 100_000 + table["tree"].to_numpy(np.int64) + 1, return_inverse=True)
    depth = int(table["node"].max()).bit_length() - 1
    # different tests (feature, threshold), the last of which no row passes; trees are filled up with it to the same depth
    splits = table["feature"].to_numpy() >= 0
    tests, which = np.unique(table.loc[splits, ["feature", "threshold"]].to_numpy(np.int64).reshape(-1, 2), axis=0, return_inverse=True)
    test, value = np.full((len(keys), 1 << depth), len(tests)), np.zeros((len(keys), 2 << depth))
    node = table["node"].to_numpy()
    test[tree[splits], node[splits]] = which.reshape(-1)
    leaf = np.zeros((len(keys), 2 << depth), bool)
    leaf[tree[~splits], node[~splits]] = True
    value[tree[~splits], node[~splits]] = table["value"].to_numpy()[~splits]
    for i in range(1, 1 << depth):  # what lies below a leaf has its value
        for below in (2 * i, 2 * i + 1):
            value[:, below] = np.where(leaf[:, i], value[:, i], value[:, below])
            leaf[:, below] |= leaf[:, i]
    owner = keys // 100_000

    @F.pandas_udf("attack_type string, confidence double")
    def run(*columns: pd.Series) -> pd.DataFrame:
        """All tests of all rows as bits, 64 rows a word; a tree then picks, level by level, the bit of the node that a row is at."""
        n, score = len(columns[0]), np.zeros((len(columns[0]), len(classes)))
        passed = np.zeros((len(tests) + 1, -(-n // 64) * 8), np.uint8)
        x = [s.to_numpy(np.int64) for s in columns]
        for k, (f, t) in enumerate(tests.tolist()):
            passed[k, : -(-n // 8)] = np.packbits(x[f] > t)
        passed = passed.view(np.uint64)
        for k in range(len(keys)):
            turns, at = [], np.zeros(n, np.int64)
            for level in range(depth):
                bits = passed[test[k, 1 << level : 2 << level]]
                for turn in reversed(turns):
                    bits = bits[0::2] ^ ((bits[0::2] ^ bits[1::2]) & turn)
                turns.append(bits[0])
                at = 2 * at + np.unpackbits(bits[0].view(np.uint8), count=n)
            score[:, owner[k]] += value[k, (1 << depth) + at]
        p = 1 / (1 + np.exp(-score))
        best = np.round(score, 6).argmax(1)
        return pd.DataFrame({"attack_type": np.array(classes, object)[best], "confidence": p[np.arange(n), best] / p.sum(1)})

    return run(*[quantised(n) for n in names])
