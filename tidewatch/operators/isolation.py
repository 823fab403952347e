"""Isolation forests per cohort: trees are grown in parallel on bounded samples and kept as a table.

Nothing depends on the order of rows or sums: features become whole numbers, thresholds are whole numbers, and what is drawn at random is taken from
checksums of (cohort, tree, node). The same rows give the same trees on every run, and SQL can grow and walk them too.

Trees are grown together, a level at a time, over arrays. A feature differs within a node where the OR and the AND of its rows' codes differ, so a few
words a row tell which of all features can be split on.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.sources.storage import stored

#: Trees per cohort and rows a tree is grown on.
TREES, SAMPLE = 200, 4096
#: Steps that a unit of a feature is divided into, and the modulus of the draws.
STEPS, PRIME = 1 << 20, 2_147_483_647
#: Rows of a cohort that are scored together, so that a cohort with very many is dealt over tasks.
TOGETHER = 20_000
#: Trees that are grown together, so that a row of a small cohort is sent once for all of them.
BLOCK = 25
#: Pairs of a tree and a row that are held at once while trees are grown.
PAIRS = 200_000
TREE = "cohort string, tree int, node array<int>, feature array<short>, threshold array<long>, size array<int>"


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def quantised(name: str) -> Column:
    """A feature as a whole number of steps, the nearest; unknown values as 0, beyond a million cut there."""
    return F.floor(S.clean(F.col(name), 1e6) * float(STEPS) + 0.5).cast("long")


def drawn_by(u, tree, n, sample: int):
    """Whether a tree draws a row with the checksum ``u`` (below PRIME) of a cohort of n: so that about ``sample`` are. For columns and for arrays."""
    times = (48_271 * (tree + 1)) % PRIME + 1
    return ((u * times + 12_345 * (tree + 1)) % PRIME) * (n * 1.0) < float(sample) * PRIME


#: Constants of MD5: additions, and rotations by round.
ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
#: Checksums that are made together; below the second number they are made one by one.
SUMS, FEW = 16_384, 100


def node_draw(cohort: str, tree: int, node: int, seed: int) -> tuple[int, int]:
    """Two numbers below 2 ** 60 for a node: for the choice of its feature and of its threshold."""
    digest = hashlib.md5(f"{seed}|{cohort}|{tree}|{node}".encode()).hexdigest()
    return int(digest[:15], 16), int(digest[16:31], 16)


def node_draws(cohort: str, trees: np.ndarray, nodes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``node_draw`` of many nodes: MD5 over arrays, since texts of so few bytes are one block each."""
    last = int(trees.max(initial=0))
    begins = [f"{seed}|{cohort}|{t}|".encode() for t in range(last + 1)]
    if len(trees) < FEW or len(begins[-1]) + 10 > 55:
        out = np.array([node_draw(cohort, t, n, seed) for t, n in zip(trees.tolist(), nodes.tolist())], np.uint64).reshape(-1, 2)
        return out[:, 0], out[:, 1]
    table = np.frombuffer(b"".join(x.ljust(64, b"\0") for x in begins), np.uint8).reshape(-1, 64)
    length, out = np.array([len(x) for x in begins]), []
    for k in range(0, len(trees), SUMS):
        tree, node = trees[k : k + SUMS], nodes[k : k + SUMS]
        text, digits = table[tree], np.searchsorted(10 ** np.arange(1, 10), node, "right") + 1
        flat, at, most = text.reshape(-1), np.arange(len(tree)) * 64 + length[tree], int(digits.max())
        for j in range(most):
            has = digits > j
            flat[at[has] + j] = 48 + node[has] // 10 ** (digits[has] - 1 - j) % 10
        flat[at + digits] = 128
        words = np.ascontiguousarray(text.view("<u4").T)
        words[14] = 8 * (length[tree] + digits)
        out.append(_md5(words, -(-(len(begins[-1]) + most + 1) // 4)))
    a, b, c, d = (np.concatenate(x).byteswap().astype(np.uint64) for x in zip(*out))
    four, half = np.uint64(4), np.uint64(32)
    return (a << half | b) >> four, (c << half | d) >> four


def _md5(words: np.ndarray, used: int) -> tuple[np.ndarray, ...]:
    """The state after one block, of which only the first ``used`` words and the length are not 0."""
    begin = [np.full(words.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = begin
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32(ADDED[i])
        if g < used or g == 14:
            f += words[g]
        turn = TURNS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
    return tuple(x + y for x, y in zip(begin, (a, b, c, d)))


class Trees(NamedTuple):
    """Nodes of several trees as arrays. ``child``: the place of a node's left child, the right one follows; a leaf's is its own."""

    tree: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    size: np.ndarray
    child: np.ndarray
    depth: np.ndarray


def _coded(x: np.ndarray) -> tuple[list[np.ndarray], list[tuple[int, int, np.uint64]]]:
    """Words that hold the rows' values by their order, as many bits for a feature as it needs; and (feature, word, mask) of those that differ at all."""
    words, places, free = [], [], 0
    for i in range(x.shape[1]):
        values, code = np.unique(x[:, i], return_inverse=True)
        bits = (len(values) - 1).bit_length()
        if not bits:
            continue
        if bits > free:
            words.append(np.zeros(len(x), np.uint64))
            free = 64
        free -= bits
        words[-1] |= code.astype(np.uint64) << np.uint64(free)
        places.append((i, len(words) - 1, np.uint64(((1 << bits) - 1) << free)))
    return words, places


def grown(x: np.ndarray, u: np.ndarray, n: int, cohort: str, trees: range, sample: int, seed: int) -> Iterator[Trees]:
    """Trees over the rows ``x`` (whole numbers) with checksums ``u`` of a cohort of n, as many together as PAIRS allows."""
    words, places = _coded(x)
    columns, flat = np.array([p[0] for p in places], np.int64), np.ascontiguousarray(x).reshape(-1)
    together = max(1, PAIRS // max(1, min(len(x), 2 * sample)))
    for first in range(trees.start, trees.stop, together):
        named = np.arange(first, min(first + together, trees.stop))
        of, row = np.nonzero(np.stack([drawn_by(u, int(t), n, sample) for t in named]))
        sizes = np.bincount(of, minlength=len(named))
        limit = np.frexp(np.maximum(2, sizes) - 1)[1]
        tree = np.flatnonzero(sizes)
        node, sizes, base, depth, out = np.ones(len(tree), np.int64), sizes[tree], 0, 0, []
        while len(tree):
            start = np.cumsum(sizes) - sizes
            differ = []
            for w in words:
                code = w[row]
                differ.append(np.bitwise_or.reduceat(code, start) ^ np.bitwise_and.reduceat(code, start))
            able = np.stack([(differ[k] & mask) != 0 for _, k, mask in places], 1) if places else np.zeros((len(tree), 1), bool)
            count = able.sum(1)
            splits = (count > 0) & (depth < limit[tree])
            split = np.flatnonzero(splits)
            feature, threshold, child = np.full(len(tree), -1), np.zeros(len(tree), np.int64), base + np.arange(len(tree))
            base += len(tree)
            level = (named[tree], node, feature, threshold, sizes, child, np.full(len(tree), depth))
            if len(split):
                which, where = node_draws(cohort, named[tree[split]], node[split], seed)
                nth = (which % count[split].astype(np.uint64)).astype(np.int64)
                chosen = columns[(able[split].cumsum(1, dtype=np.int16) > nth[:, None]).argmax(1)]
                row, sizes = row[np.repeat(splits, sizes)], sizes[split]
                start, at = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(split)), sizes)
                value = flat[row * x.shape[1] + chosen[at]]
                lo, hi = np.minimum.reduceat(value, start), np.maximum.reduceat(value, start)
                bound = lo + (where % (hi - lo).astype(np.uint64)).astype(np.int64)
                left = value <= bound[at]
                # a node's rows that go left come first, all in their order
                upto = np.cumsum(left)
                lefts = upto - left - (upto[start] - left[start])[at]
                n_left = np.add.reduceat(left.astype(np.int64), start)
                place = np.where(left, start[at] + lefts, np.arange(len(row)) + n_left[at] - lefts)
                moved = np.empty_like(row)
                moved[place] = row
                row = moved
                feature[split], threshold[split], child[split] = chosen, bound, base + 2 * np.arange(len(split))
                sizes = np.stack([n_left, sizes - n_left], 1).reshape(-1)
                tree, node = np.repeat(tree[split], 2), np.stack([2 * node[split], 2 * node[split] + 1], 1).reshape(-1)
            else:
                tree = tree[:0]
            out.append(level)
            depth += 1
        yield Trees(*map(np.concatenate, zip(*out))) if out else Trees(*[np.zeros(0, np.int64)] * 7)


def walked(x: np.ndarray, t: Trees) -> np.ndarray:
    """The sum of every row's path lengths down the trees, those within leaves as expected."""
    flat, begin, total = np.ascontiguousarray(x).reshape(-1), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
    leaf = t.feature < 0
    feature, threshold, value = np.where(leaf, 0, t.feature), np.where(leaf, np.iinfo(np.int64).max, t.threshold), t.depth + average_path(t.size)
    deepest = np.zeros(int(t.tree.max(initial=-1)) + 1, np.int64)
    np.maximum.at(deepest, t.tree, t.depth)
    for r in np.flatnonzero(t.node == 1):
        at = np.full(len(x), r)
        for _ in range(deepest[t.tree[r]]):
            at = t.child[at] + (flat[begin + feature[at]] > threshold[at])
        total += value[at]
    return total


def _anomaly(total: np.ndarray, roots: np.ndarray) -> np.ndarray:
    return 2.0 ** (-total / len(roots) / max(float(average_path(np.array(roots.mean()))), 1e-9))


def _numbers(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Columns of whole numbers as a matrix, a row a row."""
    return np.stack([table.column(n).to_numpy() for n in names], 1) if names else np.zeros((len(table), 0), np.int64)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the keys to as many tasks as there are shuffle partitions, few bytes or not: growing and walking trees takes time, not room."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _checked(rows: DataFrame, names: tuple[str, ...], *more: str) -> DataFrame:
    """Rows with whole numbers for features and the checksum ``_u`` that trees draw by."""
    check = F.conv(F.substring(F.md5("event_id"), 1, 15), 16, 10).cast("long") % PRIME
    return rows.select("cohort", *more, check.alias("_u"), *[quantised(n).alias(n) for n in names])


def _by_block(train: DataFrame, names: tuple[str, ...], trees: int, sample: int) -> DataFrame:
    """Rows of a cohort at each block of trees that draws them: what one task grows BLOCK trees on is bounded whatever the cohort's size."""
    counts = train.groupBy("cohort").agg(F.count("*").alias("_n"))
    rows = _checked(train, names).join(counts, "cohort")
    of = lambda b: F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, F.lit(trees)).cast("long") - 1)
    own = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(-(-trees // BLOCK) - 1).cast("long")), lambda b: F.exists(of(b), lambda t: drawn_by(F.col("_u"), t, F.col("_n"), sample)))
    # a cohort that every tree draws whole is sent once
    whole = F.array(F.lit(-1).cast("long"))
    drawn = rows.withColumn("block", F.explode(F.when(F.col("_n") <= sample, whole).otherwise(own)))
    return spread(drawn, "cohort", "block").groupBy("cohort", "block")


def _grown(table: pa.Table, names: tuple[str, ...], trees: int, sample: int, seed: int) -> Iterator[Trees]:
    """The trees of a group of ``_by_block``."""
    block = table.column("block")[0].as_py()
    some = range(trees) if block < 0 else range(block * BLOCK, min((block + 1) * BLOCK, trees))
    return grown(_numbers(table, names), table.column("_u").to_numpy(), table.column("_n")[0].as_py(), table.column("cohort")[0].as_py(), some, sample, seed)


def grow(train: DataFrame, names: tuple[str, ...], trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """The forest as a table, a row a tree (TREE) with its nodes in the order of their numbers; node i has the children 2 i and 2 i + 1, a leaf the feature -1.

    Every tree draws its rows by a checksum of row and tree, about ``sample`` of them. A node splits on one of the features that differ within it, at a
    threshold from its least value to below its largest, so no side is empty.
    """

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for t in _grown(table, names, trees, sample, seed):
            order = np.lexsort((t.node, t.tree))
            tree, begins = np.unique(t.tree[order], return_index=True)
            ends = pa.array(np.append(begins, len(order)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[order].astype(k))) for v, k in ((t.node, np.int32), (t.feature, np.int16), (t.threshold, np.int64), (t.size, np.int32))]
            parts.append(pa.table([pa.array([table.column("cohort")[0].as_py()] * len(tree), pa.string()), pa.array(tree.astype(np.int32)), *lists], ["cohort", "tree", "node", "feature", "threshold", "size"]))
        return pa.concat_tables(parts)

    return _by_block(train, names, trees, sample).applyInArrow(run, TREE)


def fit(train: DataFrame, names: tuple[str, ...], trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """The forest of ``grow``, a row per node (feature -1: leaf)."""
    nodes = grow(train, names, trees, sample, seed).select("cohort", "tree", F.explode(F.arrays_zip("node", "feature", "threshold", "size")).alias("x"))
    child = lambda k: F.when(F.col("x.feature") < 0, -1).otherwise(2 * F.col("x.node") + k).cast("int")
    return nodes.select("cohort", "tree", "x.node", F.col("x.feature").cast("int").alias("feature"), "x.threshold", child(0).alias("left"), child(1).alias("right"), F.col("x.size").cast("long").alias("size"))


def by_tree(forest: DataFrame) -> DataFrame:
    """A forest with a row a tree, given so or with a row a node."""
    if dict(forest.dtypes)["node"].startswith("array"):
        return forest.select("cohort", "tree", "feature", "threshold", "size")
    nodes = forest.groupBy("cohort", "tree").agg(F.array_sort(F.collect_list(F.struct("node", "feature", "threshold", "size"))).alias("x"))
    return nodes.select("cohort", "tree", *[F.col(f"x.{n}").cast(f"array<{t}>").alias(n) for n, t in (("feature", "short"), ("threshold", "long"), ("size", "int"))])


def _listed(table: pa.Table) -> Trees:
    """Trees from their rows. In the order of numbers the children of the kth node that splits are the nodes 2 k + 1 and 2 k + 2 of the tree, counted from 0."""
    of = {n: table.column(n).combine_chunks() for n in ("feature", "threshold", "size")}
    ends = np.append(0, np.cumsum(of["feature"].value_lengths().to_numpy()))
    feature, threshold, size = (x.flatten().to_numpy() for x in of.values())
    tree = np.repeat(np.arange(len(table)), np.diff(ends))
    root, place, splits = ends[:-1][tree], np.arange(len(tree)), feature >= 0
    nth = np.cumsum(splits) - splits
    child = np.where(splits, root + 1 + 2 * (nth - nth[ends[:-1]][tree]), place)
    node, depth = (place == root).astype(np.int64), np.zeros(len(tree), np.int64)
    k = ends[:-1]
    while len(k := k[splits[k]]):
        depth[child[k]] = depth[child[k] + 1] = depth[k] + 1
        k = np.concatenate([child[k], child[k] + 1])
    return Trees(tree, node, feature, threshold, size, child, depth)


def path_scores(rows: DataFrame, forest: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``event_id, cohort, anomaly``: 2 ** (-mean path / expected path); null for cohorts without a forest.

    Rows meet their cohort's forest in groups of about TOGETHER rows; a forest's size is bounded (trees x about 2 x
    sample nodes), and it is sent once a group, not to every task.
    """
    parts = rows.groupBy("cohort").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_parts"))
    salted = rows.select("event_id", "cohort", *[quantised(n).alias(n) for n in names]).join(parts, "cohort")
    salted = salted.withColumn("_part", F.pmod(F.xxhash64("event_id"), F.col("_parts")).cast("int")).drop("_parts")
    trees = by_tree(forest).join(parts, "cohort").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def run(some: pa.Table, table: pa.Table) -> pa.Table:
        score = pa.nulls(len(some), pa.float64())
        if len(some) and len(table):
            t = _listed(table)
            score = pa.array(_anomaly(walked(_numbers(some, names), t), t.size[t.node == 1]))
        return pa.table([some.column("event_id"), some.column("cohort"), score], ["event_id", "cohort", "anomaly"])

    return spread(salted, "cohort", "_part").groupBy("cohort", "_part").cogroup(spread(trees, "cohort", "_part").groupBy("cohort", "_part")).applyInArrow(run, "event_id string, cohort string, anomaly double")


def fitted_scores(rows: DataFrame, fits: str, names: tuple[str, ...], trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """``event_id, cohort, fits, anomaly`` as ``path_scores`` gives it for a forest grown on the rows for which ``fits`` is true.

    A forest has many more nodes than a small cohort has rows. So a cohort of at most TOGETHER rows grows its trees and sends all its rows down them in one task, and
    they are kept nowhere; the others go by a table.
    """
    rows = rows.select("event_id", "cohort", F.col(fits).alias("fits"), *names)
    counts = stored(rows.groupBy("cohort").agg(F.count("*").alias("_all"), F.sum(F.col("fits").cast("long")).alias("_n")), "counts")
    few = _checked(rows, names, "event_id", "fits").join(counts.where(F.col("_all") <= TOGETHER).select("cohort", "_n"), "cohort")

    def run(table: pa.Table) -> pa.Table:
        x, fits = _numbers(table, names), table.column("fits").to_numpy()
        n, total, roots = int(fits.sum()), np.zeros(len(x)), [np.zeros(0, np.int64)]
        if n:
            for t in grown(x[fits], table.column("_u").to_numpy()[fits], n, table.column("cohort")[0].as_py(), range(trees), sample, seed):
                total += walked(x, t)
                roots.append(t.size[t.node == 1])
        roots = np.concatenate(roots)
        return pa.table([table.column("event_id"), table.column("cohort"), table.column("fits"), pa.array(_anomaly(total, roots)) if len(roots) else pa.nulls(len(x), pa.float64())], ["event_id", "cohort", "fits", "anomaly"])

    out = spread(few, "cohort").groupBy("cohort").applyInArrow(run, "event_id string, cohort string, fits boolean, anomaly double")
    large = counts.where(F.col("_all") > TOGETHER).select("cohort")
    if large.isEmpty():
        return out
    many = rows.join(large, "cohort", "left_semi")
    paths = path_scores(many, stored(grow(many.where("fits"), names, trees, sample, seed), "forest"), names)
    return out.unionByName(paths.join(many.select("event_id", "fits"), "event_id"))


def on_unit(anomalies: DataFrame, span: DataFrame) -> DataFrame:
    """``event_id, isolation``: anomaly put on 0 to 1 by the cohort's range ``cohort, _lo, _hi``; 0.5 for unseen cohorts."""
    out = anomalies.join(span, "cohort", "left")
    unit = F.when(F.col("anomaly").isNull(), F.lit(None)).when(F.col("_hi") - F.col("_lo") < 1e-12, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("anomaly") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))))
    return out.select("event_id", F.round(F.coalesce(unit, F.lit(0.5)), 9).alias("isolation"))


def span_of(train_scores: DataFrame) -> DataFrame:
    return train_scores.groupBy("cohort").agg(F.min("anomaly").alias("_lo"), F.max("anomaly").alias("_hi"))


def isolation_scores(rows: DataFrame, forest: DataFrame, train_scores: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``event_id, isolation``: anomaly put on 0 to 1 by the cohort's training range; 0.5 for unseen cohorts."""
    return on_unit(path_scores(rows, forest, names), span_of(train_scores))


def split_counts(train: DataFrame, names: tuple[str, ...], trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """``cohort, feature, n``: how many nodes of a cohort's forest split on each feature (-1: leaves), of trees that are kept nowhere."""

    def run(table: pa.Table) -> pa.Table:
        n = sum((np.bincount(t.feature + 1, minlength=len(names) + 1) for t in _grown(table, names, trees, sample, seed)), np.zeros(len(names) + 1, np.int64))
        return pa.table([pa.array([table.column("cohort")[0].as_py()] * len(n), pa.string()), pa.array(np.arange(-1, len(names), dtype=np.int32)), pa.array(n.astype(np.int64))], ["cohort", "feature", "n"])

    return _by_block(train, names, trees, sample).applyInArrow(run, "cohort string, feature int, n long").groupBy("cohort", "feature").agg(F.sum("n").alias("n"))


def importances(forest: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``cohort, feature, importance``: share of a cohort's splits on each feature; even where there are none. From a forest or from ``split_counts``."""
    if "n" in forest.columns:
        per = forest
    else:
        nodes = forest.select("cohort", F.explode(F.col("feature").cast("array<int>")).alias("feature")) if dict(forest.dtypes)["node"].startswith("array") else forest
        per = nodes.groupBy("cohort", "feature").agg(F.count("*").alias("n"))
    total = per.groupBy("cohort").agg(F.sum(F.when(F.col("feature") >= 0, F.col("n")).otherwise(0)).alias("t"))
    grid = total.select("cohort", "t", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("feature", "name"))
    out = grid.join(per, ["cohort", "feature"], "left")
    return out.select("cohort", F.col("name").alias("feature"), F.when(F.col("t") > 0, F.coalesce("n", F.lit(0)) / F.col("t")).otherwise(1 / len(names)).alias("importance"))
