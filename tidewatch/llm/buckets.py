"""Links between the members of buckets, whatever their size: small buckets by pairs, large ones by pivots and blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import components, cut


def verified(pairs: DataFrame, payload: DataFrame, alike: Callable[[pd.Series, pd.Series], np.ndarray]) -> DataFrame:
    """The pairs ``(a, b)`` whose payloads (``node, data``) are alike."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.loc[alike(pdf["x"], pdf["y"]), ["a", "b"]]

    both = pairs.join(payload.select(F.col("node").alias("a"), F.col("data").alias("x")), "a").join(payload.select(F.col("node").alias("b"), F.col("data").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def linked(keyed: DataFrame, payload_of: Callable[[DataFrame], DataFrame], alike: Callable, forest: Callable[[pd.DataFrame], pd.DataFrame], crowded: int, block: int, fits=None, known: DataFrame | None = None) -> DataFrame:
    """``node, component`` for the nodes that are alike to others with which they share a bucket.

    ``keyed`` is ``key, node`` and what ``fits`` needs, each once; ``payload_of(nodes)`` gives ``node, data`` of the nodes
    asked for. All pairs of a bucket of up to ``crowded`` members are verified (where ``fits(n, m)`` of their columns ``n`` allows). The members of a
    larger one are held against a pivot, another in every bucket, so that members of several buckets meet several. Where that leaves more than one component, those outside of the
    bucket's most common component are searched against all its members in blocks of ``block``, a pair of blocks a task, by
    ``forest`` (``node, component, data`` to links). So no link is lost, no task or row grows with a bucket, and what is dealt grows with
    the members that no pivot links. Links ``known(a, b)`` from elsewhere count like those found, and pairs that they join already
    aren't verified. An empty table gives none.
    """
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("members"), F.min_by("node", F.xxhash64("key", "node")).alias("pivot")).where("members > 1"))
    shared = cut(keyed.join(sizes, "key"))
    few, large = shared.where(F.col("members") <= crowded), shared.where(F.col("members") > crowded)
    other = few.select("key", F.col("node").alias("b"), *([F.col("n").alias("m")] if fits else []))
    near = few.join(other, "key").where(F.col("node") < F.col("b"))
    near = near.where(fits(F.col("n"), F.col("m"))) if fits else near
    pairs = _ordered(near, "node", "b").unionByName(_ordered(large.where("node <> pivot"), "pivot", "node")).distinct()
    if known is not None:
        before = cut(components(known))
        for end in ("a", "b"):
            pairs = pairs.join(before.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
        pairs = pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct()
    payload = cut(payload_of(wanted))
    edges = verified(pairs, payload, alike)
    edges = cut(edges if known is None else edges.unionByName(known.select("a", "b")))
    named = cut(components(edges))
    inside = cut(large.select("key", "node", "members").join(named, "node", "left").withColumn("component", F.coalesce("component", "node")))
    counted = inside.groupBy("key", "component").agg(F.count("*").alias("c"))
    mixed = cut(counted.groupBy("key").agg(F.count("*").alias("kinds"), F.max_by("component", F.struct("c", "component")).alias("main"), (F.sum("c") - F.max("c")).alias("odd")).where("kinds > 1"))
    if mixed.isEmpty():
        return named
    odd = F.col("component") != F.col("main")
    blocks = inside.join(mixed, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / block)).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("odd") / block)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1))
    blocks = cut(blocks)
    asked = blocks.where(odd).select("key", F.col("own").alias("i"), every(F.col("members")).alias("j"), "node", "component")
    held = blocks.select("key", every(F.col("odd")).alias("i"), F.col("mine").alias("j"), "node", "component")
    dealt = asked.unionByName(held).join(payload, "node")
    return components(edges.unionByName(dealt.groupBy("key", "i", "j").applyInPandas(forest, "a long, b long")))
