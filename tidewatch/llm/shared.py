"""Helpers that several training-data operators use: shared storage, row identity, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.storage import new_folder, shared_dir, stored

__all__ = ["bit_map", "components", "cut", "marked", "new_folder", "parts", "shared_dir", "stored"]

#: Bits of a bit map: at most SLOTS / 64 rows of two numbers, whatever it is made from.
SLOTS = 1 << 25


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that the lineage ends there. Joins with the table are merges of plain shuffles at
    every size, so that hot keys can be split and plans don't change as tables grow."""
    return stored(df, "cut").hint("merge")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bit_map(df: DataFrame, column: str) -> DataFrame:
    """A table of SLOTS bits, those of the values of a long column set."""
    slot = F.pmod(F.col(column), F.lit(SLOTS))
    bits = df.groupBy(F.floor(slot / 64).cast("int").alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")).alias("_bits"))
    return stored(bits, "bits")


def marked(df: DataFrame, column: str, bits: DataFrame, name: str) -> DataFrame:
    """Adds whether a value may be among those of a bit map: true for all that are, and for some more as the map fills. Broadcast, as its size is bounded."""
    word = F.floor(F.pmod(F.col(column), F.lit(SLOTS)) / 64).cast("int")
    out = df.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    return out.withColumn(name, F.coalesce(F.getbit("_bits", F.pmod(F.col(column), F.lit(64)).cast("int")) == 1, F.lit(False))).drop("_word", "_bits")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, component)`` per node of an edge,
    ``component`` the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). A round is a map-side
    combined minimum per node and a join back, so a node with very many neighbours is dealt over
    tasks by the skew join; its neighbours are never gathered. Each round is checkpointed.
    Null ends are ignored; an empty table gives an empty result.
    """
    cur = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are materialised, so that both sides of the join come from plain shuffles and a hot node can be split
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m")))
        # large star: each neighbour above u points to the least of u and its neighbours
        large = cut(both.join(low, both.a == low.u).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        # small star: u and its lower neighbours point to the least of these
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"))
        small = large.join(low, large.a == low.u).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        cur = cut(small.where("a <> b").distinct())
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = cur.select("b").distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
