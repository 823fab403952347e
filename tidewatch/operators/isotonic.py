"""Isotonic regression by pooling adjacent violators over ranges of values, kept as a table of blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import tables as T
from tidewatch.sources.storage import stored

#: Ranges that are merged into one in a round.
FAN = 8
BLOCK = "part int, lo double, hi double, y double, w double"


def pool(pdf: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks pooled until their means rise. What is pooled here stays pooled whatever blocks come beside it, so ranges can be pooled
    on their own first."""
    out: list[list[float]] = []
    for row in pdf.sort_values("lo")[["lo", "hi", "y", "w"]].to_numpy().tolist():
        out.append(row)
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, hi, y, w = out.pop()
            out[-1][1:] = [hi, out[-1][2] + y, out[-1][3] + w]
    made = pd.DataFrame(out, columns=["lo", "hi", "y", "w"])
    made.insert(0, "part", int(pdf["part"].iloc[0]))
    return made


def fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Blocks ``number, lo, hi, value, next_lo, next_value`` of the rising step function nearest to y (0 to 1) on x in squares; ``number`` counts from 1.

    Rows are counted by value of x first. Values are dealt by ranges and pooled within each; blocks of FAN ranges are pooled together round by round. Rows without x or y don't
    count; without any the table is empty.
    """
    per = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("lo")).agg(F.sum(F.col(y).cast("double")).alias("y"), F.count("*").cast("double").alias("w"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(per.repartitionByRange(n, "lo").select(F.spark_partition_id().alias("part"), "lo", F.col("lo").alias("hi"), "y", "w"), "isotonic")
    blocks = blocks.groupBy("part").applyInPandas(pool, BLOCK)
    while n > 1:
        n = -(-n // FAN)
        blocks = stored(blocks, "isotonic").withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part").applyInPandas(pool, BLOCK)

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo", ignore_index=True)
        value = pdf["y"] / pdf["w"]
        return pd.DataFrame({"number": pdf.index + 1, "lo": pdf["lo"], "hi": pdf["hi"], "value": value, "next_lo": pdf["lo"].shift(-1), "next_value": value.shift(-1)})

    return blocks.groupBy("part").applyInPandas(numbered, "number long, lo double, hi double, value double, next_lo double, next_value double")


def predict(rows: DataFrame, blocks: DataFrame, x: str, name: str) -> DataFrame:
    """Adds ``name``: a block's value within it, between blocks what lies on the line from one to the next, beyond the ends the end's. Null x gives null.

    How many blocks begin at or below a value is a running count over ranges of the different values and the blocks together, so there is no range join.
    """
    blocks = stored(blocks, "blocks")
    values = rows.select(F.col(x).cast("double").alias("_x")).where("_x IS NOT NULL").distinct().withColumn("_c", F.lit(0).cast("long"))
    both = values.unionByName(blocks.select(F.col("lo").alias("_x"), F.lit(1).cast("long").alias("_c"))).groupBy("_x").agg(F.sum("_c").alias("_c"))
    found = T.with_running(both, "_x", {"number": "_c"}).select("_x", F.greatest("number", F.lit(1)).alias("number")).join(blocks, "number")
    share = (F.col("_x") - F.col("hi")) / (F.col("next_lo") - F.col("hi"))
    on_line = F.col("value") + (F.col("next_value") - F.col("value")) * share
    found = found.select("_x", F.when((F.col("_x") > F.col("hi")) & F.col("next_lo").isNotNull(), on_line).otherwise(F.col("value")).alias(name))
    return rows.withColumn("_x", F.col(x).cast("double")).join(found, "_x", "left").drop("_x")
