"""Past-only window operators over entity event streams.

Events have a total order ``(ts_us, event_id)``; "past" is what comes strictly before. All take and return
Columns, so plans stay within Catalyst; windows whose keys begin alike share one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.sources.storage import stored

ORDER = ("ts_us", "event_id")
US = 1_000_000
#: Widths of buckets of time: for keys of many rows, and for all rows together.
HOUR_US, MINUTE_US = 3600 * US, 60 * US
#: Time constants in a block of the exponentially weighted mean.
BLOCK = 500


def past(*keys: str | Column, order: tuple[str, ...] = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def upto(*keys: str | Column, order: tuple[str, ...] = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def ordered(*keys: str | Column, order: tuple[str, ...] = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def past_count(*keys: str | Column, where: Column | None = None) -> Column:
    """Rows before this one; 0 for the first."""
    if where is None:
        return (F.row_number().over(ordered(*keys)) - 1).cast("long")
    return F.coalesce(F.sum(where.cast("long")).over(past(*keys)), F.lit(0)).cast("long")


def past_sum(value: Column, *keys: str | Column) -> Column:
    return F.coalesce(F.sum(value).over(past(*keys)), F.lit(0))


def rolling_sum(value: Column, seconds: int, *keys: str | Column) -> Column:
    """Sum over rows before this one in the last ``seconds``, the far bound included.

    The running sum of all rows before, less that of rows older than the window. A plain range frame
    would count the row itself and later rows of the same time.
    """
    old = Window.partitionBy(*keys).orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -(seconds * US + 1))
    return past_sum(value, *keys) - F.coalesce(F.sum(value).over(old), F.lit(0))


def rolling_count(seconds: int, *keys: str | Column, where: Column | None = None) -> Column:
    return rolling_sum(F.lit(1) if where is None else where.cast("long"), seconds, *keys).cast("long")


def first_touch(*keys_and_value: str | Column) -> Column:
    """Whether this is the first row of its (key, value): 1 or 0."""
    return (F.row_number().over(ordered(*keys_and_value)) == 1).cast("int")


def running_distinct(first: str | Column, *keys: str | Column) -> Column:
    """Different values before this row, from a first-touch column."""
    return past_sum(F.col(first) if isinstance(first, str) else first, *keys).cast("long")


def with_run_length(df: DataFrame, fail: Column, name: str, *keys: str, including: bool = False) -> DataFrame:
    """Adds the length of the run of ``fail`` rows before each row (or up to and with it)."""
    counted = df.withColumn("_upto", F.sum(fail.cast("long")).over(upto(*keys)))
    at_reset = F.max(F.when(~fail, F.col("_upto")))
    if including:
        out = F.col("_upto") - F.coalesce(at_reset.over(upto(*keys)), F.lit(0))
    else:
        out = (F.col("_upto") - fail.cast("long")) - F.coalesce(at_reset.over(past(*keys)), F.lit(0))
    return counted.withColumn(name, out.cast("long")).drop("_upto")


def gap_seconds(*keys: str) -> Column:
    """Seconds since the row before; null for the first."""
    return (F.col("ts_us") - F.lag("ts_us").over(ordered(*keys))) / F.lit(float(US))


def with_gap_statistics(df: DataFrame, *keys: str) -> DataFrame:
    """Adds ``gap`` and, over the gaps before it, ``gap_n, gap_mean, gap_std`` (population)."""
    out = df.withColumn("gap", gap_seconds(*keys))
    w = past(*keys)
    return out.withColumns({"gap_n": F.count("gap").over(w), "gap_mean": F.avg("gap").over(w), "gap_std": F.stddev_pop("gap").over(w)})


def with_ewma(df: DataFrame, value: str, name: str, half_life_days: float, *keys: str, order: tuple[str, ...] = ORDER, compat: bool = False) -> DataFrame:
    """Adds the exponentially weighted mean up to and with each row; weight by elapsed time plus a second.

    Running sums in closed form, within blocks of time of BLOCK time constants (so that no weight overflows) and with what the
    block before left, decayed; what is older has decayed to nothing. ``compat``: every step counts as one second.
    """
    rate = 0.6931471805599453 / (half_life_days * 86400)
    n = F.row_number().over(ordered(*keys, order=order))
    first = F.first("ts_us").over(Window.partitionBy(*keys).orderBy(*order))
    tau = (F.lit(0.0) if compat else (F.col("ts_us") - first) / F.lit(float(US))) + n
    out = df.withColumn("_tau", tau).withColumn("_block", F.floor(F.col("_tau") * (rate / BLOCK)))
    step = F.col("_tau") - F.lag("_tau").over(ordered(*keys, order=order))
    weight = F.when(step.isNull(), 1.0).otherwise(1 - F.exp(-rate * step))
    since = rate * F.col("_tau") - BLOCK * F.col("_block")
    out = out.withColumn("_w", weight * F.col(value) * F.exp(since))
    out = out.withColumn("_own", F.exp(-since) * F.sum("_w").over(upto(*keys, "_block", order=order)))
    was = F.lag(F.struct("_own", "_tau", "_block")).over(ordered(*keys, order=order))
    out = out.withColumn("_was", was).withColumn("_left", F.first("_was").over(upto(*keys, "_block", order=order)))
    carried = F.when(F.col("_left._block") == F.col("_block") - 1, F.col("_left._own") * F.exp(-rate * (F.col("_tau") - F.col("_left._tau")))).otherwise(0.0)
    return out.withColumn(name, F.col("_own") + carried).drop("_tau", "_block", "_w", "_own", "_was", "_left")


def with_page_hinkley(df: DataFrame, value: str, *keys: str, delta: float = 0.005, threshold: float = 50.0, least: int = 30) -> DataFrame:
    """Adds ``ph_n, ph_mean, ph_m, ph_drift``: one-sided cumulative deviations from the running mean.

    ``m = max(0, m + x - mean - delta)`` equals ``S - least(0, running minimum of S)`` for the running sum S.
    """
    w = upto(*keys)
    out = df.withColumns({"ph_n": F.count(value).over(w), "ph_mean": F.avg(value).over(w)})
    out = out.withColumn("_s", F.sum(F.col(value) - F.col("ph_mean") - delta).over(w))
    out = out.withColumn("ph_m", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w))).drop("_s")
    return out.withColumn("ph_drift", (F.col("ph_n") >= least) & (F.col("ph_m") > threshold))


def with_last_events(df: DataFrame, fields: list[str], size: int, *keys: str, name: str = "window") -> DataFrame:
    """Adds an array of the last ``size`` rows' fields, this row last, padded in front with zeros."""
    item = F.struct(*[F.col(f).cast("double").alias(f) for f in fields])
    got = F.collect_list(item).over(ordered(*keys).rowsBetween(-(size - 1), 0))
    zero = F.struct(*[F.lit(0.0).alias(f) for f in fields])
    out = df.withColumn("_got", got)
    return out.withColumn(name, F.concat(F.array_repeat(zero, F.lit(size) - F.size("_got")), F.col("_got"))).drop("_got")


def with_rolling_distinct(df: DataFrame, value: str, seconds: int, name: str, *keys: str) -> DataFrame:
    """Adds how many different values occurred before each row in the last ``seconds``.

    A row counts for the rows after it until its value occurs again (which then counts in its place) or its time is up: one more
    after it, one less there. So the number is a running sum over rows and these changes together, in two levels as in
    ``with_bucketed_past``: linear in the rows, and no task sees all rows of a busy key. Null values don't count.
    """
    following = F.lead(F.struct(*ORDER)).over(ordered(*keys, value))
    rows = df.select(*keys, *ORDER, value, following.alias("_next")).where(F.col(value).isNotNull())
    until = F.col("ts_us") + seconds * US
    soon = F.coalesce(F.col("_next.ts_us") <= until, F.lit(False))
    more = rows.select(*keys, *ORDER, F.lit(1).alias("_kind"), F.lit(1).alias("_d"))
    # a time that is up comes before the rows of the next microsecond
    less = rows.select(*keys, F.when(soon, F.col("_next.ts_us")).otherwise(until + 1).alias("ts_us"), F.when(soon, F.col("_next.event_id")).otherwise("").alias("event_id"), F.lit(1).alias("_kind"), F.lit(-1).alias("_d"))
    asked = df.select(*keys, *ORDER, F.lit(0).alias("_kind"), F.lit(0).alias("_d"))
    counted = with_bucketed_past(asked.unionByName(more).unionByName(less), {name: F.col("_d")}, *keys, order=(*ORDER, "_kind")).where("_kind = 0")
    return df.join(counted.select("event_id", F.col(name).cast("long").alias(name)), "event_id")


def with_bucketed_past(df: DataFrame, sums: dict[str, Column], *keys: str, bucket_us: int = HOUR_US, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Adds sums over the rows before each row, for keys with very many rows, in two levels.

    Rows are summed by (key, bucket of time) first; a window over that small table gives what came before
    the bucket, one within (key, bucket) what came before in it. No task sees all rows of a key.
    """
    return _add_past(df, df, sums, keys, bucket_us, order)


def with_bucketed_pasts(df: DataFrame, wanted: list[tuple[dict[str, Column], tuple[str, ...], int]], order: tuple[str, ...] = ORDER) -> DataFrame:
    """``with_bucketed_past`` for several keys (and widths of buckets) of the same rows, which are written first, so that they are
    made once."""
    source = stored(df, "past")
    return reduce(lambda out, x: _add_past(out, source, x[0], x[1], x[2], order), wanted, source)


def _add_past(df: DataFrame, source: DataFrame, sums: dict[str, Column], keys: tuple[str, ...], bucket_us: int, order: tuple[str, ...]) -> DataFrame:
    marked = lambda rows: rows.withColumn("_bucket", F.floor(F.col("ts_us") / bucket_us)).withColumns({f"_v_{n}": c for n, c in sums.items()})
    small = marked(source).groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    small = small.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in sums])
    inside = past(*keys, "_bucket", order=order)
    out = marked(df).withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums}).join(small, [*keys, "_bucket"])
    out = out.withColumns({n: F.col(f"_i_{n}") + F.col(f"_p_{n}") for n in sums})
    return out.drop("_bucket", *[f"{p}{n}" for n in sums for p in ("_v_", "_i_", "_p_")])


def before(a_ts: Column, a_id: Column, b_ts: Column, b_id: Column) -> Column:
    return (a_ts < b_ts) | ((a_ts == b_ts) & (a_id < b_id))


def join_all(frames: list[DataFrame], on: str = "event_id") -> DataFrame:
    return reduce(lambda a, b: a.join(b, on), frames)
