"""Aggregations, joins and top-k over events, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.sources.storage import stored


def profile(features: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Mean, population variance and count of every feature per key, long: ``key, feature, n, mean, var``."""
    long = features.unpivot([key], names, "feature", "value")
    return long.groupBy(key, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))


def profile_wide(features: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """The same in one row per key: ``key, n, mean array, var array`` in the order of ``names``. One pass, no unpivot."""
    return features.groupBy(key).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in names]).alias("mean"), F.array(*[F.var_pop(c) for c in names]).alias("var"))


def cohort_and_global(df: DataFrame, key: str, names: list[str], floor: float = 1e-6) -> DataFrame:
    """Mean and deviation of columns per key and over all (key null): ``key, <name>_mean, <name>_std``."""
    aggs = [a for n in names for a in (F.avg(n).alias(f"{n}_mean"), F.greatest(F.stddev_pop(n), F.lit(floor)).alias(f"{n}_std"))]
    return df.groupBy(key).agg(*aggs).unionByName(df.agg(*aggs).withColumn(key, F.lit(None).cast("string")))


def with_running(rows: DataFrame, order: str, sums: dict[str, str], *keys: str, descending: bool = False) -> DataFrame:
    """Adds sums over the rows up to and with each row in the order of ``order`` (different values of it within the keys):
    name to column; and ``<name>_all``, the sums over all rows of the keys.

    Rows are dealt to tasks by ranges of (keys, order) and written; a window over the ranges' sums, a row a range, says what comes
    before a range, and one within the range the rest. So no task sees all rows, though there are no keys or few.
    """
    way = F.desc(order) if descending else F.asc(order)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, *keys, way).withColumn("_range", F.spark_partition_id()), "ranges")
    per = dealt.groupBy(*keys, "_range").agg(*[F.sum(x).alias(f"_t_{name}") for name, x in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    per = per.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in sums], *[F.sum(f"_t_{name}").over(whole).alias(f"{name}_all") for name in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(way).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    out = dealt.withColumns({f"_i_{name}": F.sum(x).over(inside) for name, x in sums.items()}).alias("r").join(per.alias("p"), [*same, F.col("r._range") == F.col("p._range")] if same else F.col("r._range") == F.col("p._range"))
    return out.select(*[F.col(f"r.{x}") for x in rows.columns], *[(F.col(f"_i_{name}") + F.col(f"_b_{name}")).alias(name) for name in sums], *[F.col(f"{name}_all") for name in sums])


def distribution(df: DataFrame, value: str, key: str | None = None) -> DataFrame:
    """Empirical distribution: ``[key,] value, at_most, n`` - how many of n values are at most this one.

    Equal values are counted first; the running count goes through ranges of values, so no task sees all of them.
    """
    keys = [key] if key else []
    counts = df.groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("c"))
    return with_running(counts, "value", {"at_most": "c"}, *keys).select(*keys, "value", "at_most", F.col("at_most_all").alias("n"))


def ecdf_table(probes: DataFrame, probe: str, fitted: DataFrame, value: str, key: str | None = None, times: str | None = None) -> DataFrame:
    """``[key,] _v, _rank``: for each different probe value the share of fitted values at most it, per key.

    Fitted and probe values are counted by value and run through ranges of values together, so there is no range
    join; the rank is null where the key has no fitted values. ``times``: a column that says how often a fitted row counts.
    """
    keys = [key] if key else []
    a = fitted.groupBy(*keys, F.col(value).alias("_v")).agg((F.sum(times) if times else F.count("*")).alias("_c"))
    b = probes.select(*keys, F.col(probe).alias("_v")).distinct().withColumn("_c", F.lit(0).cast("long"))
    both = a.unionByName(b).groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    return with_running(both, "_v", {"_n": "_c"}, *keys).select(*keys, "_v", (F.col("_n") / F.nullif(F.col("_n_all"), F.lit(0))).alias("_rank"))


def ecdf_rank(probes: DataFrame, probe: str, fitted: DataFrame, value: str, name: str, key: str | None = None, onto: DataFrame | None = None, times: str | None = None) -> DataFrame:
    """Adds ``name``, the rank of ``ecdf_table``, to the probes (or to ``onto``, the same rows with more columns)."""
    keys = [key] if key else []
    ranks = ecdf_table(probes, probe, fitted, value, key, times).withColumnRenamed("_rank", name)
    return (probes if onto is None else onto).withColumn("_v", F.col(probe)).join(ranks, [*keys, "_v"], "left").drop("_v")


def hour_histogram(ev: DataFrame, *keys: str, alpha: float = 0.1) -> DataFrame:
    """``keys, hour, weight``: 24 rows per key, empty hours included, ``alpha`` added to each."""
    counts = ev.groupBy(*keys, S.utc_hour(F.col("ts_us")).alias("hour")).agg(F.count("*").alias("c"))
    grid = ev.select(*keys).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(counts, [*keys, "hour"], "left").select(*keys, "hour", (F.coalesce("c", F.lit(0)) + alpha).alias("weight"))


def weekday_histogram(ev: DataFrame, *keys: str, alpha: float = 0.1) -> DataFrame:
    counts = ev.groupBy(*keys, S.weekday(F.col("ts_us")).alias("weekday")).agg(F.count("*").alias("c"))
    grid = ev.select(*keys).distinct().withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return grid.join(counts, [*keys, "weekday"], "left").select(*keys, "weekday", (F.coalesce("c", F.lit(0)) + alpha).alias("weight"))


def counts_long(ev: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, field, value, n``: value counts of several columns, long."""
    long = ev.unpivot([key], columns, "field", "value")
    return long.groupBy(key, "field", "value").agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row of exact, interpolated percentiles ``p<percent>`` and the ``mean``: from running counts over ranges of values, so that
    no aggregate holds all values. Null values don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    t = with_running(counts, "v", {"upto": "c"})
    at = lambda s: F.lit(s) * (F.col("upto_all") - 1)
    first = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    ends = [x for s in shares for x in (first(F.floor(at(s))).alias(f"_lo{s}"), first(F.ceil(at(s))).alias(f"_hi{s}"), F.max(at(s) - F.floor(at(s))).alias(f"_part{s}"))]
    col = lambda n: F.col(f"`{n}`")
    out = t.agg(*ends, (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    return out.select(*[(col(f"_lo{s}") + (col(f"_hi{s}") - col(f"_lo{s}")) * col(f"_part{s}")).alias(f"p{int(s * 100)}") for s in shares], "mean")


def bigram_counts(ev: DataFrame, *keys: str) -> DataFrame:
    pairs = ev.where(F.size("command_sequence") > 1).select(*keys, F.explode(S.bigrams(F.col("command_sequence"))).alias("p"))
    return pairs.groupBy(*keys, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def unigram_counts(ev: DataFrame, *keys: str) -> DataFrame:
    return ev.select(*keys, F.explode("command_sequence").alias("a")).groupBy(*keys, "a").agg(F.count("*").alias("n"))


def command_totals(ev: DataFrame) -> DataFrame:
    """``level, key, tokens, vocabulary, pairs, distinct_pairs`` by entity, by cohort and over all (level all, key empty).

    Words and pairs are counted by value at the finest level once; the coarser levels add these counts.
    """
    one = unigram_counts(ev, "entity_id", "cohort").withColumn("b", F.lit(None).cast("string"))
    both = one.unionByName(bigram_counts(ev, "entity_id", "cohort"))
    level = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), k.alias("key")) for x, k in (("entity", F.col("entity_id")), ("cohort", F.col("cohort")), ("all", F.lit("")))])).alias("l")
    per = both.select(level, "a", "b", "n").groupBy("l.level", "l.key", "a", "b").agg(F.sum("n").alias("n"))
    word = F.col("b").isNull()
    total = lambda test, value: F.sum(F.when(test, value).otherwise(0)).cast("long")
    return per.groupBy("level", "key").agg(total(word, F.col("n")).alias("tokens"), total(word, F.lit(1)).alias("vocabulary"), total(~word, F.col("n")).alias("pairs"), total(~word, F.lit(1)).alias("distinct_pairs"))


def budget_rank(df: DataFrame, score: str, tie: str = "event_id") -> DataFrame:
    """Adds ``position``: 1 for the highest score (null last), ties by ``tie``, over all rows without one task seeing them all.

    Rows are dealt by ranges of (score, tie) together, so equal scores, however many, are split as well; a window over a row per range says what
    comes before it.
    """
    order = (F.desc(score), F.asc(tie))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranked")
    per = dealt.groupBy("_range").agg(F.count("*").alias("_c"))
    per = per.select("_range", F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_in", inside).join(per, "_range").withColumn("position", F.col("_in") + F.col("_before")).drop("_in", "_before", "_range")


def budget_size(n: Column, pct: Column) -> Column:
    """Rows alerted on: that share of all, rounded down, but one at least."""
    return F.greatest(F.lit(1), F.floor(n * pct / 100)).cast("long")


def top_resources(ev: DataFrame, k: int = 10, recent_us: int = 7 * 86_400_000_000) -> DataFrame:
    """``entity_id, resource, n, is_new``: an entity's most used resources; new if first used within ``recent_us`` of its last event."""
    per = ev.groupBy("entity_id", F.col("resource_accessed").alias("resource")).agg(F.count("*").alias("n"), F.min("ts_us").alias("first"))
    last = ev.groupBy("entity_id").agg(F.max("ts_us").alias("last"))
    out = per.join(last, "entity_id")
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("n"), "resource"))
    return out.withColumn("r", rank).where(F.col("r") <= k).select("entity_id", "resource", "n", (F.col("first") >= F.col("last") - recent_us).alias("is_new"))


def similar_alerts(alerts: DataFrame, k: int = 5, mode: str = "and") -> DataFrame:
    """``event_id, similar_id, distance``: the k alerts nearest in risk of the same type and (or) entity, ties by id.

    Alerts of a group with equal risk are one point, of which the k smallest ids can be chosen (k + 1 are
    kept, as one may be the alert itself). In the order of risk the k nearest are among k points on either
    side, so windows suffice and no pairs of a group are made. With "or" the neighbours by type and by entity
    are united.
    """

    def near(*keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys, "risk_score").orderBy("event_id"))
        points = alerts.select(*keys, "risk_score", "event_id").withColumn("r", rank).where(F.col("r") <= k + 1)
        points = points.groupBy(*keys, "risk_score").agg(F.collect_list("event_id").alias("ids"))
        around = F.collect_list(F.struct("risk_score", "ids")).over(Window.partitionBy(*keys).orderBy("risk_score").rowsBetween(-k, k))
        points = points.withColumn("around", around).select(*keys, "risk_score", F.explode("around").alias("o")).select(*keys, "risk_score", F.abs(F.col("o.risk_score") - F.col("risk_score")).alias("distance"), F.explode("o.ids").alias("similar_id"))
        return alerts.select(*keys, "risk_score", "event_id").join(points, [*keys, "risk_score"]).where("event_id <> similar_id").select("event_id", "similar_id", "distance")

    found = near("predicted_attack_type", "entity_id") if mode == "and" else near("predicted_attack_type").unionByName(near("entity_id")).distinct()
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy("distance", "similar_id"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def distance_band(places: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs of places more than ``low`` and less than ``high`` km apart: ``a, b, km``.

    ``places(place, lat, lon)`` holds distinct places. Cells of 10 degrees are compared by the least
    distance their corners allow; only cells that can hold such a pair are joined.
    """
    cell = places.withColumns({"cy": F.floor(F.col("lat") / 10), "cx": F.floor(F.col("lon") / 10)})
    cells = cell.select("cy", "cx").distinct()
    ca, cb = cells.toDF("ay", "ax"), cells.toDF("by", "bx")
    apart = (F.greatest(F.abs(F.col("ay") - F.col("by")) - 1, F.lit(0)) * 10) * 111.0
    pairs = F.broadcast(ca.join(cb, apart < high))  # at most 18 x 36 cells on either side
    a, b = cell.select(*[F.col(c).alias(f"{c}_a") for c in cell.columns]), cell.select(*[F.col(c).alias(f"{c}_b") for c in cell.columns])
    out = a.join(pairs, (F.col("cy_a") == F.col("ay")) & (F.col("cx_a") == F.col("ax"))).join(b, (F.col("cy_b") == F.col("by")) & (F.col("cx_b") == F.col("bx")))
    km = S.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return out.where(F.col("place_a") < F.col("place_b")).select(F.col("place_a").alias("a"), F.col("place_b").alias("b"), km.alias("km")).where((F.col("km") > low) & (F.col("km") < high))


def episodes(ev: DataFrame, labels: DataFrame) -> DataFrame:
    """Per labelled episode what its label promises: failures, span, distinct entities, resources and devices, distance."""
    df = ev.drop("episode_id").join(labels.where("episode_id IS NOT NULL").select("event_id", "episode_id", "label"), "event_id")
    at = F.struct("ts_us", "event_id")
    out = df.groupBy("episode_id").agg(
        F.min("label").alias("label"), F.sum((F.col("auth_result") == "failure").cast("long")).alias("failures"), F.countDistinct(F.floor(F.col("ts_us") / 86_400_000_000)).alias("days"),
        F.countDistinct("entity_id").alias("entities"), F.countDistinct("resource_accessed").alias("resources"), F.countDistinct("device_fingerprint").alias("devices"),
        F.min_by(F.struct("geo_lat", "geo_lon"), at).alias("from"), F.max_by(F.struct("geo_lat", "geo_lon"), at).alias("to"),
    )
    km = S.haversine_km(F.col("from.geo_lat"), F.col("from.geo_lon"), F.col("to.geo_lat"), F.col("to.geo_lon"))
    out = out.withColumn("km", km).drop("from", "to")
    fine = (
        F.when(F.col("label") == "brute_force", F.col("failures") >= 2).when(F.col("label") == "impossible_travel", F.col("km") > 50).when(F.col("label") == "credential_stuffing", F.col("entities") >= 2)
        .when(F.col("label") == "lateral_movement", F.col("resources") >= 2).when(F.col("label") == "device_spoofing", F.col("devices") >= 2).when(F.col("label") == "low_and_slow_exfil", F.col("days") >= 2)
    )
    return out.withColumn("passes", fine)


def newest(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The newest ``n`` rows, per key if there are keys. Without keys a sort with a limit."""
    if not keys:
        return df.orderBy(F.desc("ts_us"), F.desc("event_id")).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts_us"), F.desc("event_id")))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def hash_sample(df: DataFrame, n: int, key: str = "event_id", seed: str = "") -> DataFrame:
    """``n`` rows by the order of a hash of their key: the same rows on every run and partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key)))).limit(n)


def entity_summary(scored: DataFrame, threshold: float = 65.0, cold: int = 25) -> DataFrame:
    alert = (F.col("risk_score") >= threshold).cast("long")
    return scored.groupBy("entity_id").agg(
        F.min("entity_type").alias("entity_type"), F.min("cohort").alias("cohort"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("events"),
        F.sum(alert).alias("alerts"), F.avg("risk_score").alias("mean_risk"), F.max("risk_score").alias("max_risk"), (F.count("*") < cold).alias("cold_start"),
    )


def source_ip_summary(ev: DataFrame) -> DataFrame:
    """Events, different entities and the mix of auth methods per source IP."""
    per = ev.groupBy("source_ip", "auth_method").agg(F.count("*").alias("n"))
    mix = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("auth_method", "n"))), lambda m: F.concat(m["auth_method"], F.lit("="), m["n"].cast("string"))), ";")
    mixes = per.groupBy("source_ip").agg(F.sum("n").alias("events"), mix.alias("methods"))
    return mixes.join(ev.groupBy("source_ip").agg(F.countDistinct("entity_id").alias("entities")), "source_ip")
