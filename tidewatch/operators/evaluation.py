"""Evaluation of scores against labels: areas, budgets, types, time to detect.

Rows are ``event_id, ts_us, score, is_anomaly, label, episode_id`` and such; everything is an aggregate or
running sums over distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import tables as T
from tidewatch.sources.access_events import ATTACKS
from tidewatch.sources.storage import stored

BUDGETS = (0.5, 1.0, 2.0, 3.0, 5.0)
MINUTES_AN_ALERT = 12
c = F.col


def score_table(df: DataFrame, score: str = "score", truth: str = "is_anomaly", keys: tuple[str, ...] = ()) -> DataFrame:
    """A row per distinct score, best first: ``tp, fp`` so far and ``pos, neg`` in all (and those at the score, ``p, n``),
    its place ``i`` and how many there are, ``m``. No task sees all scores (``tables.with_running``)."""
    per = df.groupBy(*keys, c(score).alias("score")).agg(F.sum(c(truth).cast("long")).alias("p"), F.sum((~c(truth)).cast("long")).alias("n"))
    t = T.with_running(per.withColumn("one", F.lit(1)), "score", {"tp": "p", "fp": "n", "i": "one"}, *keys, descending=True)
    return t.withColumnsRenamed({"tp_all": "pos", "fp_all": "neg", "i_all": "m"}).drop("one")


def _precision_sum() -> Column:
    step = F.when(c("pos") > 0, c("p") / c("pos") * c("tp") / (c("tp") + c("fp"))).otherwise(0.0)
    return F.coalesce(F.sum(step), F.lit(0.0))


def _won_share() -> Column:
    won = F.sum(c("p") * (c("neg") - c("fp") + c("n") / 2.0)) / F.max(c("pos") * c("neg"))
    return F.when(F.coalesce(F.max(c("pos") * c("neg")), F.lit(0)) > 0, won).otherwise(0.5)


def pr_auc(df: DataFrame, keys: tuple[str, ...] = (), **names: str) -> DataFrame:
    """Average precision, equal scores together: ``pr_auc``; 0 without positives."""
    t = score_table(df, keys=keys, **names)
    agg = _precision_sum().alias("pr_auc")
    return t.groupBy(*keys).agg(agg) if keys else t.agg(agg)


def roc_auc(df: DataFrame, keys: tuple[str, ...] = (), **names: str) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half: ``roc_auc``; 0.5 with one class only."""
    t = score_table(df, keys=keys, **names)
    agg = _won_share().alias("roc_auc")
    return t.groupBy(*keys).agg(agg) if keys else t.agg(agg)


def areas(df: DataFrame, keys: tuple[str, ...] = (), **names: str) -> DataFrame:
    """``pr_auc`` and ``roc_auc`` from one table of scores."""
    t, both = score_table(df, keys=keys, **names), (_precision_sum().alias("pr_auc"), _won_share().alias("roc_auc"))
    return t.groupBy(*keys).agg(*both) if keys else t.agg(*both)


def at_budgets(df: DataFrame, score: str = "score", truth: str = "is_anomaly", budgets: tuple[float, ...] = BUDGETS, minutes: int = MINUTES_AN_ALERT) -> DataFrame:
    """``budget, alerts, precision, recall, hours`` when the given percent of rows are alerted on, ties by event id."""
    ranked = T.budget_rank(df, score)
    totals = df.agg(F.count("*").alias("n"), F.sum(c(truth).cast("long")).alias("pos"))
    b = df.sparkSession.createDataFrame([(x,) for x in budgets], "budget double").crossJoin(totals).withColumn("k", T.budget_size(c("n"), c("budget")))
    hit = ranked.join(F.broadcast(b), c("position") <= c("k"))
    out = hit.groupBy("budget").agg(F.count("*").alias("alerts"), F.sum(c(truth).cast("long")).alias("tp"), F.max("pos").alias("pos"))
    return out.select("budget", "alerts", (c("tp") / c("alerts")).alias("precision"), F.when(c("pos") > 0, c("tp") / c("pos")).otherwise(0.0).alias("recall"), (c("alerts") * minutes / 60.0).alias("hours"))


def pr_curve(df: DataFrame, points: int = 50, **names: str) -> DataFrame:
    """``recall, precision`` at about ``points`` scores evenly spread by their order, the last included."""
    t = score_table(df, **names)
    every = F.greatest(F.lit(1), F.floor(c("m") / points))
    picked = t.where((F.pmod(c("i") - 1, every) == 0) | (c("i") == c("m")))
    return picked.select(c("i").cast("long").alias("i"), (c("tp") / c("pos")).alias("recall"), (c("tp") / (c("tp") + c("fp"))).alias("precision"))


def per_attack(df: DataFrame, alert: str = "is_alert") -> DataFrame:
    """``attack_type, support, detected, recall``; types without rows are kept with zeros."""
    types = df.sparkSession.createDataFrame([(a,) for a in ATTACKS], "attack_type string")
    got = df.where(c("label").isin(*ATTACKS)).groupBy(c("label").alias("attack_type")).agg(F.count("*").alias("support"), F.sum(c(alert).cast("long")).alias("detected"))
    out = types.join(F.broadcast(got), "attack_type", "left").na.fill(0, ["support", "detected"])
    return out.withColumn("recall", F.when(c("support") > 0, c("detected") / c("support")).otherwise(0.0))


def confusion(df: DataFrame, truth: str = "label", predicted: str = "predicted", names: tuple[str, ...] = ("normal", *ATTACKS)) -> DataFrame:
    """``truth, predicted, n`` over fixed labels, zeros included; other labels count as normal."""
    known = lambda x: F.when(c(x).isin(*names), c(x)).otherwise("normal")
    counts = df.groupBy(known(truth).alias("truth"), known(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    one = df.sparkSession.createDataFrame([(a, b) for a in names for b in names], "truth string, predicted string")
    return one.join(F.broadcast(counts), ["truth", "predicted"], "left").na.fill(0, ["n"])


def time_to_detect(df: DataFrame, alert: str = "is_alert") -> DataFrame:
    """``attack_type, episodes, mean_events, mean_minutes`` from an episode's start to its first alert, detected episodes only.

    Events up to the first alert are counted by time, equal times included, less the alert itself.
    """
    ep = df.where(c("is_anomaly") & c("episode_id").isNotNull())
    firsts = ep.groupBy("episode_id").agg(F.min("ts_us").alias("start"), F.min(F.when(c(alert), c("ts_us"))).alias("first"), F.min_by("label", F.struct("ts_us", "event_id")).alias("attack_type")).where("first IS NOT NULL")
    until = ep.select("episode_id", "ts_us").join(firsts, "episode_id").where("ts_us <= first").groupBy("episode_id").agg((F.count("*") - 1).alias("events"))
    per = firsts.join(until, "episode_id").withColumn("minutes", (c("first") - c("start")) / 6e7)
    return per.groupBy("attack_type").agg(F.count("*").alias("episodes"), F.avg("events").alias("mean_events"), F.avg("minutes").alias("mean_minutes"))


def false_positive_rates(df: DataFrame, alert: str = "is_alert") -> DataFrame:
    rate = lambda name: F.coalesce(F.avg(F.when(c("label") == name, c(alert).cast("double"))), F.lit(0.0))
    return df.agg(rate("benign_confounder").alias("confounder_rate"), rate("insider_drift").alias("drift_rate"))


def subgroup(df: DataFrame, inside: DataFrame | None = None, alert: str = "is_alert") -> DataFrame:
    """``events, precision, recall`` of alerts, over the entities in ``inside`` if given."""
    rows = df if inside is None else df.join(inside.select("entity_id").distinct(), "entity_id", "left_semi")
    tp = F.sum((c(alert) & c("is_anomaly")).cast("long"))
    share = lambda n: F.coalesce(F.when(n > 0, tp / n), F.lit(0.0))
    return rows.agg(F.count("*").alias("events"), share(F.sum(c(alert).cast("long"))).alias("precision"), share(F.sum(c("is_anomaly").cast("long"))).alias("recall"))


def baseline_types(df: DataFrame, pct: float = 1.0, benign: tuple[str, ...] = ("benign_confounder", "insider_drift"), score: str = "score") -> DataFrame:
    """``label, support, share``: of each attack type the share within the top ``pct`` percent of rows, of each benign group the share
    at or above the score that bounds them (the interpolated percentile)."""
    n = df.agg(T.budget_size(F.count("*"), F.lit(pct)).alias("k")).crossJoin(T.percentiles(df, score, (1 - pct / 100,)).toDF("bound", "_mean"))  # one row
    ranked = T.budget_rank(df, score).crossJoin(n)  # one row
    hit = F.when(c("label").isin(*ATTACKS), c("position") <= c("k")).otherwise(c(score) >= c("bound"))
    return ranked.where(c("label").isin(*ATTACKS, *benign)).groupBy("label").agg(F.count("*").alias("support"), F.avg(hit.cast("double")).alias("share"))


def summary(df: DataFrame, cold: DataFrame, drift_us: int, held_out: str) -> DataFrame:
    """One row of what a run amounts to: counts, rates, areas, the top percent, false positives, subgroups, delay, recall of a type held out.

    ``cold``: entities without history; ``drift_us``: the time from which behaviour is taken to have changed.
    """
    df = stored(df.select("event_id", "entity_id", "episode_id", "ts_us", "label", "score", "is_anomaly", "is_alert"), "evaluated")
    one = df.agg(
        F.count("*").alias("events"), F.sum(c("is_anomaly").cast("long")).alias("anomalies"), F.sum(c("is_alert").cast("long")).alias("alerts"), F.avg(c("is_anomaly").cast("double")).alias("anomaly_rate"),
        F.coalesce(F.avg(F.when(c("label") == held_out, c("is_alert").cast("double"))), F.lit(0.0)).alias("held_out_recall"),
        F.coalesce(F.avg(F.when(c("label") == "benign_confounder", c("is_alert").cast("double"))), F.lit(0.0)).alias("confounder_rate"),
        F.coalesce(F.avg(F.when(c("label") == "insider_drift", c("is_alert").cast("double"))), F.lit(0.0)).alias("drift_rate"),
    )
    # areas and the percentile from one table of running counts; a place from below is one from above in all rows
    t, n = score_table(df), c("pos") + c("neg")
    place = F.lit(0.99) * (n - 1)
    at = lambda k: F.min(F.when(n - (c("tp") + c("fp")) + c("p") + c("n") > k, c("score")))
    low, high = at(F.floor(place)), at(F.ceil(place))
    curve = t.agg(_precision_sum().alias("pr_auc"), _won_share().alias("roc_auc"), (low + (high - low) * F.max(place - F.floor(place))).alias("p99"))
    ranked = T.budget_rank(df, "score").crossJoin(df.agg(T.budget_size(F.count("*"), F.lit(1.0)).alias("k"), F.sum(c("is_anomaly").cast("long")).alias("pos"))).where("position <= k")  # one row
    hits = F.sum(c("is_anomaly").cast("long"))
    top = ranked.agg((hits / F.count("*")).alias("precision_1pct"), F.when(F.max("pos") > 0, hits / F.max("pos")).otherwise(0.0).alias("recall_1pct"), F.max_by("score", "position").alias("threshold_1pct"))
    cold_ = subgroup(df, cold).select(c("precision").alias("cold_precision"), c("recall").alias("cold_recall"))
    drift = subgroup(df.where(c("ts_us") >= drift_us)).select(c("precision").alias("drift_precision"), c("recall").alias("drift_recall"))
    delay = time_to_detect(df).agg((F.sum(c("episodes") * c("mean_minutes")) / F.sum("episodes")).alias("mean_minutes_to_detect"))
    out = one
    for row in (curve, top, cold_, drift, delay):
        out = out.crossJoin(row)  # one row each
    return out
