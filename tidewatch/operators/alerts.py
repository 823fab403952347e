"""Alert and entity queries over scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import tables as T
from tidewatch.operators import windows as W

c = F.col


def alert_queue(scored: DataFrame, threshold: float = 0.0, attack_type: str | None = None, entity: str | None = None, order: str = "risk_desc", offset: int = 0, limit: int | None = None) -> DataFrame:
    """Alerts that meet the filters, in order, a page of them if there is a limit."""
    df = scored.where(c("risk_score") >= threshold)
    if attack_type is not None:
        df = df.where(c("predicted_attack_type") == attack_type)
    if entity is not None:
        df = df.where(c("entity_id") == entity)
    by = {"risk_desc": [F.desc("risk_score")], "risk_asc": [F.asc("risk_score")], "time_desc": [F.desc("ts_us")], "time_asc": [F.asc("ts_us")]}[order]
    df = df.orderBy(*by, "event_id")
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def alert_details(scored: DataFrame, threshold: float = 65.0) -> DataFrame:
    """Alerts with their entity's summary and how many similar alerts there are among the five nearest."""
    alerts = scored.where(c("risk_score") >= threshold)
    near = T.similar_alerts(alerts).groupBy("event_id").agg(F.count("*").alias("n_similar"), F.min("distance").alias("nearest"))
    summary = T.entity_summary(scored, threshold).select("entity_id", "events", "alerts", "mean_risk", "max_risk", "cold_start")
    out = alerts.select("event_id", "entity_id", "risk_score", "predicted_attack_type").join(summary, "entity_id", "left").join(near, "event_id", "left")
    return out.na.fill(0, ["n_similar"])


def entity_details(scored: DataFrame, threshold: float = 65.0, points: int = 200) -> DataFrame:
    """Per entity: busiest hour, share of alerts, mean bytes and duration against the cohort's median entity, drift, ``top_resources`` (array of resource, n, is_new; most used first) and
    ``timeline`` (array of ts_us, risk_score: the newest ``points``, oldest first)."""
    hours = T.hour_histogram(scored, "entity_id", alpha=0.0)
    busiest = hours.groupBy("entity_id").agg(F.max_by("hour", F.struct("weight", -c("hour"))).alias("busiest_hour"))
    summary = T.entity_summary(scored, threshold)
    own = scored.groupBy("entity_id", "cohort").agg(F.avg("bytes_transferred").alias("mean_bytes"), F.avg("session_duration_s").alias("mean_duration"))
    medians = own.groupBy("cohort").agg(F.median("mean_bytes").alias("cohort_median_bytes"), F.median("mean_duration").alias("cohort_median_duration"))
    top = T.top_resources(scored).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct((-c("n")).alias("k"), "resource", "n", "is_new"))).alias("_t"))
    top = top.select("entity_id", F.transform("_t", lambda x: F.struct(x["resource"].alias("resource"), x["n"].alias("n"), x["is_new"].alias("is_new"))).alias("top_resources"))
    line = T.newest(scored, points, "entity_id").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("ts_us", "event_id", "risk_score"))).alias("_l"))
    line = line.select("entity_id", F.transform("_l", lambda x: F.struct(x["ts_us"].alias("ts_us"), x["risk_score"].alias("risk_score"))).alias("timeline"))
    out = summary.select("entity_id", "cohort", "events", (c("alerts") / c("events")).alias("alert_rate")).join(own.drop("cohort"), "entity_id").join(medians, "cohort").join(busiest, "entity_id")
    return out.join(drift_states(scored), "entity_id", "left").join(top, "entity_id").join(line, "entity_id")


def feedback_thresholds(verdicts: DataFrame, base: float = 40.0, step: float = -5.0) -> DataFrame:
    """``entity_id, threshold``: each false positive moves the entity's threshold by ``step``, never below 0."""
    n = F.sum((c("verdict") == "false_positive").cast("long"))
    return verdicts.groupBy("entity_id").agg(F.greatest(F.lit(0.0), base + step * n).alias("threshold"))


def drift_states(scored: DataFrame, value: str = "risk_score") -> DataFrame:
    """``entity_id, drifting, drift_since_us, adapted``: whether the newest event is in drift, when drift first showed, and whether the entity came out of it since."""
    df = W.with_page_hinkley(scored, value, "entity_id")
    out = df.groupBy("entity_id").agg(F.max_by("ph_drift", F.struct("ts_us", "event_id")).alias("drifting"), F.min(F.when(c("ph_drift"), c("ts_us"))).alias("drift_since_us"))
    return out.withColumn("adapted", c("drift_since_us").isNotNull() & ~c("drifting"))


def learn_decisions(scored: DataFrame, verdicts: DataFrame, recent: int = 500, most: float = 65.0) -> DataFrame:
    """``event_id, learned``: whether an event may teach its entity's baseline.

    Not in drift; not if the caller says no (``learn`` false, if there is such a column); yes on a verdict of
    false positive, which counts for the newest ``recent`` events of an entity; else if the risk is below ``most``.
    """
    df = W.with_page_hinkley(scored, "risk_score", "entity_id")
    age = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("ts_us"), F.desc("event_id")))
    df = df.withColumn("_age", age).join(verdicts.select("event_id", "verdict").dropDuplicates(["event_id"]), "event_id", "left")
    may = c("learn") if "learn" in scored.columns else F.lit(True)
    cleared = (c("verdict") == "false_positive") & (c("_age") <= recent)
    return df.select("event_id", F.when(c("ph_drift"), False).when(~may, False).when(F.coalesce(cleared, F.lit(False)), True).otherwise(c("risk_score") < most).alias("learned"))
