"""Registered streaming queries: the view replayed as a stream, checked against the batch form in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import features as X
from tidewatch.operators import incremental as N
from tidewatch.operators import scoring as M
from tidewatch.plans.feature_queries import ORACLES as FEATURE_SQL
from tidewatch.plans.feature_queries import rounded
from tidewatch.plans.model_queries import PH
from tidewatch.sources.access_events import DUCK_WITH, access_events, labels, scored
from tidewatch.sources.storage import new_folder
from tidewatch.streaming import jobs as J

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def source(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    ev = scored(spark, sf_dir)
    path = new_folder(spark, "replay")
    J.write_steps(ev, path, files=files)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ev.schema.fields)
    return J.replay(spark, path, schema, files)


def newest(df: DataFrame, *keys: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return df.withColumn("r", rank).where("r = 1").drop("r", "batch")


@query(DUCK_WITH + ", wm AS (SELECT max(ts_us) // 1000 * 1000 - 86400000000 AS closed FROM ev WHERE auth_result = 'failure'), s(width, slide) AS (VALUES " + ", ".join(f"({w}::BIGINT, {s}::BIGINT)" for w, s in J.FAILURE_WINDOWS) + """),
w AS (SELECT width, entity_id, unnest(range(0, width, slide)) * -1000000 + ts_us // (slide * 1000000) * (slide * 1000000) AS start_us FROM ev, s WHERE auth_result = 'failure')
SELECT CAST(width AS INTEGER) AS width, start_us, entity_id, count(*) AS failures FROM w, wm WHERE start_us + width * 1000000 <= closed GROUP BY ALL""")
def st_windowed_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in windows of 5 minutes, an hour and a day, each written once when the watermark closes it."""
    outs = [J.to_table(J.windowed_failures(source(spark, sf_dir), w, s), f"windows-{w}").drop("batch") for w, s in J.FAILURE_WINDOWS]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


@query(DUCK_WITH + " SELECT ts_us // 86400000000 * 86400000000 AS start_us, count(*) AS events, count(*) FILTER (risk_score >= 65) AS alerts FROM sc GROUP BY 1")
def st_live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and alerts by day, refreshed every few seconds."""
    return J.live_counters(source(spark, sf_dir), new_folder(spark, "live-counters"), every="1 second")


@query(DUCK_WITH + " SELECT entity_id, count(*) AS events, count(*) FILTER (risk_score >= 65) AS alerts, max(risk_score) AS max_risk, max(ts_us) AS last_us FROM sc GROUP BY 1")
def st_entity_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(J.to_table(J.entity_counters(source(spark, sf_dir)), "counters", "update"), "entity_id")


@query(DUCK_WITH + " SELECT event_id, risk_score FROM sc WHERE risk_score >= 65")
def st_alerts_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.to_table(J.alerts_only(source(spark, sf_dir), delay="60 days"), "alerts").select("event_id", "risk_score")


STATE_SQL = DUCK_WITH + """, b AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts_us, event_id) AS k FROM ev)
SELECT e.event_id, count(p.k) AS n, count(p.k) FILTER (p.k > coalesce((SELECT max(z.k) FROM b z WHERE z.{key} = e.{key} AND z.k < e.k AND z.auth_result <> 'failure'), 0)) AS run, round((any_value(e.ts_us) - max(p.ts_us)) / 1e6, 6) AS gap, round(avg(p.geo_lat), 10) AS mean_lat, round(avg(p.geo_lon), 10) AS mean_lon,
 CASE WHEN count(p.k) FILTER (p.resource_accessed = e.resource_accessed) = 0 THEN 1 ELSE 0 END AS new_resource FROM b e LEFT JOIN b p ON p.{key} = e.{key} AND p.k < e.k GROUP BY e.event_id, e.k, e.{key}"""


def _state(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    out = J.to_table(J.stateful_features(source(spark, sf_dir), key), f"state-{key}").drop("batch")
    return out.withColumns({"gap": F.round("gap", 6), "mean_lat": F.round("mean_lat", 10), "mean_lon": F.round("mean_lon", 10)})


@query(STATE_SQL.format(key="entity_id"))
def st_entity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful features by entity, checked against windows: stream equals batch."""
    return _state(spark, sf_dir, "entity_id")


@query(STATE_SQL.format(key="source_ip"))
def st_source_ip_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir, "source_ip")


@query(STATE_SQL.format(key="cohort"))
def st_cohort_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir, "cohort")


@query(DUCK_WITH + PH + " SELECT event_id, round(m + 1e-7, 4) AS ph_m, drift AS ph_drift FROM pd")
def st_page_hinkley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.to_table(J.stateful_drift(source(spark, sf_dir)), "drift").drop("batch").withColumn("ph_m", F.round(c("ph_m") + 1e-7, 4))


RESET = """, oo AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts_us, event_id) AS k FROM sc),
ph AS (SELECT entity_id, k, event_id, CAST(1 AS BIGINT) AS n, risk_score AS total, CAST(0 AS DOUBLE) AS m, false AS drift FROM oo WHERE k = 1
 UNION ALL SELECT oo.entity_id, oo.k, oo.event_id, CASE WHEN drift THEN 0 ELSE n END + 1, CASE WHEN drift THEN 0 ELSE total END + risk_score,
  greatest(0, CASE WHEN drift THEN 0 ELSE m END + risk_score - (CASE WHEN drift THEN 0 ELSE total END + risk_score) / (CASE WHEN drift THEN 0 ELSE n END + 1) - 0.005),
  CASE WHEN drift THEN 0 ELSE n END + 1 >= 30 AND greatest(0, CASE WHEN drift THEN 0 ELSE m END + risk_score - (CASE WHEN drift THEN 0 ELSE total END + risk_score) / (CASE WHEN drift THEN 0 ELSE n END + 1) - 0.005) > 50
 FROM ph JOIN oo ON oo.entity_id = ph.entity_id AND oo.k = ph.k + 1)"""


@query(DUCK_WITH + RESET + " SELECT event_id, round(m + 1e-7, 4) AS ph_m, drift AS ph_drift FROM ph")
def st_page_hinkley_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.to_table(J.stateful_drift(source(spark, sf_dir), reset=True), "drift-reset").drop("batch").withColumn("ph_m", F.round(c("ph_m") + 1e-7, 4))


@query(FEATURE_SQL["f_source_ip"])
def st_batch_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch plan of the source-IP features run per micro-batch over the touched keys' history."""
    return rounded(J.batch_equal(source(spark, sf_dir), X.ip_features, "source_ip", "ip-features"))


def _steps(spark: SparkSession, sf_dir: str, steps: int) -> DataFrame:
    ev = access_events(spark, sf_dir)
    path = new_folder(spark, "replay")
    J.write_steps(ev, path, steps=steps)
    return J.replay(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ev.schema.fields), 4)


@query(FEATURE_SQL["f_all"])
def st_all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 43 features from saved state, in three batches of a stream, equal those of the batch job."""
    return rounded(J.feature_stream(_steps(spark, sf_dir, 3), new_folder(spark, "feature-state")))


@query(DUCK_WITH + """, f AS (SELECT *, row_number() OVER (PARTITION BY entity_id, resource_accessed ORDER BY ts_us, event_id) AS k FROM ev), w AS (SELECT entity_id, cohort, unnest(command_sequence) AS a FROM ev)
SELECT 'e' AS scope, entity_id AS key, 'resource' AS attr, resource_accessed AS value, count(*) AS total FROM ev GROUP BY ALL UNION ALL SELECT 'e', entity_id, 'hour', CAST((ts_us // 3600000000) % 24 AS VARCHAR), count(*) FROM ev GROUP BY ALL
UNION ALL SELECT 'c', cohort, 'users', resource_accessed, count(*) FROM f WHERE k = 1 GROUP BY ALL UNION ALL SELECT 'e', entity_id, 'breadth', '', count(*) FROM f WHERE k = 1 GROUP BY ALL UNION ALL SELECT 'c', cohort, 'peers', '', count(DISTINCT entity_id) FROM ev GROUP BY ALL
UNION ALL SELECT 'g', '', 'token', a, count(*) FROM w GROUP BY ALL UNION ALL SELECT 'c', cohort, 'vocab', '', count(DISTINCT a) FROM w GROUP BY ALL UNION ALL SELECT 'i', source_ip, 'entities', '', count(DISTINCT entity_id) FROM ev GROUP BY ALL""")
def s_feature_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that a stream saved, loaded again: totals, first uses and sets by entity, cohort, address and over all."""
    folder = new_folder(spark, "feature-state")
    J.feature_stream(_steps(spark, sf_dir, 2), folder)
    loaded = N.FeatureState(spark, f"{folder}/state").newest("totals", N.TOTALS, N.KEYS, 2)
    some = F.concat("scope", F.lit("."), "attr").isin("e.resource", "e.hour", "c.users", "e.breadth", "c.peers", "g.token", "c.vocab", "i.entities")
    return loaded.where(some)


@query()
def st_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows routed aside as late when every tenth day's file comes two days on."""
    ev = scored(spark, sf_dir).withColumn("ts_us", F.when(c("bytes_transferred") % 50 == 0, c("ts_us") - 3 * J.DAY_US).otherwise(c("ts_us")))
    path = new_folder(spark, "late")
    moved = ev.withColumn("day", F.floor(F.when(c("bytes_transferred") % 50 == 0, c("ts_us") + 3 * J.DAY_US).otherwise(c("ts_us")) / J.DAY_US))
    moved.repartition("day").write.partitionBy("day").parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ev.schema.fields)
    fine, late = J.split_late(J.replay(spark, path, schema, 4), "split")
    return fine.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query(DUCK_WITH + " SELECT event_id, risk_score AS value FROM sc ORDER BY md5(event_id) LIMIT 400")
def st_running_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.running_distribution(source(spark, sf_dir), "risk_score", "sample", 400)


#: The batch that ``source`` puts each event in: four spans of days.
SPANS = """, sp AS (SELECT min(ts_us // 86400000000) AS lo, max(ts_us // 86400000000) AS hi FROM sc),
bt AS (SELECT sc.event_id, risk_score, CAST((ts_us // 86400000000 >= lo + (hi + 1 - lo) // 4) AS INTEGER) + CAST((ts_us // 86400000000 >= lo + (hi + 1 - lo) * 2 // 4) AS INTEGER) + CAST((ts_us // 86400000000 >= lo + (hi + 1 - lo) * 3 // 4) AS INTEGER) AS b FROM sc, sp),
ct AS (SELECT b, count(*) AS n FROM bt GROUP BY 1)"""


@query(DUCK_WITH + SPANS + ", tm AS (SELECT b, max(sc.ts_us) AS newest FROM bt JOIN sc ON sc.event_id = bt.event_id GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY ct.b) - 1 AS INTEGER) AS batch, n AS rows, CAST(sum(n) OVER (ORDER BY ct.b) AS BIGINT) AS position, (SELECT count(*) FROM sc) AS total, newest AS newest_us FROM ct JOIN tm ON tm.b = ct.b")
def st_replay_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, position and total of each batch of a replay."""
    return J.replay_progress(source(spark, sf_dir), scored(spark, sf_dir).count(), new_folder(spark, "progress"))


@query(DUCK_WITH + SPANS + """, u AS (SELECT b.b, p.risk_score AS v, count(*) AS k FROM (SELECT DISTINCT b FROM bt) b JOIN bt p ON p.b < b.b GROUP BY ALL),
w AS (SELECT b, v, sum(k) OVER (PARTITION BY b ORDER BY v) AS at_most, sum(k) OVER (PARTITION BY b) AS n FROM u)
SELECT bt.event_id, round(CASE WHEN coalesce((SELECT max(n) FROM w WHERE w.b = bt.b), 0) < 500 THEN 0.5 ELSE coalesce((SELECT max(at_most) FROM w WHERE w.b = bt.b AND w.v <= bt.risk_score), 0) / (SELECT max(n) FROM w WHERE w.b = bt.b) END, 8) AS rank FROM bt""")
def st_online_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of scores among those of earlier batches, with warm-up."""
    return J.online_ranks(source(spark, sf_dir), "risk_score", "ranks")[0].withColumn("rank", F.round("rank", 8))


@query()
def st_live_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events scored as a stream with models fitted and saved beforehand; the alerts."""
    ev = access_events(spark, sf_dir)
    models, folder, path = (new_folder(spark, x) for x in ("models", "live", "replay"))
    rows = M.feature_rows(ev)
    M.fit_models(rows.where("split = 'train'"), models, labels(spark, sf_dir), rows.where("split = 'val'"))
    J.write_steps(ev, path, steps=2)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ev.schema.fields)
    return J.live_scores(J.replay(spark, path, schema), models, folder).where("is_alert").select("event_id", "risk_score", "band", "attack_type")
