"""Registered queries of sources, filters, joins, aggregations, windows, top-k, set operations and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.operators import tables as T
from tidewatch.operators import windows as W
from tidewatch.plans.feature_queries import rounded
from tidewatch.sources import access_events as A
from tidewatch.sources.access_events import ATTACKS, DUCK_WITH, access_events, labelled_events, labels, scored
from tidewatch.sources.storage import new_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None = None, raw: bool = False):
    """Registers a function of (spark, sf_dir) under its name, with its SQL (after the view's CTEs)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if raw else DUCK_WITH + sql
        return f

    return add


# -- sources and sinks

FIELDS = ", ".join("make_timestamp(ts_us) AS timestamp" if n == "timestamp" else n for n, _, _ in A.EVENT_FIELDS)


@query(f" SELECT {FIELDS.replace('make_timestamp(ts_us) AS timestamp', 'ts_us')} FROM ev")
def s_event_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as zstd Parquet and read back with the schema check."""
    path = new_folder(spark, "events")
    A.write_events(A.declared(access_events(spark, sf_dir)), path)
    out = A.read_events(spark, path)
    return out.select(*[F.unix_micros("timestamp").alias("ts_us") if n == "timestamp" else n for n in out.columns])


@query(" SELECT * FROM lb")
def s_label_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "labels")
    A.write_labels(labels(spark, sf_dir), path)
    return A.read_labels(spark, path)


@query(" SELECT event_id, CASE WHEN bytes_transferred % 3 = 0 THEN 'auth_method,bytes_transferred' WHEN bytes_transferred % 3 = 1 THEN 'geo_lat' ELSE '' END AS violations FROM ev")
def s_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules over events two thirds of which were damaged in a known way."""
    kind = c("bytes_transferred") % 3
    df = A.declared(access_events(spark, sf_dir))
    df = df.withColumns({"auth_method": F.when(kind == 0, "carrier_pigeon").otherwise(c("auth_method")), "geo_lat": F.when(kind == 1, 91.0).otherwise(c("geo_lat")), "bytes_transferred": F.when(kind == 0, -1).otherwise(c("bytes_transferred"))})
    return df.select("event_id", F.array_join(A.violations(), ",").alias("violations"))


@query(" SELECT event_id, CASE WHEN bytes_transferred % 4 = 0 THEN 'unknown note' WHEN bytes_transferred % 4 = 1 THEN 'missing cohort' END AS problem, CASE WHEN bytes_transferred % 4 > 1 THEN ts_us END AS ts_us, CASE WHEN bytes_transferred % 4 > 1 THEN len(command_sequence) END AS n_commands FROM ev")
def s_json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON, some with an unknown or a missing field, through the strict ingest."""
    df = A.declared(access_events(spark, sf_dir))
    kind, names = c("bytes_transferred") % 4, df.columns
    make = lambda *fields: F.to_json(F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"})
    value = F.when(kind == 0, make(*names, F.lit("x").alias("note"))).when(kind == 1, make(*[n for n in names if n != "cohort"])).otherwise(make(*names))
    out = A.from_json_lines(df.select("event_id", value.alias("value")))
    return out.select("event_id", "problem", F.unix_micros("event.timestamp").alias("ts_us"), F.size("event.command_sequence").alias("n_commands")).withColumn("n_commands", F.when(c("problem").isNull(), c("n_commands")))


@query(" SELECT event_id, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp, risk_score FROM sc")
def s_scored_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows as JSON lines, read back field by field."""
    df = scored(spark, sf_dir).withColumn("timestamp", F.timestamp_micros("ts_us")).select("event_id", "timestamp", "risk_score", "command_sequence")
    return A.to_json_lines(df).select("event_id", F.get_json_object("json", "$.timestamp").alias("stamp"), F.get_json_object("json", "$.risk_score").cast("double").alias("risk_score"))


@query(", b(budget, threshold) AS (VALUES (0.5, 65.0), (1.0, 55.5), (2.0, 40.0)) SELECT CAST(budget AS DOUBLE) AS budget, CAST(threshold AS DOUBLE) AS threshold, (SELECT count(*) FROM sc WHERE risk_score >= threshold) AS alerts FROM b")
def s_budget_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds by budget, one of them stored, with the alerts each gives."""
    stored = spark.createDataFrame([(1.0, 55.5)], "budget double, threshold double")
    table = F.broadcast(A.budget_thresholds(spark, stored))
    return scored(spark, sf_dir).join(table, c("risk_score") >= c("threshold"), "right").groupBy("budget", "threshold").agg(F.count("event_id").alias("alerts"))


@query(" SELECT count(*) AS total, count(*) FILTER (risk_score >= 65) AS alerts, round(avg(risk_score), 6) AS mean_risk FROM sc")
def s_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metrics record written as JSON and read again; absent metrics are zero."""
    path = new_folder(spark, "metrics")
    scored(spark, sf_dir).agg(F.count("*").alias("total"), F.sum((c("risk_score") >= 65).cast("long")).alias("alerts"), F.avg("risk_score").alias("mean_risk")).write.json(path)
    got = spark.read.schema("total long, alerts long, mean_risk double").json(path)
    return got.select(*[F.coalesce(x, F.lit(0)).alias(x) for x in ("total", "alerts")], F.round(F.coalesce("mean_risk", F.lit(0.0)), 6).alias("mean_risk"))


# -- projections and filters


@query(", d AS (SELECT *, (ts_us - 1704067200000000) // 86400000000 AS d FROM ev) SELECT CASE WHEN d < 18 THEN 'train' WHEN d < 21 THEN 'val' ELSE 'test' END AS assigned, split, count(*) AS n FROM d GROUP BY ALL")
def p_split_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.day_index(c("ts_us"), 1_704_067_200_000_000)
    return access_events(spark, sf_dir).groupBy(F.when(d < 18, "train").when(d < 21, "val").otherwise("test").alias("assigned"), "split").agg(F.count("*").alias("n"))


@query(f" SELECT event_id, label, label IN {ATTACKS} AS is_anomaly FROM lb")
def p_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = c("label").isin(*ATTACKS, *A.NEGATIVES)
    return labels(spark, sf_dir).select("event_id", "label", F.when(known, c("label").isin(*ATTACKS)).otherwise(F.raise_error(F.concat(F.lit("unknown label "), "label")).cast("boolean")).alias("is_anomaly"))


@query(" SELECT event_id, CASE WHEN risk_score < 40 THEN 'low' WHEN risk_score < 65 THEN 'medium' WHEN risk_score < 85 THEN 'high' ELSE 'critical' END AS band FROM sc")
def p_risk_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("event_id", S.risk_band(c("risk_score")).alias("band"))


@query(""", p(pct, threshold) AS (VALUES (0.05, 80.0), (0.1, 80.0), (0.3, 72.5), (0.75, 57.5), (1.5, 45.0), (3.5, 32.5), (7.0, 25.0))
SELECT CAST(pct AS DOUBLE) AS pct, CAST(threshold AS DOUBLE) AS threshold, (SELECT count(*) FROM sc WHERE risk_score >= threshold) AS alerts FROM p""")
def p_threshold_for_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts re-flagged for chosen budgets, the threshold interpolated."""
    pcts = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.3, 0.75, 1.5, 3.5, 7.0)], "pct double").withColumn("threshold", F.round(S.threshold_for_budget(c("pct")), 9))
    return scored(spark, sf_dir).join(F.broadcast(pcts), c("risk_score") >= c("threshold"), "right").groupBy("pct", "threshold").agg(F.count("event_id").alias("alerts"))


def alert_filter(df: DataFrame, min_risk: float | None = None, attack_type: str | None = None, entity: str | None = None, threshold: float | None = None) -> DataFrame:
    """Rows that meet every condition given."""
    for bad in (None if min_risk is None else c("risk_score") >= min_risk, None if attack_type is None else c("predicted_attack_type") == attack_type, None if entity is None else c("entity_id") == entity, None if threshold is None else c("risk_score") >= threshold):
        df = df if bad is None else df.where(bad)
    return df


@query(" SELECT event_id, risk_score FROM sc WHERE risk_score >= 20 AND predicted_attack_type = 'lateral_movement' AND entity_id = 'usr_5'")
def p_alert_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_filter(scored(spark, sf_dir), 20.0, "lateral_movement", "usr_5", 10.0).select("event_id", "risk_score")


@query(" SELECT event_id FROM sc WHERE entity_type = 'user' AND (contains(lower(entity_id), 'r7') OR contains(lower(event_id), 'r7') OR contains(lower(source_ip), 'r7') OR contains(lower(resource_accessed), 'r7') OR contains(lower(predicted_attack_type), 'r7'))")
def p_triage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = [F.lower(x).contains("r7") for x in (c("entity_id"), c("event_id"), c("source_ip"), c("resource_accessed"), c("predicted_attack_type"))]
    return scored(spark, sf_dir).where((c("entity_type") == "user") & (text[0] | text[1] | text[2] | text[3] | text[4])).select("event_id")


@query(" SELECT DISTINCT entity_id FROM ev WHERE contains(lower(entity_id), '_1')")
def p_entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_events(spark, sf_dir).where(F.lower("entity_id").contains("_1")).select("entity_id").distinct()


@query(" SELECT event_id, CASE WHEN bytes_transferred % 3 = 0 THEN 0.0 WHEN bytes_transferred % 3 = 1 THEN 1e6 ELSE -session_duration_s END AS x FROM ev")
def p_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = c("bytes_transferred") % 3
    x = F.when(kind == 0, F.when(c("bytes_transferred") % 2 == 0, F.lit(float("nan")))).when(kind == 1, F.lit(float("inf"))).otherwise(-c("session_duration_s"))
    return access_events(spark, sf_dir).select("event_id", S.clean(x, 1e6).alias("x"))


@query(" SELECT count(*) AS n, min(ts_us) AS first_us FROM ev WHERE ts_us >= 1704067200000000 + 24 * 86400000000")
def p_post_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_events(spark, sf_dir).where(c("ts_us") >= 1_704_067_200_000_000 + 24 * 86_400_000_000).agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"))


@query(" SELECT event_id, row_number() OVER (PARTITION BY entity_id ORDER BY ts_us, event_id) <= 25 AS cold FROM ev")
def p_cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_events(spark, sf_dir).select("event_id", (W.past_count("entity_id") < 25).alias("cold"))


@query(""" SELECT event_id, 'profile' AS detector, round(risk_score, 6) AS score FROM sc UNION ALL SELECT event_id, 'graph', round((bytes_transferred % 100) * 1.0, 6) FROM sc WHERE bytes_transferred % 2 = 0""")
def p_detectors_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).select("event_id", (c("risk_score") / 100).alias("profile"), F.when(c("bytes_transferred") % 2 == 0, (c("bytes_transferred") % 100) / 100).alias("graph"))
    return df.unpivot(["event_id"], ["profile", "graph"], "detector", "score").where("score IS NOT NULL").withColumn("score", F.round(c("score") * 100, 6))


# -- joins


@query(" SELECT sc.event_id, coalesce(is_anomaly AND ev2.k, false) AS is_anomaly FROM sc LEFT JOIN (SELECT lb.*, true AS k FROM lb WHERE label <> 'brute_force') ev2 ON ev2.event_id = sc.event_id")
def j_scores_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join; rows without a label count as no anomaly."""
    some = labels(spark, sf_dir).where("label <> 'brute_force'").select("event_id", "is_anomaly")
    return scored(spark, sf_dir).select("event_id").join(some, "event_id", "left").select("event_id", F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"))


@query(" SELECT event_id, label FROM lb WHERE event_id IN (SELECT event_id FROM ev WHERE split = 'val')")
def j_labels_of_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).join(access_events(spark, sf_dir).where("split = 'val'"), "event_id", "left_semi").select("event_id", "label")


@query(" SELECT DISTINCT entity_id FROM ev WHERE entity_id NOT IN (SELECT entity_id FROM ev WHERE split = 'train')")
def j_unseen_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = access_events(spark, sf_dir)
    return ev.select("entity_id").distinct().join(ev.where("split = 'train'"), "entity_id", "left_anti")


@query(" SELECT ev.event_id, ev.ts_us, lb.label FROM ev JOIN lb ON ev.event_id = lb.event_id")
def j_labels_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_events(spark, sf_dir).select("event_id", "ts_us").join(labels(spark, sf_dir).select("event_id", "label"), "event_id").orderBy("ts_us", "event_id")


@query(""", p AS (SELECT entity_id, avg(bytes_transferred) AS m FROM ev WHERE split = 'train' GROUP BY 1), q AS (SELECT cohort, avg(bytes_transferred) AS m FROM ev WHERE split = 'train' GROUP BY 1), g AS (SELECT avg(bytes_transferred) AS m FROM ev WHERE split = 'train')
SELECT event_id, round(coalesce(p.m, 0), 4) AS own, round(coalesce(p.m, q.m, g.m), 4) AS fallback FROM ev LEFT JOIN p ON p.entity_id = ev.entity_id LEFT JOIN q ON q.cohort = ev.cohort CROSS JOIN g WHERE split <> 'train'""")
def j_profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own mean, and own else cohort's else global mean."""
    ev = access_events(spark, sf_dir)
    train = ev.where("split = 'train'")
    own, peers, everyone = train.groupBy("entity_id").agg(F.avg("bytes_transferred").alias("e")), train.groupBy("cohort").agg(F.avg("bytes_transferred").alias("k")), train.agg(F.avg("bytes_transferred").alias("g"))
    out = ev.where("split <> 'train'").join(own, "entity_id", "left").join(peers, "cohort", "left").crossJoin(everyone)
    return out.select("event_id", F.round(F.coalesce("e", F.lit(0.0)), 4).alias("own"), F.round(F.coalesce("e", "k", "g"), 4).alias("fallback"))


@query(""" SELECT e.event_id, round(count(*) FILTER (t.session_duration_s <= e.session_duration_s) / count(*), 6) AS share FROM (SELECT * FROM ev WHERE split = 'test') e JOIN (SELECT * FROM ev WHERE split = 'train') t ON t.cohort = e.cohort GROUP BY 1""")
def j_ecdf_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = access_events(spark, sf_dir)
    return T.ecdf_rank(ev.where("split = 'test'"), "session_duration_s", ev.where("split = 'train'"), "session_duration_s", "share", "cohort").select("event_id", F.round("share", 6).alias("share"))


@query(""" SELECT e.event_id, p.resource_accessed AS resource, count(*) AS own, any_value(k.n) AS peers FROM ev e JOIN ev p ON p.entity_id = e.entity_id AND (p.ts_us, p.event_id) < (e.ts_us, e.event_id)
 JOIN (SELECT x.event_id, y.resource_accessed, count(*) AS n FROM ev x JOIN ev y ON y.cohort = x.cohort AND (y.ts_us, y.event_id) < (x.ts_us, x.event_id) GROUP BY ALL) k ON k.event_id = e.event_id AND k.resource_accessed = p.resource_accessed GROUP BY ALL""")
def j_counts_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event and resource its entity used before: uses by the entity and by its cohort until then."""
    ev = access_events(spark, sf_dir).select("event_id", "entity_id", "cohort", "ts_us", c("resource_accessed").alias("resource"))
    first = ev.groupBy("entity_id", "resource").agg(F.min(F.struct("ts_us", "event_id")).alias("at"))
    probe = ev.drop("resource").join(first, "entity_id").where(W.before(c("at.ts_us"), c("at.event_id"), c("ts_us"), c("event_id"))).drop("at").withColumn("one", F.lit(0))
    rows, order = probe.unionByName(ev.withColumn("one", F.lit(1))), ("ts_us", "event_id", "one")
    rows = rows.withColumns({"own": F.sum("one").over(W.past("entity_id", "resource", order=order)), "peers": F.sum("one").over(W.past("cohort", "resource", order=order))})
    return rows.where("one = 0").select("event_id", "resource", "own", "peers")


@query(" SELECT event_id, lag(geo_city) OVER w AS last_city, lag(ts_us) OVER w AS last_us FROM ev WINDOW w AS (PARTITION BY entity_id ORDER BY ts_us, event_id)")
def j_previous_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = W.ordered("entity_id")
    return access_events(spark, sf_dir).select("event_id", F.lag("geo_city").over(o).alias("last_city"), F.lag("ts_us").over(o).alias("last_us"))


SIMILAR_SQL = """, a AS (SELECT * FROM sc WHERE risk_score >= 65), s AS (SELECT x.event_id, y.event_id AS similar_id, abs(y.risk_score - x.risk_score) AS distance, row_number() OVER (PARTITION BY x.event_id ORDER BY abs(y.risk_score - x.risk_score), y.event_id) AS r
 FROM a x JOIN a y ON x.event_id <> y.event_id AND {on}) SELECT event_id, similar_id, round(distance, 6) AS distance FROM s WHERE r <= 5"""


@query(SIMILAR_SQL.format(on="x.predicted_attack_type = y.predicted_attack_type AND x.entity_id = y.entity_id"))
def j_similar_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.similar_alerts(scored(spark, sf_dir).where("risk_score >= 65")))


@query(""", p AS (SELECT DISTINCT geo_city AS place, geo_lat AS lat, geo_lon AS lon FROM ev) SELECT x.place AS a, y.place AS b, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians((y.lat - x.lat) / 2)), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians((y.lon - x.lon) / 2)), 2)))), 3) AS km
 FROM p x JOIN p y ON x.place < y.place WHERE km > 6000 AND km < 12000""")
def j_distance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = access_events(spark, sf_dir).select(c("geo_city").alias("place"), c("geo_lat").alias("lat"), c("geo_lon").alias("lon")).distinct()
    return T.distance_band(places, 6000, 12000).withColumn("km", F.round("km", 3))


# -- aggregations

PROFILED = ["session_duration_s", "bytes_transferred", "geo_lat"]


@query(" UNION ALL ".join(f" SELECT entity_id, '{x}' AS feature, count(*) AS n, round(avg({x}), 4) AS mean, round(var_pop({x}), 1) AS var FROM ev WHERE split = 'train' GROUP BY 1" for x in PROFILED))
def a_entity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = access_events(spark, sf_dir).where("split = 'train'").withColumn("bytes_transferred", c("bytes_transferred").cast("double"))
    return T.profile(df, "entity_id", PROFILED).withColumns({"mean": F.round("mean", 4), "var": F.round("var", 1)})


@query(" UNION ALL ".join(f" SELECT cohort, '{x}' AS feature, count(*) AS n, round(avg({x}), 4) AS mean, round(var_pop({x}), 1) AS var FROM ev WHERE split = 'train' GROUP BY 1" for x in PROFILED))
def a_cohort_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = access_events(spark, sf_dir).where("split = 'train'").withColumn("bytes_transferred", c("bytes_transferred").cast("double"))
    return T.profile(df, "cohort", PROFILED).withColumns({"mean": F.round("mean", 4), "var": F.round("var", 1)})


@query(" SELECT cohort, round(avg(session_duration_s), 5) AS d_mean, round(greatest(stddev_pop(session_duration_s), 1e-6), 5) AS d_std FROM ev GROUP BY GROUPING SETS ((cohort), ())")
def a_cohort_and_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.cohort_and_global(access_events(spark, sf_dir), "cohort", ["session_duration_s"])
    return out.select("cohort", F.round("session_duration_s_mean", 5).alias("d_mean"), F.round("session_duration_s_std", 5).alias("d_std"))


@query(" SELECT DISTINCT cohort, session_duration_s AS value, count(*) OVER (PARTITION BY cohort ORDER BY session_duration_s) AS at_most, count(*) OVER (PARTITION BY cohort) AS n FROM ev")
def a_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.distribution(access_events(spark, sf_dir), "session_duration_s", "cohort")


@query(" SELECT e.entity_id, CAST(h.hour AS INTEGER) AS hour, round(0.1 + count(ev.event_id), 6) AS weight FROM (SELECT DISTINCT entity_id FROM ev) e CROSS JOIN range(24) h(hour) LEFT JOIN ev ON ev.entity_id = e.entity_id AND (ev.ts_us // 3600000000) % 24 = h.hour GROUP BY ALL")
def a_hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.hour_histogram(access_events(spark, sf_dir), "entity_id"))


@query(" SELECT e.cohort, CAST(h.d AS INTEGER) AS weekday, round(0.1 + count(ev.event_id), 6) AS weight FROM (SELECT DISTINCT cohort FROM ev) e CROSS JOIN range(7) h(d) LEFT JOIN ev ON ev.cohort = e.cohort AND isodow(make_timestamp(ev.ts_us)) - 1 = h.d GROUP BY ALL")
def a_weekday_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.weekday_histogram(access_events(spark, sf_dir), "cohort"))


@query(" SELECT cohort, count(*) AS events, count(DISTINCT entity_id) AS entities, round(avg(bytes_transferred), 4) AS bytes_mean, round(avg(session_duration_s), 4) AS duration_mean, round(var_pop(session_duration_s), 3) AS duration_var FROM ev GROUP BY 1")
def a_cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_events(spark, sf_dir).groupBy("cohort").agg(F.count("*").alias("events"), F.countDistinct("entity_id").alias("entities"), F.round(F.avg("bytes_transferred"), 4).alias("bytes_mean"), F.round(F.avg("session_duration_s"), 4).alias("duration_mean"), F.round(F.var_pop("session_duration_s"), 3).alias("duration_var"))


@query(" SELECT cohort, 'auth_method' AS field, auth_method AS value, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT cohort, 'device_protocol', device_protocol, count(*) FROM ev GROUP BY ALL UNION ALL SELECT cohort, 'device_os', device_os, count(*) FROM ev GROUP BY ALL")
def a_cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.counts_long(access_events(spark, sf_dir), "cohort", ["auth_method", "device_protocol", "device_os"])


@query(" SELECT cohort, resource_accessed AS resource, count(DISTINCT entity_id) AS peers, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM ev GROUP BY 1, 2")
def a_peers_and_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers per cohort and resource, and the pair's share of all events."""
    ev = access_events(spark, sf_dir)
    total = ev.agg(F.count("*").alias("t"))
    return ev.groupBy("cohort", c("resource_accessed").alias("resource")).agg(F.countDistinct("entity_id").alias("peers"), F.count("*").alias("n")).crossJoin(total).select("cohort", "resource", "peers", F.round(c("n") / c("t"), 8).alias("share"))


@query(" SELECT resource_accessed AS resource, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM ev GROUP BY 1")
def a_resource_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each resource's share of all events."""
    ev = access_events(spark, sf_dir)
    total = ev.agg(F.count("*").alias("t"))
    return ev.groupBy(c("resource_accessed").alias("resource")).agg(F.count("*").alias("n")).crossJoin(total).select("resource", "n", F.round(c("n") / c("t"), 8).alias("share"))  # one row


@query(", m AS (SELECT source_ip, auth_method, count(*) AS n FROM ev GROUP BY ALL) SELECT source_ip, (SELECT count(*) FROM ev WHERE ev.source_ip = m.source_ip) AS events, (SELECT count(DISTINCT entity_id) FROM ev WHERE ev.source_ip = m.source_ip) AS entities, string_agg(auth_method || '=' || n, ';' ORDER BY auth_method) AS methods FROM m GROUP BY source_ip")
def a_source_ip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.source_ip_summary(access_events(spark, sf_dir))


@query(""", x AS (SELECT ev.*, lb.is_anomaly FROM ev JOIN lb ON lb.event_id = ev.event_id)
SELECT 'total' AS dimension, '' AS value, count(*) AS n, round(avg(is_anomaly::INT), 6) AS anomaly_rate FROM x UNION ALL SELECT 'split', split, count(*), round(avg(is_anomaly::INT), 6) FROM x GROUP BY split
UNION ALL SELECT 'entity_type', entity_type, count(*), round(avg(is_anomaly::INT), 6) FROM x GROUP BY entity_type UNION ALL SELECT 'label', label, count(*), round(avg(is_anomaly::INT), 6) FROM x GROUP BY label
UNION ALL SELECT 'cold_entities', '', count(DISTINCT entity_id), NULL FROM x WHERE entity_id NOT IN (SELECT entity_id FROM x WHERE split = 'train')""")
def a_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and anomaly rate in all and by split, entity type and label: one pass with grouping sets; and how many entities
    have no training rows."""
    df = labelled_events(spark, sf_dir).withColumn("a", c("label").isin(*ATTACKS).cast("double"))
    out = df.groupingSets([[], [c("split")], [c("entity_type")], [c("label")]], c("split"), c("entity_type"), c("label")).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("anomaly_rate"))
    out = out.select(F.when(c("g") == 7, "total").when(c("g") == 3, "split").when(c("g") == 5, "entity_type").otherwise("label").alias("dimension"), F.coalesce("split", "entity_type", "label", F.lit("")).alias("value"), "n", "anomaly_rate")
    cold = df.groupBy("entity_id").agg(F.max((c("split") == "train").cast("int")).alias("seen")).where("seen = 0")
    return out.unionByName(cold.agg(F.lit("cold_entities").alias("dimension"), F.lit("").alias("value"), F.count("*").alias("n"), F.lit(None).cast("double").alias("anomaly_rate")))


@query(" SELECT predicted_attack_type, count(*) AS processed, count(*) FILTER (risk_score >= 65) AS raised FROM sc GROUP BY 1")
def a_alert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("predicted_attack_type").agg(F.count("*").alias("processed"), F.sum((c("risk_score") >= 65).cast("long")).alias("raised"))


@query(" SELECT entity_id, round(median(bytes_transferred), 4) AS median_bytes FROM ev GROUP BY 1")
def a_median_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_events(spark, sf_dir).groupBy("entity_id").agg(F.round(F.median("bytes_transferred"), 4).alias("median_bytes"))


@query(" SELECT round(quantile_cont(bytes_transferred, 0.5), 3) AS p50, round(quantile_cont(bytes_transferred, 0.95), 3) AS p95, round(quantile_cont(bytes_transferred, 0.99), 3) AS p99, round(avg(bytes_transferred), 3) AS mean FROM ev")
def a_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.percentiles(access_events(spark, sf_dir), "bytes_transferred"), places=3)


@query(""", x AS (SELECT ev.* EXCLUDE (episode_id, label), lb.episode_id, lb.label FROM ev JOIN lb ON lb.event_id = ev.event_id WHERE lb.episode_id IS NOT NULL),
y AS (SELECT episode_id, min(label) AS label, count(*) FILTER (auth_result = 'failure') AS failures, count(DISTINCT ts_us // 86400000000) AS days, count(DISTINCT entity_id) AS entities, count(DISTINCT resource_accessed) AS resources, count(DISTINCT device_fingerprint) AS devices,
 first(geo_lat ORDER BY ts_us, event_id) AS a, first(geo_lon ORDER BY ts_us, event_id) AS b, last(geo_lat ORDER BY ts_us, event_id) AS c, last(geo_lon ORDER BY ts_us, event_id) AS d FROM x GROUP BY 1),
z AS (SELECT *, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)))) AS km FROM y)
SELECT episode_id, label, failures, days, entities, resources, devices, round(km, 4) AS km, CASE label WHEN 'brute_force' THEN failures >= 2 WHEN 'impossible_travel' THEN km > 50 WHEN 'credential_stuffing' THEN entities >= 2 WHEN 'lateral_movement' THEN resources >= 2 WHEN 'device_spoofing' THEN devices >= 2 WHEN 'low_and_slow_exfil' THEN days >= 2 END AS passes FROM z""")
def a_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.episodes(access_events(spark, sf_dir), labels(spark, sf_dir)).withColumn("km", F.round("km", 4))


@query(", p AS (SELECT cohort, unnest(list_zip(command_sequence[:-2], command_sequence[2:])) AS z FROM ev WHERE len(command_sequence) > 1) SELECT cohort, z[1] AS a, z[2] AS b, count(*) AS n FROM p GROUP BY ALL")
def a_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bigram_counts(access_events(spark, sf_dir), "cohort")


@query(""", t AS (SELECT entity_id, cohort, event_id, unnest(command_sequence) AS w, CAST(NULL AS VARCHAR) AS z FROM ev UNION ALL SELECT entity_id, cohort, event_id, NULL, unnest(list_transform(list_zip(command_sequence[:-2], command_sequence[2:]), lambda p: p[1] || chr(1) || p[2])) FROM ev WHERE len(command_sequence) > 1),
u AS (SELECT 'entity' AS level, entity_id AS key, w, z FROM t UNION ALL SELECT 'cohort', cohort, w, z FROM t UNION ALL SELECT 'all', '', w, z FROM t)
SELECT level, key, count(w) AS tokens, count(DISTINCT w) AS vocabulary, count(z) AS pairs, count(DISTINCT z) AS distinct_pairs FROM u GROUP BY ALL""")
def a_command_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands and pairs of commands, all and different ones, by entity, by cohort and over all: from counts by value."""
    return T.command_totals(access_events(spark, sf_dir))


@query(", d AS (SELECT cohort, entity_id, count(DISTINCT resource_accessed) AS degree FROM ev GROUP BY ALL) SELECT cohort, round(avg(degree), 6) AS mean, round(stddev_pop(degree), 6) AS std, CAST(sum(degree) AS BIGINT) AS edges FROM d GROUP BY 1")
def a_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = access_events(spark, sf_dir).groupBy("cohort", "entity_id").agg(F.countDistinct("resource_accessed").alias("degree"))
    return rounded(d.groupBy("cohort").agg(F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("std"), F.sum("degree").alias("edges")))


@query(", k AS (SELECT label, count(*) AS n FROM lb WHERE is_anomaly GROUP BY 1) SELECT label, round((SELECT sum(n) FROM k) / ((SELECT count(*) FROM k) * n), 8) AS weight FROM k")
def a_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = labels(spark, sf_dir).where("is_anomaly").groupBy("label").agg(F.count("*").alias("n"))
    t = k.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return k.crossJoin(t).select("label", F.round(c("total") / (c("classes") * c("n")), 8).alias("weight"))


@query(", h AS (SELECT entity_id, geo_city, count(*) AS n, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, geo_city) AS r FROM ev GROUP BY 1, 2) SELECT ev.entity_id, min(entity_type) AS entity_type, min(cohort) AS cohort, any_value(h.geo_city) AS home, count(*) FILTER (split = 'train') = 0 AS cold_start FROM ev JOIN h ON h.entity_id = ev.entity_id AND h.r = 1 GROUP BY 1")
def a_entity_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = access_events(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("n"), "geo_city"))
    home = ev.groupBy("entity_id", "geo_city").agg(F.count("*").alias("n")).withColumn("r", rank).where("r = 1").select("entity_id", c("geo_city").alias("home"))
    out = ev.groupBy("entity_id").agg(F.min("entity_type").alias("entity_type"), F.min("cohort").alias("cohort"), (F.sum((c("split") == "train").cast("long")) == 0).alias("cold_start"))
    return out.join(home, "entity_id")


# -- windows


@query(""" SELECT e.event_id, count(p.event_id) AS n, count(p.event_id) FILTER (p.ts_us >= e.ts_us - 3600000000) AS last_hour, CAST(coalesce(sum(p.bytes_transferred) FILTER (p.ts_us >= e.ts_us - 604800000000 AND p.auth_result = 'failure'), 0) AS BIGINT) AS failed_bytes_7d, count(DISTINCT p.resource_accessed) AS distinct_before,
 count(DISTINCT p.resource_accessed) FILTER (p.ts_us >= e.ts_us - 86400000000) AS distinct_24h, round(avg(p.geo_lat) + 1e-9, 6) AS mean_lat, min(p.ts_us) AS first_us, max(p.ts_us) AS last_us
 FROM ev e LEFT JOIN ev p ON p.entity_id = e.entity_id AND (p.ts_us, p.event_id) < (e.ts_us, e.event_id) GROUP BY 1""")
def w_past_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past-only count, rolling count and sum, distinct so far, rolling distinct, running mean, first and last."""
    ev, e = access_events(spark, sf_dir), "entity_id"
    df = ev.withColumn("ft", W.first_touch(e, "resource_accessed"))
    failed = F.when(c("auth_result") == "failure", c("bytes_transferred")).otherwise(0)
    df = df.select("event_id", e, "ts_us", "resource_accessed", W.past_count(e).alias("n"), W.rolling_count(3600, e).alias("last_hour"), W.rolling_sum(failed, 7 * 86400, e).alias("failed_bytes_7d"), W.running_distinct("ft", e).alias("distinct_before"), F.round(F.avg("geo_lat").over(W.past(e)) + 1e-9, 6).alias("mean_lat"), F.min("ts_us").over(W.past(e)).alias("first_us"), F.max("ts_us").over(W.past(e)).alias("last_us"))
    return W.with_rolling_distinct(df, "resource_accessed", 86400, "distinct_24h", e).drop("ts_us", e, "resource_accessed")


@query(""", o AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY ts_us, event_id) AS k FROM ev), f AS (SELECT *, max(CASE WHEN auth_result = 'success' THEN k END) OVER (PARTITION BY source_ip ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM o)
SELECT event_id, k - 1 - coalesce(s, 0) AS run, row_number() OVER (PARTITION BY source_ip, entity_id ORDER BY k) = 1 AS first_seen FROM f""")
def w_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row before an event, and first touches, by source IP."""
    df = W.with_run_length(access_events(spark, sf_dir), c("auth_result") == "failure", "run", "source_ip")
    return df.select("event_id", "run", (W.first_touch("source_ip", "entity_id") == 1).alias("first_seen"))


@query(", g AS (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY entity_id ORDER BY ts_us, event_id)) / 1e6 AS gap FROM ev) SELECT event_id, round(gap, 6) AS gap, count(gap) OVER w AS gap_n, round(avg(gap) OVER w + 1e-7, 4) AS gap_mean, round(stddev_pop(gap) OVER w + 1e-7, 3) AS gap_std FROM g WINDOW w AS (PARTITION BY entity_id ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and their statistics so far; a hair is added before rounding, so that exact ties go up in any order of summing."""
    df = W.with_gap_statistics(access_events(spark, sf_dir), "entity_id")
    return df.select("event_id", F.round("gap", 6).alias("gap"), "gap_n", F.round(c("gap_mean") + 1e-7, 4).alias("gap_mean"), F.round(c("gap_std") + 1e-7, 3).alias("gap_std"))


@query(""", o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts_us, event_id) AS k FROM ev),
r AS (SELECT entity_id, k, event_id, ts_us, CAST(bytes_transferred AS DOUBLE) AS m, CAST(bytes_transferred AS DOUBLE) AS q FROM o WHERE k = 1 UNION ALL
 SELECT o.entity_id, o.k, o.event_id, o.ts_us, r.m + (1 - exp(-ln(2) / 1209600.0 * ((o.ts_us - r.ts_us) / 1e6 + 1))) * (o.bytes_transferred - r.m), r.q + (1 - exp(-ln(2) / 1209600.0)) * (o.bytes_transferred - r.q) FROM r JOIN o ON o.entity_id = r.entity_id AND o.k = r.k + 1)
SELECT event_id, round(m, 4) AS ewma, round(q, 4) AS ewma_compat FROM r""")
def w_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = W.with_ewma(access_events(spark, sf_dir), "bytes_transferred", "ewma", 14.0, "entity_id")
    return W.with_ewma(df, "bytes_transferred", "ewma_compat", 14.0, "entity_id", compat=True).select("event_id", F.round("ewma", 4).alias("ewma"), F.round("ewma_compat", 4).alias("ewma_compat"))


@query(""", o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts_us, event_id) AS k FROM ev)
SELECT e.event_id, 16 AS size, CAST(greatest(0, 16 - max(e.k)) AS INTEGER) AS padding, sum(p.bytes_transferred * (16 - (e.k - p.k))) AS weighted FROM o e JOIN o p ON p.entity_id = e.entity_id AND p.k BETWEEN e.k - 15 AND e.k GROUP BY 1""")
def w_last_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 16 events as a padded array; summed with weights by position."""
    df = W.with_last_events(access_events(spark, sf_dir).withColumn("here", F.lit(1.0)), ["bytes_transferred", "here"], 16, "entity_id")
    weighted = F.aggregate(F.transform("window", lambda x, i: x["bytes_transferred"] * (i + 1)), F.lit(0.0), lambda a, x: a + x).cast("long")
    return df.select("event_id", F.size("window").alias("size"), F.size(F.filter("window", lambda x: x["here"] == 0)).alias("padding"), weighted.alias("weighted"))


@query(""", o AS (SELECT *, row_number() OVER w AS k, avg(risk_score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mean FROM sc WINDOW w AS (PARTITION BY entity_id ORDER BY ts_us, event_id)),
r AS (SELECT entity_id, k, event_id, greatest(0, risk_score - mean - 0.005) AS m FROM o WHERE k = 1 UNION ALL SELECT o.entity_id, o.k, o.event_id, greatest(0, r.m + o.risk_score - o.mean - 0.005) FROM r JOIN o ON o.entity_id = r.entity_id AND o.k = r.k + 1)
SELECT event_id, round(m + 1e-8, 5) AS ph_m, k >= 30 AND m > 50 AS ph_drift FROM r""")
def w_page_hinkley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_page_hinkley(scored(spark, sf_dir), "risk_score", "entity_id").select("event_id", F.round(c("ph_m") + 1e-8, 5).alias("ph_m"), "ph_drift")


@query(" SELECT event_id, count(*) OVER w AS n, CAST(coalesce(sum(bytes_transferred) OVER w, 0) AS BIGINT) AS bytes FROM ev WINDOW w AS (PARTITION BY cohort ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of a few very large groups in two levels."""
    df = W.with_bucketed_past(access_events(spark, sf_dir), {"n": F.lit(1), "bytes": c("bytes_transferred")}, "cohort")
    return df.select("event_id", "n", "bytes")


@query(" SELECT (ts_us // 3600000000) * 3600000000 AS start_us, count(*) AS events, round(count(*) / 3600.0, 8) AS rate FROM ev GROUP BY 1")
def w_event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per second in hours."""
    return access_events(spark, sf_dir).groupBy(F.window(F.timestamp_micros("ts_us"), "1 hour").alias("w")).agg(F.count("*").alias("events")).select(F.unix_micros("w.start").alias("start_us"), "events", F.round(c("events") / 3600.0, 8).alias("rate"))


# -- sorts, limits, top-k


@query(" SELECT event_id, ts_us FROM ev")
def t_stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_events(spark, sf_dir).select("event_id", "ts_us").orderBy("ts_us", "event_id")


@query(" SELECT event_id, risk_score, (SELECT count(*) FROM sc WHERE risk_score >= 40) AS total FROM sc WHERE risk_score >= 40 ORDER BY risk_score DESC, event_id LIMIT 20 OFFSET 10")
def t_alert_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of alerts by falling risk, and the total before paging."""
    hits = scored(spark, sf_dir).where("risk_score >= 40").select("event_id", "risk_score")
    return hits.orderBy(F.desc("risk_score"), "event_id").offset(10).limit(20).crossJoin(hits.agg(F.count("*").alias("total")))


@query(", r AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC, event_id) AS k, count(*) OVER () AS n FROM sc) SELECT pct, event_id FROM r, (VALUES (0.5), (1.0), (5.0)) b(pct) WHERE k <= greatest(1, floor(n * pct / 100))")
def t_budget_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = T.budget_rank(scored(spark, sf_dir).select("event_id", "risk_score"), "risk_score")
    n = df.agg(F.count("*").alias("n"))
    pct = spark.createDataFrame([(0.5,), (1.0,), (5.0,)], "pct double").join(n).withColumn("k", T.budget_size(c("n"), c("pct")))
    return df.join(F.broadcast(pct), c("position") <= c("k")).select("pct", "event_id")


@query(" SELECT round(quantile_cont(risk_score, 0.99), 6) AS p99 FROM sc")
def t_percentile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).agg(F.round(F.percentile("risk_score", 0.99), 6).alias("p99"))


@query(", p AS (SELECT entity_id, resource_accessed AS resource, count(*) AS n, min(ts_us) AS first FROM ev GROUP BY 1, 2), l AS (SELECT entity_id, max(ts_us) AS last FROM ev GROUP BY 1), r AS (SELECT p.*, last, row_number() OVER (PARTITION BY p.entity_id ORDER BY n DESC, resource) AS k FROM p JOIN l ON l.entity_id = p.entity_id) SELECT entity_id, resource, n, first >= last - 604800000000 AS is_new FROM r WHERE k <= 10")
def t_top_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.top_resources(access_events(spark, sf_dir))


@query(", r AS (SELECT entity_id, event_id, risk_score, row_number() OVER (PARTITION BY entity_id ORDER BY ts_us DESC, event_id DESC) AS k FROM sc) SELECT entity_id, event_id, risk_score FROM r WHERE k <= 200")
def t_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.newest(scored(spark, sf_dir), 200, "entity_id").select("entity_id", "event_id", "risk_score")


@query(" SELECT event_id FROM ev WHERE split = 'train' ORDER BY md5('7' || event_id) LIMIT 100")
def t_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.hash_sample(access_events(spark, sf_dir).where("split = 'train'").select("event_id"), 100, seed="7")


@query(" SELECT event_id FROM ev ORDER BY ts_us DESC, event_id DESC LIMIT 500")
def t_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.newest(access_events(spark, sf_dir), 500).select("event_id")


# -- set operations


@query(" SELECT event_id, label, CAST(NULL AS VARCHAR) AS note FROM lb WHERE is_anomaly UNION ALL SELECT event_id, NULL, 'clean' FROM lb WHERE NOT is_anomaly")
def u_union_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = labels(spark, sf_dir)
    return lb.where("is_anomaly").select("event_id", "label").unionByName(lb.where("NOT is_anomaly").select("event_id", F.lit("clean").alias("note")), allowMissingColumns=True)


@query(" SELECT entity_id FROM ev WHERE split = 'test' EXCEPT SELECT entity_id FROM ev WHERE split = 'train'")
def u_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = access_events(spark, sf_dir)
    return ev.where("split = 'test'").select("entity_id").subtract(ev.where("split = 'train'").select("entity_id"))


@query(", r AS (SELECT entity_id, cohort, list(DISTINCT resource_accessed) AS s FROM ev GROUP BY ALL), k AS (SELECT cohort, list(DISTINCT resource_accessed) AS t FROM ev GROUP BY ALL) SELECT entity_id, len(list_intersect(s, t)) AS both, len(list_distinct(list_concat(s, t))) AS either, round(len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t))), 8) AS jaccard FROM r JOIN k ON k.cohort = r.cohort")
def u_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of an entity's and its cohort's resources, by counting rows; no set is gathered."""
    ev = access_events(spark, sf_dir)
    own, peers = ev.select("entity_id", "cohort", "resource_accessed").distinct(), ev.select("cohort", "resource_accessed").distinct()
    both = own.join(peers, ["cohort", "resource_accessed"]).groupBy("entity_id", "cohort").agg(F.count("*").alias("both"))
    sizes = own.groupBy("entity_id").agg(F.count("*").alias("a"))
    out = both.join(sizes, "entity_id").join(peers.groupBy("cohort").agg(F.count("*").alias("b")), "cohort").withColumn("either", c("a") + c("b") - c("both"))
    return out.select("entity_id", "both", "either", F.round(c("both") / c("either"), 8).alias("jaccard"))


@query(" SELECT event_id FROM ev")
def u_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = access_events(spark, sf_dir).select("event_id")
    return ev.unionAll(ev).dropDuplicates(["event_id"])


# -- scalar functions


@query(""" SELECT event_id, CASE split_part(resource_accessed, ':', 1) WHEN 'fs' THEN 'file' WHEN 'api' THEN 'endpoint' WHEN 'port' THEN 'port' ELSE 'device_function' END AS kind, array_to_string(string_split(source_ip, '.')[1:3], '.') AS subnet, substr(device_mac, 1, 8) AS oui,
 substr(sha256(device_os || '|' || device_os_version || '|' || device_mac || '|' || device_protocol), 1, 16) AS fingerprint, substr(sha256(entity_id || '|' || ts_us), 1, 16) AS key, CAST((ts_us // 3600000000) % 24 AS INTEGER) AS hour, CAST(isodow(make_timestamp(ts_us)) - 1 AS INTEGER) AS weekday, (ts_us - 1704067200000000) // 86400000000 AS day,
 round(-log2(greatest((session_duration_s - 30) / 600, 1e-10)), 6) AS surprisal, round(1 / (1 + exp(-(session_duration_s - 300) / 100)), 8) AS sigmoid, round(greatest(-6, least(6, ln(greatest(1e-7, least(1 - 1e-7, session_duration_s / 700)) / (1 - greatest(1e-7, least(1 - 1e-7, session_duration_s / 700)))))), 8) AS logit,
 round((session_duration_s / (session_duration_s + 20)) * 2 + (20 / (session_duration_s + 20)) * 5, 8) AS shrunk, round(greatest(0, least(1, 1 - (session_duration_s - 100) / 400)), 8) AS unit, round((session_duration_s + 0.5) / (1000 + 0.5 * 7), 8) AS smoothed FROM ev""")
def sc_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = c("session_duration_s")
    out = access_events(spark, sf_dir).select(
        "event_id", S.resource_type(c("resource_accessed")).alias("kind"), S.subnet24(c("source_ip")).alias("subnet"), S.mac_oui(c("device_mac")).alias("oui"), S.fingerprint(c("device_os"), c("device_os_version"), c("device_mac"), c("device_protocol")).alias("fingerprint"),
        S.event_key(c("entity_id"), c("ts_us").cast("string")).alias("key"), S.utc_hour(c("ts_us")).alias("hour"), S.weekday(c("ts_us")).alias("weekday"), S.day_index(c("ts_us"), 1_704_067_200_000_000).alias("day"), F.round(S.surprisal((d - 30) / 600), 6).alias("surprisal"),
        F.round(S.sigmoid((d - 300) / 100), 8).alias("sigmoid"), F.round(S.logit(d / 700), 8).alias("logit"), F.round(S.shrink(F.lit(2.0), F.lit(5.0), d), 8).alias("shrunk"), F.round(S.inverted_unit(d, F.lit(100.0), F.lit(500.0)), 8).alias("unit"), F.round(S.smoothed(d, F.lit(1000), F.lit(7)), 8).alias("smoothed"),
    )
    return out


@query(""" SELECT event_id, CASE WHEN bytes_transferred < 1024 THEN bytes_transferred || ' B' WHEN bytes_transferred < 1048576 THEN printf('%.1f KB', round(bytes_transferred / 1024, 1)) ELSE printf('%.1f MB', round(bytes_transferred / 1048576, 1)) END AS size,
 CASE WHEN floor(session_duration_s * 9) >= 3600 THEN printf('%dh %dm', CAST(floor(session_duration_s * 9) AS BIGINT) // 3600, (CAST(floor(session_duration_s * 9) AS BIGINT) % 3600) // 60) WHEN floor(session_duration_s * 9) >= 60 THEN printf('%dm %ds', CAST(floor(session_duration_s * 9) AS BIGINT) // 60, CAST(floor(session_duration_s * 9) AS BIGINT) % 60) ELSE printf('%ds', CAST(floor(session_duration_s * 9) AS BIGINT)) END AS duration,
 CASE WHEN bytes_transferred >= 1e6 THEN printf('%.1fM', round(bytes_transferred / 1e6, 1)) WHEN bytes_transferred >= 1e3 THEN printf('%.1fk', round(bytes_transferred / 1e3, 1)) ELSE CAST(CAST(floor(bytes_transferred + 0.5) AS BIGINT) AS VARCHAR) END AS compact, printf('%.1f%%', round(session_duration_s / 10, 1)) AS percent FROM ev""")
def sc_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, durations, counts and shares for display; ties are rounded up."""
    b = c("bytes_transferred")
    return access_events(spark, sf_dir).select("event_id", S.bytes_text(b).alias("size"), S.duration_text(c("session_duration_s") * 9).alias("duration"), S.compact_text(b).alias("compact"), S.percent_text(c("session_duration_s") / 1000).alias("percent"))


@query("""SELECT a.vec_id, round(list_dot_product(a.embedding, b.embedding) / sqrt(list_dot_product(a.embedding, a.embedding) * list_dot_product(b.embedding, b.embedding)), 3) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""", raw=True)
def sc_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return e.alias("a").join(e.alias("b"), c("b.vec_id") == c("a.vec_id") + 1).select(c("a.vec_id").alias("vec_id"), F.round(S.cosine(c("a.embedding"), c("b.embedding")), 3).alias("cosine"))


@query(""", h AS (SELECT entity_id, cohort, list(n ORDER BY hour) AS p FROM (SELECT e.entity_id, any_value(e.cohort) AS cohort, h.hour, count(ev.event_id) AS n FROM (SELECT DISTINCT entity_id, cohort FROM ev) e CROSS JOIN range(24) h(hour) LEFT JOIN ev ON ev.entity_id = e.entity_id AND (ev.ts_us // 3600000000) % 24 = h.hour GROUP BY e.entity_id, h.hour) GROUP BY ALL),
u AS (SELECT h.entity_id, t.i, p[t.i] / list_sum(p) AS a, q.s[t.i] / list_sum(q.s) AS b FROM h JOIN (SELECT cohort, list(n ORDER BY hour) AS s FROM (SELECT c.cohort, r.hour, count(ev.event_id) AS n FROM (SELECT DISTINCT cohort FROM ev) c CROSS JOIN range(24) r(hour) LEFT JOIN ev ON ev.cohort = c.cohort AND (ev.ts_us // 3600000000) % 24 = r.hour GROUP BY ALL) GROUP BY cohort) q ON q.cohort = h.cohort, range(1, 25) t(i))
SELECT entity_id, round(sum(CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END) / 2, 6) AS js FROM u GROUP BY 1""")
def sc_js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of an entity's hours from its cohort's."""
    ev = access_events(spark, sf_dir)
    array = lambda df, k, n: df.groupBy(k).agg(F.transform(F.sort_array(F.collect_list(F.struct("hour", "weight"))), lambda x: x["weight"]).alias(n))
    own, peers = array(T.hour_histogram(ev, "entity_id", alpha=0.0), "entity_id", "p"), array(T.hour_histogram(ev, "cohort", alpha=0.0), "cohort", "q")
    return ev.select("entity_id", "cohort").distinct().join(own, "entity_id").join(peers, "cohort").select("entity_id", F.round(S.js_divergence(c("p"), c("q")), 6).alias("js"))
