"""Access events: schema, checks, reading and writing, and the view that derives them from ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The event table's columns in order, with types and whether null is allowed.
EVENT_FIELDS = (
    ("event_id", "string", False), ("episode_id", "string", True), ("entity_id", "string", False), ("entity_type", "string", False), ("cohort", "string", False),
    ("timestamp", "timestamp", False), ("source_ip", "string", False), ("geo_country", "string", False), ("geo_city", "string", False), ("geo_lat", "double", False),
    ("geo_lon", "double", False), ("resource_accessed", "string", False), ("resource_type", "string", False), ("auth_method", "string", False), ("auth_result", "string", False),
    ("session_duration_s", "double", False), ("command_sequence", "array<string>", False), ("device_os", "string", False), ("device_os_version", "string", False),
    ("device_mac", "string", False), ("device_protocol", "string", False), ("device_fingerprint", "string", False), ("bytes_transferred", "bigint", False), ("split", "string", False),
)
LABEL_FIELDS = (("event_id", "string"), ("episode_id", "string"), ("label", "string"), ("is_anomaly", "boolean"), ("confounder_type", "string"), ("attack_stage", "string"))
FORBIDDEN = ("label", "is_anomaly", "confounder_type", "attack_stage")
#: Vocabularies.
ATTACKS = ("brute_force", "impossible_travel", "credential_stuffing", "lateral_movement", "device_spoofing", "low_and_slow_exfil")
NEGATIVES = ("normal", "insider_drift", "benign_confounder")
VOCABULARIES = {
    "entity_type": ("user", "service_account", "edge_device"),
    "resource_type": ("file", "endpoint", "port", "device_function"),
    "auth_method": ("password", "token", "certificate", "biometric", "mfa_push"),
    "auth_result": ("success", "failure"),
    "device_protocol": ("https", "ssh", "rdp", "smb", "modbus", "mqtt"),
    "split": ("train", "val", "test"),
}
RANGES = {"geo_lat": (-90.0, 90.0), "geo_lon": (-180.0, 180.0), "session_duration_s": (0.0, None), "bytes_transferred": (0, None)}

#: The derived view, for Spark and DuckDB alike; the placeholders hold what differs. A row per row of ``events``, an entity per user; every
#: 24th user is new in the last days (what came before is its neighbour's), and about 24 users make a cohort, so entities and
#: cohorts grow with the table.
VIEW = """
WITH q AS (SELECT event_id AS eid, user_id, event_type, value, {us} AS us, CAST({k} AS BIGINT) AS k FROM {events}),
o AS (SELECT *, CASE WHEN user_id % 24 = 3 AND (us - 1704067200000000) {div} 86400000000 < 21 THEN user_id + 1 ELSE user_id END AS w FROM q),
r AS (SELECT *, w % 24 AS u FROM o),
b AS (SELECT eid, w, u, event_type, value, k, (us {div} 3600000000) * 3600000000 + (us % 3600000000) {div} 12 AS ts_us,
       (us - 1704067200000000) {div} 86400000000 AS d,
       (u + CASE WHEN k % 13 = 0 THEN 1 + k % 3 ELSE 0 END) % 4 AS site,
       CASE WHEN k % 17 = 0 THEN k % 5 ELSE u % 3 END AS dev FROM r),
e AS (SELECT *, CASE WHEN event_type = 'error' AND k % 5 = 0 THEN 'brute_force'
            WHEN event_type = 'error' AND k % 7 = 0 THEN 'credential_stuffing'
            WHEN k % 13 = 0 AND k % 2 = 1 THEN 'impossible_travel'
            WHEN k % 13 = 0 OR k % 23 = 0 THEN 'benign_confounder'
            WHEN k % 17 = 0 THEN 'device_spoofing'
            WHEN k % 19 = 0 THEN 'lateral_movement'
            WHEN k % 29 = 0 THEN 'low_and_slow_exfil'
            WHEN k % 31 = 0 THEN 'insider_drift' ELSE 'normal' END AS label
      FROM b)
SELECT concat('e', CAST(eid AS {str})) AS event_id,
 CASE WHEN label <> 'normal' THEN concat('ep_', CAST(w AS {str}), '_', CAST(d AS {str}), '_', label) END AS episode_id,
 concat('usr_', CAST(w AS {str})) AS entity_id,
 CASE u % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'service_account' ELSE 'edge_device' END AS entity_type,
 concat('cohort_', CAST(w {div} 96 * 4 + u % 4 AS {str})) AS cohort,
 ts_us,
 concat('10.', CAST(10 + site AS {str}), '.', CAST(k % 5 AS {str}), '.', CAST(k % 3 AS {str})) AS source_ip,
 CASE site WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'SG' ELSE 'AU' END AS geo_country,
 CASE site WHEN 0 THEN 'New York' WHEN 1 THEN 'London' WHEN 2 THEN 'Singapore' ELSE 'Sydney' END AS geo_city,
 CAST(CASE site WHEN 0 THEN 40.71 WHEN 1 THEN 51.51 WHEN 2 THEN 1.35 ELSE -33.87 END AS DOUBLE) AS geo_lat,
 CAST(CASE site WHEN 0 THEN -74.01 WHEN 1 THEN -0.13 WHEN 2 THEN 103.82 ELSE 151.21 END AS DOUBLE) AS geo_lon,
 concat(CASE k % 4 WHEN 0 THEN 'fs:/r' WHEN 1 THEN 'api:/r' WHEN 2 THEN 'port:' ELSE 'func:r' END, CAST((u % 4) * 7 + k % 12 AS {str})) AS resource_accessed,
 CASE k % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'endpoint' WHEN 2 THEN 'port' ELSE 'device_function' END AS resource_type,
 CASE (u + k {div} 40) % 5 WHEN 0 THEN 'password' WHEN 1 THEN 'token' WHEN 2 THEN 'certificate' WHEN 3 THEN 'biometric' ELSE 'mfa_push' END AS auth_method,
 CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS auth_result,
 CAST(30 + (k * 37) % 600 AS DOUBLE) AS session_duration_s,
 CASE WHEN u % 2 = 1 THEN {empty} ELSE CASE k % 6 WHEN 0 THEN {empty} WHEN 1 THEN {arr}('ls') WHEN 2 THEN {arr}('ls','cat','exit')
      WHEN 3 THEN {arr}('git','build','deploy','build','deploy') WHEN 4 THEN {arr}('ssh','ls','cat','scp') ELSE {arr}('scan','dump','exfil') END END AS command_sequence,
 CASE dev WHEN 0 THEN 'Windows' WHEN 1 THEN 'Linux' WHEN 2 THEN 'macOS' ELSE 'Android' END AS device_os,
 CAST(10 + dev AS {str}) AS device_os_version,
 concat('aa:bb:0', CAST(dev AS {str}), ':00:00:', CAST(10 + u AS {str})) AS device_mac,
 CASE (u + dev) % 6 WHEN 0 THEN 'https' WHEN 1 THEN 'ssh' WHEN 2 THEN 'rdp' WHEN 3 THEN 'smb' WHEN 4 THEN 'modbus' ELSE 'mqtt' END AS device_protocol,
 concat('fp_', CAST(w AS {str}), '_', CAST(dev AS {str})) AS device_fingerprint,
 CAST(FLOOR(value * 1000) AS BIGINT) AS bytes_transferred,
 CASE WHEN d < 18 THEN 'train' WHEN d < 21 THEN 'val' ELSE 'test' END AS split,
 label
FROM e
"""

SPARK_VIEW = VIEW.format(us="unix_micros(from_utc_timestamp(CAST(ts AS TIMESTAMP), current_timezone()))", k="get_json_object(props, '$.k')", div="div", str="STRING", arr="array", empty="CAST(array() AS ARRAY<STRING>)", events="{raw}")
DUCK_VIEW = VIEW.format(us="epoch_us(ts)", k="json_extract(props, '$.k')", div="//", str="VARCHAR", arr="list_value", empty="CAST(list_value() AS VARCHAR[])", events="events")

#: CTEs an oracle starts with: the events, their labels and scores.
DUCK_WITH = f"""WITH RECURSIVE ev AS MATERIALIZED ({DUCK_VIEW}),
lb AS (SELECT event_id, episode_id, label, label IN {ATTACKS} AS is_anomaly,
   CASE WHEN label = 'benign_confounder' THEN 'legit_travel' END AS confounder_type,
   CASE WHEN label IN {ATTACKS} THEN CASE auth_result WHEN 'failure' THEN 'recon' ELSE 'action_on_objective' END END AS attack_stage FROM ev),
sc AS (SELECT ev.* EXCLUDE (label), CAST((bytes_transferred * 7919) % 10000 AS DOUBLE) / 100 AS risk_score,
   CASE WHEN bytes_transferred % 11 = 0 THEN 'brute_force' WHEN bytes_transferred % 13 = 0 THEN 'normal' WHEN label IN {ATTACKS} THEN label ELSE 'normal' END AS predicted_attack_type FROM ev)"""


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with its label column."""
    return spark.sql(SPARK_VIEW, raw=spark.read.parquet(f"{sf_dir}/events.parquet"))


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_events(spark, sf_dir).drop("label")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = labelled_events(spark, sf_dir)
    attack = F.col("label").isin(*ATTACKS)
    return ev.select(
        "event_id", "episode_id", "label", attack.alias("is_anomaly"),
        F.when(F.col("label") == "benign_confounder", "legit_travel").alias("confounder_type"),
        F.when(attack, F.when(F.col("auth_result") == "failure", "recon").otherwise("action_on_objective")).alias("attack_stage"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a deterministic risk score and predicted type (wrong for some), for the alert and evaluation operators."""
    ev = labelled_events(spark, sf_dir)
    risk = ((F.col("bytes_transferred") * 7919) % 10000).cast("double") / 100
    wrong = F.when(F.col("bytes_transferred") % 11 == 0, "brute_force").when(F.col("bytes_transferred") % 13 == 0, "normal")
    return ev.withColumn("risk_score", risk).withColumn("predicted_attack_type", wrong.when(F.col("label").isin(*ATTACKS), F.col("label")).otherwise("normal")).drop("label")


def declared(df: DataFrame) -> DataFrame:
    """The 24 declared columns, in order, from the view's ``ts_us`` form."""
    out = df.withColumn("timestamp", F.timestamp_micros("ts_us")) if "ts_us" in df.columns else df
    return out.select(*[F.col(n).cast(t).alias(n) for n, t, _ in EVENT_FIELDS])


class SchemaError(ValueError):
    pass


def check_columns(columns: list[str], expected: tuple[str, ...], kind: str) -> None:
    """Raises SchemaError on columns missing or unexpected, when the plan is made."""
    missing, extra = [c for c in expected if c not in columns], [c for c in columns if c not in expected]
    if missing or extra:
        raise SchemaError(f"{kind}: missing {missing}, unexpected {extra}")


def refuse_labels(columns: list[str]) -> None:
    """Events must not carry label columns."""
    if leaked := [c for c in FORBIDDEN if c in columns]:
        raise SchemaError(f"label columns among events: {leaked}")


def _canonical(df: DataFrame, fields: tuple) -> DataFrame:
    return df.select(*[F.col(f[0]).cast(f[1]).alias(f[0]) for f in fields])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Parquet events with exactly the declared columns, cast and in order. Checked from the footer schema."""
    df = spark.read.parquet(path)
    refuse_labels(df.columns)
    check_columns(df.columns, tuple(f[0] for f in EVENT_FIELDS), "events")
    return _canonical(df, EVENT_FIELDS)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    check_columns(df.columns, tuple(f[0] for f in LABEL_FIELDS), "labels")
    return _canonical(df, LABEL_FIELDS)


def write_events(df: DataFrame, path: str, partition_by_split: bool = False) -> None:
    """Declared columns as zstd Parquet; a null command list becomes an empty one."""
    refuse_labels(df.columns)
    check_columns(df.columns, tuple(f[0] for f in EVENT_FIELDS), "events")
    out = _canonical(df.withColumn("command_sequence", F.coalesce("command_sequence", F.array().cast("array<string>"))), EVENT_FIELDS)
    writer = out.write.option("compression", "zstd")
    (writer.partitionBy("split") if partition_by_split else writer).parquet(path)


def write_labels(df: DataFrame, path: str) -> None:
    check_columns(df.columns, tuple(f[0] for f in LABEL_FIELDS), "labels")
    _canonical(df, LABEL_FIELDS).write.option("compression", "zstd").parquet(path)


def violations(ranges: dict = RANGES, vocabularies: dict = VOCABULARIES) -> Column:
    """Array of the names of the columns whose value breaks its vocabulary, range or not-null rule."""
    bad = {n: F.col(n).isNull() for n, _, null in EVENT_FIELDS if not null}
    for n, words in vocabularies.items():
        bad[n] = bad[n] | ~F.col(n).isin(*words)
    for n, (lo, hi) in ranges.items():
        bad[n] = bad[n] | (F.col(n) < lo) | (F.col(n) > hi if hi is not None else F.lit(False))
    return F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in bad.items()]))


def validated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the others with their ``violations``."""
    out = df.withColumn("violations", violations())
    return out.where(F.size("violations") == 0).drop("violations"), out.where(F.size("violations") > 0)


def event_struct() -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string("string" if t == "timestamp" else t), True) for n, t, _ in EVENT_FIELDS])


def from_json_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Strict ingest of JSON events: ``event struct``, ``problem``: null or unparsable, missing or unknown fields.

    Times may be ISO-8601 with an offset or naive, which is read as UTC (the session's time zone).
    """
    names = [f[0] for f in EVENT_FIELDS]
    required = [n for n, _, null in EVENT_FIELDS if not null]
    keys = F.json_object_keys(F.col(column))
    problem = (
        F.when(keys.isNull(), F.lit("not an object"))
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, names)))) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(F.array_except(keys, F.array(*map(F.lit, names)))), ",")))
        .when(F.size(F.array_except(F.array(*map(F.lit, required)), keys)) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, required)), keys)), ",")))
    )
    parsed = lines.withColumn("event", F.from_json(column, event_struct())).withColumn("problem", problem)
    event = F.col("event").withField("timestamp", F.try_to_timestamp(F.col("event.timestamp")))
    return parsed.withColumn("event", F.when(F.col("problem").isNull(), event))


def to_json_lines(df: DataFrame) -> DataFrame:
    """``event_id, json``: rows as JSON with UTC times that end in Z."""
    return df.select("event_id", F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "timeZone": "UTC"}).alias("json"))


#: Share of events alerted on, in percent, and the risk from which that is.
BUDGET_THRESHOLDS = ((0.5, 65.0), (1.0, 50.0), (2.0, 40.0))


def budget_thresholds(spark: SparkSession, stored: DataFrame | None = None) -> DataFrame:
    """``budget, threshold``: stored values where there are any, else the defaults."""
    base = spark.createDataFrame(list(BUDGET_THRESHOLDS), "budget double, fallback double")
    if stored is None:
        return base.select("budget", F.col("fallback").alias("threshold"))
    return base.join(F.broadcast(stored), "budget", "left").select("budget", F.coalesce("threshold", "fallback").alias("threshold"))
