"""Registered feature queries and their SQL, which recounts every feature from joins of each event with its past."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import features as X
from tidewatch.sources.access_events import DUCK_WITH, access_events

PLACES = 6


def rounded(df: DataFrame, keys: int = 1, places: int = PLACES) -> DataFrame:
    """All double columns rounded; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(n), places) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def _of(f, *names: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(access_events(spark, sf_dir))
        return rounded(out.select("event_id", *(names or [c for c in out.columns if c != "event_id"])))

    return run


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with how many events have each feature (a value other than 0) and its mean over all."""
    long = X.all_features(access_events(spark, sf_dir)).unpivot(["event_id"], list(X.NAMES), "name", "value")
    stats = long.groupBy("name").agg(F.count("*").alias("events"), F.sum((F.round("value", PLACES) != 0).cast("long")).alias("present"), F.avg("value").alias("mean"))
    return X.catalogue(spark).join(F.broadcast(stats), "name").withColumn("mean", F.round("mean", 4) + F.lit(0.0))


TEMPORAL = ("is_offhours", "inter_arrival_zscore", "burstiness", "entity_event_count", "is_cold_start_flag", "days_observed")
GEO = ("geo_velocity_kmh", "geo_centroid_distance_km", "new_country_flag", "new_subnet_flag", "source_ip_novelty")
RESOURCE = ("entity_novel_resource", "graph_entity_novel_resource", "distinct_resources_1h", "distinct_resources_24h", "resource_breadth_expansion_rate")
AUTH = ("auth_method_novelty", "entity_failure_count_5m", "entity_failure_count_1h", "entity_failure_count_24h", "entity_failure_ratio_1h", "success_after_failures")
DEVICE = ("fingerprint_unknown", "os_mismatch", "mac_oui_change", "protocol_novelty")
VOLUME = ("bytes_zscore", "offhours_bytes_rolling_7d", "transfer_to_duration_ratio")

QUERIES = {
    "f_temporal": _of(X.entity_features, *TEMPORAL),
    "f_geo": _of(X.entity_features, *GEO),
    "f_resource": _of(X.entity_features, *RESOURCE),
    "f_auth": _of(X.entity_features, *AUTH),
    "f_device": _of(X.entity_features, *DEVICE),
    "f_volume": _of(X.entity_features, *VOLUME),
    "f_source_ip": _of(X.ip_features),
    "f_cohort": _of(X.cohort_features),
    "f_commands": _of(X.command_features),
    "f_jaccard": _of(X.jaccard_feature),
    "f_divergence": _of(X.divergence_feature),
    "f_all": lambda spark, sf_dir: rounded(X.all_features(access_events(spark, sf_dir))),
    "f_catalogue": lambda spark, sf_dir: described(spark, sf_dir),
}

#: b: events numbered in total order; p: pairs of an event and an earlier one of the same entity.
BASE = f"""{DUCK_WITH},
b AS MATERIALIZED (SELECT ev.*, row_number() OVER (ORDER BY ts_us, event_id) AS i, (ts_us // 3600000000) % 24 AS hour, (ts_us // 86400000000 + 3) % 7 AS dow FROM ev),
"""
HAV = "CASE WHEN {a} IS NOT NULL THEN 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))) END"


def r(expr: str, name: str) -> str:
    return f"round(CAST(coalesce({expr}, 0) AS DOUBLE), {PLACES}) + 0.0 AS {name}"


def _seen(col: str) -> str:
    return f"CASE WHEN count(p.i) FILTER (p.{col} = e.{col}) = 0 THEN 1 ELSE 0 END"


PAIRS = "FROM b e LEFT JOIN b p ON p.entity_id = e.entity_id AND p.i < e.i GROUP BY e.i"
ONE = "any_value(e.event_id) AS event_id"

ORACLES = {
    "f_temporal": BASE + f"""g AS (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY entity_id ORDER BY i)) / 1e6 AS gap FROM b),
q AS (SELECT {ONE}, any_value(e.hour) AS hour, any_value(e.gap) AS gap, any_value(e.ts_us) AS ts_us, count(p.i) AS n, min(p.ts_us) AS first_us, count(p.gap) AS gn, avg(p.gap) AS gm, stddev_pop(p.gap) AS gs
  FROM g e LEFT JOIN g p ON p.entity_id = e.entity_id AND p.i < e.i GROUP BY e.i)
SELECT event_id, {r("CASE WHEN hour < 8 OR hour >= 18 THEN 1 ELSE 0 END", "is_offhours")}, {r("CASE WHEN gn >= 2 AND gs >= 1e-6 THEN (gap - gm) / gs END", "inter_arrival_zscore")},
  {r("CASE WHEN gn >= 2 AND gm >= 1e-6 THEN gs / gm END", "burstiness")}, {r("n", "entity_event_count")}, {r("CASE WHEN n < 25 THEN 1 ELSE 0 END", "is_cold_start_flag")}, {r("(ts_us - first_us) / 86400e6", "days_observed")} FROM q""",
    "f_geo": BASE + f"""q AS (SELECT {ONE}, any_value(e.geo_lat) AS lat, any_value(e.geo_lon) AS lon, any_value(e.ts_us) AS ts_us, arg_max(p.geo_lat, p.i) AS plat, arg_max(p.geo_lon, p.i) AS plon, max(p.ts_us) AS pts, avg(p.geo_lat) AS mlat, avg(p.geo_lon) AS mlon,
  {_seen("geo_country")} AS c, CASE WHEN count(p.i) FILTER (regexp_replace(p.source_ip, '[.][0-9]+$', '') = regexp_replace(e.source_ip, '[.][0-9]+$', '')) = 0 THEN 1 ELSE 0 END AS s, {_seen("source_ip")} AS ip {PAIRS})
SELECT event_id, {r("CASE WHEN ts_us > pts THEN " + HAV.format(a="plat", b="plon", c="lat", d="lon") + " / ((ts_us - pts) / 3600e6) END", "geo_velocity_kmh")}, {r(HAV.format(a="mlat", b="mlon", c="lat", d="lon"), "geo_centroid_distance_km")},
  {r("c", "new_country_flag")}, {r("s", "new_subnet_flag")}, {r("ip", "source_ip_novelty")} FROM q""",
    "f_resource": BASE + f"""q AS (SELECT {ONE}, {_seen("resource_accessed")} AS f, count(p.i) FILTER (p.ts_us >= e.ts_us - 3600000000) AS h, count(p.i) FILTER (p.ts_us >= e.ts_us - 86400000000) AS d, count(DISTINCT p.resource_accessed) AS k, count(p.i) AS n {PAIRS})
SELECT event_id, {r("f", "entity_novel_resource")}, {r("f", "graph_entity_novel_resource")}, {r("h", "distinct_resources_1h")}, {r("d", "distinct_resources_24h")}, {r("CASE WHEN n > 0 THEN k / n END", "resource_breadth_expansion_rate")} FROM q""",
    "f_auth": BASE + f"""q AS (SELECT {ONE}, any_value(e.auth_result) AS ar, {_seen("auth_method")} AS m, count(p.i) FILTER (p.auth_result = 'failure' AND p.ts_us >= e.ts_us - 300000000) AS a, count(p.i) FILTER (p.auth_result = 'failure' AND p.ts_us >= e.ts_us - 3600000000) AS h,
  count(p.i) FILTER (p.auth_result = 'failure' AND p.ts_us >= e.ts_us - 86400000000) AS d, count(p.i) FILTER (p.ts_us >= e.ts_us - 3600000000) AS t,
  count(p.i) FILTER (p.i > coalesce((SELECT max(z.i) FROM b z WHERE z.entity_id = e.entity_id AND z.i < e.i AND z.auth_result <> 'failure'), 0)) AS run FROM b e LEFT JOIN b p ON p.entity_id = e.entity_id AND p.i < e.i GROUP BY e.i, e.entity_id)
SELECT event_id, {r("m", "auth_method_novelty")}, {r("a", "entity_failure_count_5m")}, {r("h", "entity_failure_count_1h")}, {r("d", "entity_failure_count_24h")}, {r("h / (t + 1)", "entity_failure_ratio_1h")}, {r("CASE WHEN ar = 'success' AND run >= 3 THEN 1 ELSE 0 END", "success_after_failures")} FROM q""",
    "f_device": BASE + f"""q AS (SELECT {ONE}, {_seen("device_fingerprint")} AS f, {_seen("device_os")} AS o, CASE WHEN count(p.i) FILTER (substr(p.device_mac, 1, 8) = substr(e.device_mac, 1, 8)) = 0 THEN 1 ELSE 0 END AS m, {_seen("device_protocol")} AS p {PAIRS})
SELECT event_id, {r("f", "fingerprint_unknown")}, {r("o", "os_mismatch")}, {r("m", "mac_oui_change")}, {r("p", "protocol_novelty")} FROM q""",
    "f_volume": BASE + f"""o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY i) AS k FROM b),
w AS (SELECT entity_id, k, i, ts_us, CAST(bytes_transferred AS DOUBLE) AS m FROM o WHERE k = 1 UNION ALL
  SELECT o.entity_id, o.k, o.i, o.ts_us, (1 - exp(-ln(2) / 1209600.0 * ((o.ts_us - w.ts_us) / 1e6 + 1))) * o.bytes_transferred + exp(-ln(2) / 1209600.0 * ((o.ts_us - w.ts_us) / 1e6 + 1)) * w.m FROM w JOIN o ON o.entity_id = w.entity_id AND o.k = w.k + 1),
q AS (SELECT {ONE}, any_value(e.i) AS i, any_value(e.bytes_transferred) AS x, any_value(e.session_duration_s) AS dur, count(p.i) AS n, stddev_pop(p.session_duration_s) AS sd, max(p.i) AS pi,
  sum(p.bytes_transferred) FILTER ((p.hour < 8 OR p.hour >= 18) AND p.ts_us >= e.ts_us - 604800000000) AS off {PAIRS})
SELECT event_id, {r("CASE WHEN n >= 2 THEN (x - m) / greatest(100 * sd, 1) END", "bytes_zscore")}, {r("off", "offhours_bytes_rolling_7d")}, {r("CASE WHEN dur < 1 THEN x ELSE x / dur END", "transfer_to_duration_ratio")} FROM q LEFT JOIN w ON w.i = q.pi""",
    "f_source_ip": BASE + f"""q AS (SELECT {ONE}, count(p.i) FILTER (p.auth_result = 'failure' AND p.ts_us >= e.ts_us - 300000000) AS a, count(p.i) FILTER (p.auth_result = 'failure' AND p.ts_us >= e.ts_us - 3600000000) AS h, count(p.i) FILTER (p.auth_result = 'failure' AND p.ts_us >= e.ts_us - 86400000000) AS d,
  count(DISTINCT p.entity_id) AS n FROM b e LEFT JOIN b p ON p.source_ip = e.source_ip AND p.i < e.i GROUP BY e.i)
SELECT event_id, {r("a", "ip_failure_count_5m")}, {r("h", "ip_failure_count_1h")}, {r("d", "ip_failure_count_24h")}, {r("n", "distinct_entities_per_ip")} FROM q""",
    "f_cohort": BASE + f"""g AS (SELECT e.i, count(DISTINCT p.resource_accessed) AS deg, count(p.i) AS en, count(p.i) FILTER (p.hour = e.hour) AS eh, count(p.i) FILTER (p.dow = e.dow) AS ed {PAIRS}),
d AS (SELECT b.*, g.deg, g.en, g.eh, g.ed, coalesce(lag(deg) OVER (PARTITION BY entity_id ORDER BY b.i), 0) AS ld FROM b JOIN g ON g.i = b.i),
t AS (SELECT d.i, d.cohort, unnest(command_sequence) AS w FROM d),
f AS (SELECT cohort, w, min(i) AS i FROM t GROUP BY cohort, w),
v AS (SELECT e.i, count(f.w) AS v FROM b e LEFT JOIN f ON f.cohort = e.cohort AND f.i < e.i GROUP BY e.i),
q AS (SELECT e.i, {ONE}, any_value(e.en) AS en, any_value(e.eh) AS eh, any_value(e.ed) AS ed, any_value(e.ld) AS ld, any_value(len(e.command_sequence)) AS l, count(p.i) AS cn, count(p.i) FILTER (p.hour = e.hour) AS ch, count(p.i) FILTER (p.dow = e.dow) AS cd,
  count(p.i) FILTER (p.resource_accessed = e.resource_accessed) AS cr, count(DISTINCT p.entity_id) FILTER (p.resource_accessed = e.resource_accessed) AS peers, coalesce(sum(len(p.command_sequence)), 0) AS ct,
  count(p.i) FILTER (p.deg <> p.ld) AS dn, avg(p.deg) FILTER (p.deg <> p.ld) AS dm, stddev_pop(p.deg) FILTER (p.deg <> p.ld) AS ds
  FROM d e LEFT JOIN d p ON p.cohort = e.cohort AND p.i < e.i GROUP BY e.i),
z AS (SELECT q.*, en / (en + 20.0) AS w, ct / greatest(v, 1) AS ml FROM q JOIN v ON v.i = q.i)
SELECT event_id, {r("-log2(greatest((w * (0.1 + eh) + (1 - w) * (0.1 + ch)) / (w * (2.4 + en) + (1 - w) * (2.4 + cn)), 1e-10))", "hour_surprisal")}, {r("-log2(greatest((w * (0.1 + ed) + (1 - w) * (0.1 + cd)) / (w * (0.7 + en) + (1 - w) * (0.7 + cn)), 1e-10))", "weekday_surprisal")},
  {r("CASE WHEN cr = 0 THEN 1 ELSE 0 END", "cohort_novel_resource")}, {r("CASE WHEN ct > 0 THEN (l - ml) / greatest(1, sqrt(ml)) END", "sequence_length_zscore")}, {r("peers", "graph_peer_resource_count")}, {r("CASE WHEN dn >= 2 AND ds > 1e-6 THEN (ld - dm) / ds END", "graph_entity_degree_deviation")} FROM z""",
    "f_jaccard": BASE + f"""ed AS (SELECT cohort, entity_id, resource_accessed AS res, min(i) AS i FROM b GROUP BY ALL),
pe AS (SELECT e.i, e.cohort, e.entity_id, any_value(e.event_id) AS event_id, count(DISTINCT p.entity_id) AS peers FROM b e LEFT JOIN b p ON p.cohort = e.cohort AND p.i < e.i GROUP BY ALL),
c AS (SELECT pe.i, ed.res, count(*) AS n, max(CASE WHEN ed.entity_id = pe.entity_id THEN 1 ELSE 0 END) AS own FROM pe JOIN ed ON ed.cohort = pe.cohort AND ed.i < pe.i GROUP BY ALL),
q AS (SELECT pe.i, any_value(event_id) AS event_id, any_value(peers) AS peers, count(*) FILTER (own = 1 AND n >= greatest(1, peers // 10)) AS x, count(*) FILTER (own = 1 OR n >= greatest(1, peers // 10)) AS u FROM pe LEFT JOIN c ON c.i = pe.i GROUP BY pe.i)
SELECT event_id, {r("CASE WHEN peers > 0 AND u > 0 THEN x / u END", "graph_jaccard_vs_cohort")} FROM q""",
    "f_divergence": BASE + f"""c AS (SELECT e.i, p.resource_accessed AS res, count(*) FILTER (p.entity_id = e.entity_id) AS en, count(*) AS cn FROM b e JOIN b p ON p.cohort = e.cohort AND p.i < e.i GROUP BY ALL),
t AS (SELECT *, en / nullif(sum(en) OVER (PARTITION BY i), 0) AS p, cn / sum(cn) OVER (PARTITION BY i) AS q FROM c),
j AS (SELECT i, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + q * log2(2 * q / (p + q))) / 2 AS js FROM t WHERE p IS NOT NULL GROUP BY i)
SELECT event_id, {r("greatest(js, 0)", "resource_js_divergence")} FROM b LEFT JOIN j ON j.i = b.i""",
    "f_commands": BASE + f"""tk AS (SELECT i, event_id, entity_id, cohort, unnest(command_sequence) AS a FROM b),
bg AS (SELECT i, event_id, entity_id, cohort, command_sequence[j] AS a, command_sequence[j + 1] AS b2 FROM (SELECT *, unnest(range(1, len(command_sequence))) AS j FROM b WHERE len(command_sequence) > 1)),
k AS (SELECT e.i, any_value(e.event_id) AS event_id, any_value(len(e.command_sequence)) AS l, any_value(e.command_sequence[1]) AS c1, count(p.i) / (count(p.i) + 20.0) AS w {PAIRS}),
t AS (SELECT e.i, any_value(e.entity_id) AS entity_id, any_value(e.cohort) AS cohort, count(p.a) FILTER (p.entity_id = e.entity_id) AS et, count(DISTINCT p.a) FILTER (p.entity_id = e.entity_id) AS ev, count(p.a) FILTER (p.cohort = e.cohort) AS ct, count(DISTINCT p.a) FILTER (p.cohort = e.cohort) AS cv,
  count(p.a) AS gt, count(DISTINCT p.a) AS gv FROM (SELECT * FROM b WHERE len(command_sequence) > 0) e LEFT JOIN tk p ON p.i < e.i GROUP BY e.i),
ua AS (SELECT x.i, x.a, count(p.i) FILTER (p.entity_id = x.entity_id) AS ea, count(p.i) FILTER (p.cohort = x.cohort) AS ca, count(p.i) AS ga FROM (SELECT DISTINCT i, entity_id, cohort, a FROM tk) x LEFT JOIN tk p ON p.a = x.a AND p.i < x.i GROUP BY ALL),
ub AS (SELECT x.i, x.a, x.b2, count(p.i) FILTER (p.entity_id = x.entity_id) AS eab, count(p.i) FILTER (p.cohort = x.cohort) AS cab, count(p.i) AS gab FROM (SELECT DISTINCT i, entity_id, cohort, a, b2 FROM bg) x LEFT JOIN bg p ON p.a = x.a AND p.b2 = x.b2 AND p.i < x.i GROUP BY ALL),
pr AS (SELECT bg.i, ub.eab, k.w * (eab + 0.5) / (ea + 0.5 * greatest(ev, 1)) + (1 - k.w) * CASE WHEN ct > 0 THEN (cab + 0.5) / (ca + 0.5 * greatest(cv, 1)) WHEN gt > 0 THEN (gab + 0.5) / (ga + 0.5 * greatest(gv, 1)) ELSE 0.5 / greatest(ev + 1, 2) END AS p
  FROM bg JOIN ub ON ub.i = bg.i AND ub.a = bg.a AND ub.b2 = bg.b2 JOIN ua ON ua.i = bg.i AND ua.a = bg.a JOIN t ON t.i = bg.i JOIN k ON k.i = bg.i),
m AS (SELECT i, avg(-log2(greatest(p, 1e-10))) AS s, count(*) FILTER (eab = 0) AS u FROM pr GROUP BY i),
o AS (SELECT k.i, -log2(greatest(k.w * (ea + 0.5) / (et + 0.5 * greatest(ev, 1)) + (1 - k.w) * CASE WHEN ct > 0 THEN (ca + 0.5) / (ct + 0.5 * greatest(cv, 1)) WHEN gt > 0 THEN (ga + 0.5) / (gt + 0.5 * greatest(gv, 1)) ELSE 1.0 / greatest(ev, 1) END, 1e-10)) AS s
  FROM k JOIN ua ON ua.i = k.i AND ua.a = k.c1 JOIN t ON t.i = k.i WHERE k.l = 1)
SELECT k.event_id, {r("coalesce(m.s, o.s)", "command_surprisal")}, {r("m.u", "unseen_bigram_count")} FROM k LEFT JOIN m ON m.i = k.i LEFT JOIN o ON o.i = k.i""",
}


def _together() -> str:
    """All features, joined from the SQL of the parts."""
    parts = [k for k in QUERIES if k not in ("f_all", "f_catalogue")]
    return f"SELECT * FROM ({ORACLES[parts[0]]})" + "".join(f" JOIN ({ORACLES[k]}) USING (event_id)" for k in parts[1:])


ORACLES["f_all"] = _together()
ORACLES["f_catalogue"] = f"""WITH l AS (UNPIVOT (SELECT * EXCLUDE (event_id) FROM ({ORACLES["f_all"]})) ON COLUMNS(*) INTO NAME name VALUE value),
s AS (SELECT name, count(*) AS events, count(*) FILTER (value <> 0) AS present, round(avg(value), 4) + 0.0 AS mean FROM l GROUP BY 1),
k(position, name, display_name, direction, trusted_cold) AS (VALUES {", ".join(f"({i}, '{f.name}', '{f.display}', '{f.direction}', {f.trusted_cold})" for i, f in enumerate(X.FEATURES))})
SELECT CAST(k.position AS INTEGER) AS position, k.name, display_name, direction, trusted_cold, events, present, mean FROM k JOIN s ON s.name = k.name"""
