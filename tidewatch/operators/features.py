"""The 43 past-only behavioural features of access events, grouped by the key they are shuffled on.

Each function takes the access-event view (with ``ts_us``) and returns ``event_id`` and its features as
doubles. ``all_features`` joins them. The features of an event depend on earlier events alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.operators import windows as W
from tidewatch.sources.storage import stored

SHRINK_K, HALF_LIFE_DAYS, COLD_START, MIN_FAILURES, SMOOTHING, CENTROID_SHARE = 20.0, 14.0, 25, 3, 0.5, 10
DAY, HOUR = 86_400, 3_600
#: Events of a cohort that one task goes through in order.
SPAN = 20_000


@dataclass(frozen=True)
class Feature:
    name: str
    display: str
    direction: str  # increases_risk, decreases_risk or neutral
    trusted_cold: bool  # whether it means something for an entity with little history


#: The features' names, order, direction and trust; their titles are this library's own.
FEATURES = tuple(
    Feature(*x)
    for x in (
        ("hour_surprisal", "Rarity of the hour", "increases_risk", False), ("weekday_surprisal", "Rarity of the weekday", "increases_risk", False), ("is_offhours", "Outside working hours", "increases_risk", True),
        ("inter_arrival_zscore", "Pause before the event (z)", "increases_risk", False), ("burstiness", "Unevenness of pauses", "increases_risk", False), ("geo_velocity_kmh", "Speed of travel (km/h)", "increases_risk", True),
        ("geo_centroid_distance_km", "Distance from usual places (km)", "increases_risk", False), ("new_country_flag", "Country not seen before", "increases_risk", True), ("new_subnet_flag", "Network not seen before", "increases_risk", True),
        ("source_ip_novelty", "Address not seen before", "increases_risk", True), ("entity_novel_resource", "Resource new to the entity", "increases_risk", True), ("cohort_novel_resource", "Resource new to the cohort", "increases_risk", True),
        ("distinct_resources_1h", "Accesses within an hour", "increases_risk", False), ("distinct_resources_24h", "Accesses within a day", "increases_risk", False),
        ("resource_js_divergence", "Shift in use of resources", "increases_risk", False), ("resource_breadth_expansion_rate", "Growth of resources in use", "increases_risk", False),
        ("auth_method_novelty", "Login method not seen before", "increases_risk", True), ("entity_failure_count_5m", "Failed logins of the entity, 5 min", "increases_risk", True), ("entity_failure_count_1h", "Failed logins of the entity, 1 h", "increases_risk", True),
        ("entity_failure_count_24h", "Failed logins of the entity, 24 h", "increases_risk", True), ("entity_failure_ratio_1h", "Share of failed logins, 1 h", "increases_risk", True),
        ("ip_failure_count_5m", "Failed logins from the address, 5 min", "increases_risk", True), ("ip_failure_count_1h", "Failed logins from the address, 1 h", "increases_risk", True), ("ip_failure_count_24h", "Failed logins from the address, 24 h", "increases_risk", True),
        ("success_after_failures", "Login that follows failures", "increases_risk", True), ("distinct_entities_per_ip", "Entities behind the address", "increases_risk", True), ("fingerprint_unknown", "Device not seen before", "increases_risk", True),
        ("os_mismatch", "Operating system not seen before", "increases_risk", True), ("mac_oui_change", "Maker of the network card changed", "increases_risk", True), ("protocol_novelty", "Protocol not seen before", "increases_risk", True),
        ("command_surprisal", "Rarity of commands (bits each)", "increases_risk", False), ("unseen_bigram_count", "Pairs of commands not seen before", "increases_risk", False), ("sequence_length_zscore", "Number of commands (z)", "increases_risk", False),
        ("bytes_zscore", "Volume (z)", "increases_risk", False), ("offhours_bytes_rolling_7d", "Volume outside working hours, 7 days", "increases_risk", False), ("transfer_to_duration_ratio", "Volume a second", "increases_risk", True),
        ("graph_entity_novel_resource", "First link of entity and resource", "increases_risk", True), ("graph_peer_resource_count", "Peers that use the resource", "decreases_risk", True),
        ("graph_jaccard_vs_cohort", "Overlap with what the cohort uses", "decreases_risk", False), ("graph_entity_degree_deviation", "Number of resources against the cohort", "increases_risk", False),
        ("entity_event_count", "Events so far", "neutral", True), ("is_cold_start_flag", "Too little history", "neutral", True), ("days_observed", "Days since the first event", "neutral", True),
    )
)
NAMES = tuple(f.name for f in FEATURES)

#: Features a user adds: name to its description and a builder that makes a Column over the event view.
EXTRA: dict[str, tuple[Feature, Callable[[], Column]]] = {}


def register_feature(name: str, display: str, direction: str = "increases_risk", trusted_cold: bool = False):
    """Decorator: registers a function that returns a Column over the event view as a feature."""

    def add(builder: Callable[[], Column]) -> Callable[[], Column]:
        if name in NAMES or name in EXTRA:
            raise ValueError(f"feature {name} is there already")
        EXTRA[name] = (Feature(name, display, direction, trusted_cold), builder)
        return builder

    return add


def catalogue(spark: SparkSession) -> DataFrame:
    """Name, display name, direction and cold-start trust of every feature, in order."""
    rows = [(i, f.name, f.display, f.direction, f.trusted_cold) for i, f in enumerate([*FEATURES, *(f for f, _ in EXTRA.values())])]
    return spark.createDataFrame(rows, "position int, name string, display_name string, direction string, trusted_cold boolean")


def offhours(hour: Column) -> Column:
    return (hour < 8) | (hour >= 18)


def _doubles(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select("event_id", *[S.clean(c).alias(n) for n, c in cols.items()])


def entity_features(ev: DataFrame) -> DataFrame:
    """Features over an entity's own past: one shuffle on the entity."""
    e = "entity_id"
    hour = S.utc_hour(F.col("ts_us"))
    fail = F.col("auth_result") == "failure"
    df = ev.select(
        "event_id", e, "ts_us", "geo_lat", "geo_lon", "geo_country", "source_ip", "resource_accessed", "auth_method", "auth_result", "session_duration_s", "device_fingerprint", "device_os", "device_protocol", "bytes_transferred",
        hour.alias("hour"), S.weekday(F.col("ts_us")).alias("dow"), S.subnet24(F.col("source_ip")).alias("subnet"), S.mac_oui(F.col("device_mac")).alias("oui"),
    ).repartition(e)
    df = W.with_gap_statistics(df, e)
    df = W.with_run_length(df, fail, "fails_before", e)
    df = W.with_ewma(df, "bytes_transferred", "ewma", HALF_LIFE_DAYS, e)
    touches = {"ft_country": "geo_country", "ft_subnet": "subnet", "ft_ip": "source_ip", "ft_resource": "resource_accessed", "ft_auth": "auth_method", "ft_fp": "device_fingerprint", "ft_os": "device_os", "ft_oui": "oui", "ft_proto": "device_protocol"}
    df = df.withColumns({n: W.first_touch(e, c) for n, c in touches.items()})
    p, o = W.past(e), W.ordered(e)
    off_bytes = F.when(offhours(F.col("hour")), F.col("bytes_transferred")).otherwise(0)
    df = df.withColumns(
        {
            "n": W.past_count(e),
            "prev_lat": F.lag("geo_lat").over(o), "prev_lon": F.lag("geo_lon").over(o),
            "mean_lat": F.avg("geo_lat").over(p), "mean_lon": F.avg("geo_lon").over(p),
            "acc_1h": W.rolling_count(HOUR, e), "acc_24h": W.rolling_count(DAY, e),
            "f5": W.rolling_count(300, e, where=fail), "f60": W.rolling_count(HOUR, e, where=fail), "f24": W.rolling_count(DAY, e, where=fail),
            "off7": W.rolling_sum(off_bytes, 7 * DAY, e),
            "breadth": W.running_distinct("ft_resource", e),
            "prev_ewma": F.lag("ewma").over(o), "dur_std": F.stddev_pop("session_duration_s").over(p),
            "first_us": F.min("ts_us").over(p),
        }
    )
    c = F.col
    gap_h = c("gap") / HOUR
    return _doubles(
        df,
        is_offhours=offhours(c("hour")),
        inter_arrival_zscore=F.when((c("gap_n") >= 2) & (c("gap_std") >= 1e-6), (c("gap") - c("gap_mean")) / c("gap_std")),
        burstiness=F.when((c("gap_n") >= 2) & (c("gap_mean") >= 1e-6), c("gap_std") / c("gap_mean")),
        geo_velocity_kmh=F.when(gap_h > 0, S.haversine_km(c("prev_lat"), c("prev_lon"), c("geo_lat"), c("geo_lon")) / gap_h),
        geo_centroid_distance_km=S.haversine_km(c("mean_lat"), c("mean_lon"), c("geo_lat"), c("geo_lon")),
        new_country_flag=c("ft_country"), new_subnet_flag=c("ft_subnet"), source_ip_novelty=c("ft_ip"), entity_novel_resource=c("ft_resource"),
        distinct_resources_1h=c("acc_1h"), distinct_resources_24h=c("acc_24h"),
        resource_breadth_expansion_rate=F.when(c("n") > 0, c("breadth") / c("n")),
        auth_method_novelty=c("ft_auth"), entity_failure_count_5m=c("f5"), entity_failure_count_1h=c("f60"), entity_failure_count_24h=c("f24"),
        entity_failure_ratio_1h=c("f60") / (c("acc_1h") + 1),
        success_after_failures=(c("auth_result") == "success") & (c("fails_before") >= MIN_FAILURES),
        fingerprint_unknown=c("ft_fp"), os_mismatch=c("ft_os"), mac_oui_change=c("ft_oui"), protocol_novelty=c("ft_proto"),
        bytes_zscore=F.when(c("n") >= 2, (c("bytes_transferred") - c("prev_ewma")) / F.greatest(100 * c("dur_std"), F.lit(1.0))),
        offhours_bytes_rolling_7d=c("off7"),
        transfer_to_duration_ratio=F.when(c("session_duration_s") < 1, c("bytes_transferred")).otherwise(c("bytes_transferred") / c("session_duration_s")),
        graph_entity_novel_resource=c("ft_resource"),
        entity_event_count=c("n"), is_cold_start_flag=c("n") < COLD_START, days_observed=(c("ts_us") - c("first_us")) / (DAY * 1e6),
    )


def ip_features(ev: DataFrame) -> DataFrame:
    """Features over a source IP's past: one shuffle on the IP."""
    ip, fail = "source_ip", F.col("auth_result") == "failure"
    df = ev.select("event_id", ip, "entity_id", "ts_us", "auth_result").repartition(ip)
    df = df.withColumn("ft", W.first_touch(ip, "entity_id"))
    return _doubles(df, ip_failure_count_5m=W.rolling_count(300, ip, where=fail), ip_failure_count_1h=W.rolling_count(HOUR, ip, where=fail), ip_failure_count_24h=W.rolling_count(DAY, ip, where=fail), distinct_entities_per_ip=W.running_distinct("ft", ip))


def cohort_features(ev: DataFrame) -> DataFrame:
    """Features against the cohort's past. Totals of a whole cohort go through two levels (there are few cohorts)."""
    df = ev.select("event_id", "entity_id", "cohort", "ts_us", "resource_accessed", F.size("command_sequence").alias("n_tokens"), S.utc_hour(F.col("ts_us")).alias("hour"), S.weekday(F.col("ts_us")).alias("dow"))
    df = df.withColumns({"ft_edge": W.first_touch("entity_id", "resource_accessed"), "e_hour": W.past_count("entity_id", "hour"), "e_dow": W.past_count("entity_id", "dow"), "e_n": W.past_count("entity_id")})
    df = df.withColumn("deg", W.running_distinct("ft_edge", "entity_id"))
    df = df.withColumn("lag_deg", F.coalesce(F.lag("deg").over(W.ordered("entity_id")), F.lit(0)))
    changed = F.col("deg") != F.col("lag_deg")
    whole = {"c_n": F.lit(1), "c_tokens": F.col("n_tokens"), "d_n": changed.cast("long"), "d_sum": F.when(changed, F.col("deg")).otherwise(0), "d_sq": F.when(changed, F.col("deg") * F.col("deg")).otherwise(0)}
    used = {"c_res": F.lit(1), "peers": F.col("ft_edge")}
    df = W.with_bucketed_pasts(df, [({"c_hour": F.lit(1)}, ("cohort", "hour"), W.HOUR_US), ({"c_dow": F.lit(1)}, ("cohort", "dow"), W.HOUR_US), (used, ("cohort", "resource_accessed"), W.HOUR_US), (whole, ("cohort",), W.HOUR_US)])
    tokens = ev.select("event_id", "cohort", "ts_us", F.explode("command_sequence").alias("token"))
    # a vocabulary is small: the first use of each word, per cohort
    firsts = tokens.groupBy("cohort", "token").agg(F.min(F.struct("ts_us", "event_id")).alias("at"))
    by_event = firsts.groupBy("cohort", F.col("at.event_id").alias("event_id")).agg(F.count("*").alias("new_words")).drop("cohort")
    vocab = W.with_bucketed_past(ev.select("event_id", "cohort", "ts_us").join(by_event, "event_id", "left"), {"vocab": F.coalesce("new_words", F.lit(0))}, "cohort").select("event_id", "vocab")
    df = df.join(vocab, "event_id")
    c = F.col
    w = S.shrink_weight(c("e_n"), SHRINK_K)
    hour_p = (w * (0.1 + c("e_hour")) + (1 - w) * (0.1 + c("c_hour"))) / (w * (2.4 + c("e_n")) + (1 - w) * (2.4 + c("c_n")))
    dow_p = (w * (0.1 + c("e_dow")) + (1 - w) * (0.1 + c("c_dow"))) / (w * (0.7 + c("e_n")) + (1 - w) * (0.7 + c("c_n")))
    mean_len = c("c_tokens") / F.greatest(c("vocab"), F.lit(1))
    var = c("d_sq") / c("d_n") - F.pow(c("d_sum") / c("d_n"), 2)
    return _doubles(
        df,
        hour_surprisal=S.surprisal(hour_p), weekday_surprisal=S.surprisal(dow_p), cohort_novel_resource=c("c_res") == 0,
        sequence_length_zscore=F.when(c("c_tokens") > 0, (c("n_tokens") - mean_len) / F.greatest(F.lit(1.0), F.sqrt(mean_len))),
        graph_peer_resource_count=c("peers"),
        graph_entity_degree_deviation=F.when((c("d_n") >= 2) & (var > 1e-12), (c("lag_deg") - c("d_sum") / c("d_n")) / F.sqrt(var)),
    )


def command_features(ev: DataFrame) -> DataFrame:
    """Surprisal of an event's commands given earlier ones, and bigrams new to the entity.

    Tokens and bigrams become rows (event, a, b, times); a row's own position in the windows of
    (entity, a, b), (cohort, a, b) and so on gives the counts before it, so there is no as-of join.
    """
    base = ev.select("event_id", "entity_id", "cohort", "ts_us", "command_sequence", W.past_count("entity_id").alias("e_n"))
    full = base.where(F.size("command_sequence") > 0)
    tok = full.select("event_id", "entity_id", "cohort", "ts_us", F.explode("command_sequence").alias("a")).groupBy("event_id", "entity_id", "cohort", "ts_us", "a").agg(F.count("*").alias("m"))
    tok = tok.withColumn("e_a", W.past_sum(F.col("m"), "entity_id", "a"))
    tok = W.with_bucketed_pasts(tok, [({"c_a": F.col("m")}, ("cohort", "a"), W.HOUR_US), ({"g_a": F.col("m")}, ("a",), W.MINUTE_US)])
    # a first use is one before which there is none
    tok = stored(tok.withColumns({f"ft_{x}": (F.col(f"{x}_a") == 0).cast("int") for x in "ecg"}), "tokens")
    per = tok.groupBy("event_id").agg(F.sum("m").alias("m"), F.sum("ft_e").alias("ft_e"), F.sum("ft_c").alias("ft_c"), F.sum("ft_g").alias("ft_g"))
    per = full.select("event_id", "entity_id", "cohort", "ts_us").join(per, "event_id")
    per = per.withColumns({"e_tot": W.past_sum(F.col("m"), "entity_id"), "e_v": W.past_sum(F.col("ft_e"), "entity_id"), "everyone": F.lit(0)})
    per = W.with_bucketed_pasts(per, [({"c_tot": F.col("m"), "c_v": F.col("ft_c")}, ("cohort",), W.HOUR_US), ({"g_tot": F.col("m"), "g_v": F.col("ft_g")}, ("everyone",), W.MINUTE_US)]).select("event_id", "e_tot", "e_v", "c_tot", "c_v", "g_tot", "g_v")
    pairs = full.where(F.size("command_sequence") > 1).select("event_id", "entity_id", "cohort", "ts_us", F.explode(S.bigrams(F.col("command_sequence"))).alias("p"))
    pairs = pairs.groupBy("event_id", "entity_id", "cohort", "ts_us", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("m"))
    pairs = pairs.withColumn("e_ab", W.past_sum(F.col("m"), "entity_id", "a", "b"))
    pairs = W.with_bucketed_pasts(pairs, [({"c_ab": F.col("m")}, ("cohort", "a", "b"), W.HOUR_US), ({"g_ab": F.col("m")}, ("a", "b"), W.MINUTE_US)])
    weight = full.select("event_id", S.shrink_weight(F.col("e_n"), SHRINK_K).alias("w"), F.size("command_sequence").alias("len"))
    c = F.col
    pairs = pairs.join(tok.select("event_id", "a", "e_a", "c_a", "g_a"), ["event_id", "a"]).join(per, "event_id").join(weight, "event_id")
    back = F.when(c("c_tot") > 0, S.smoothed(c("c_ab"), c("c_a"), c("c_v"), SMOOTHING)).when(c("g_tot") > 0, S.smoothed(c("g_ab"), c("g_a"), c("g_v"), SMOOTHING)).otherwise(SMOOTHING / F.greatest(c("e_v") + 1, F.lit(2)))
    prob = c("w") * S.smoothed(c("e_ab"), c("e_a"), c("e_v"), SMOOTHING) + (1 - c("w")) * back
    many = pairs.groupBy("event_id").agg((F.sum(c("m") * S.surprisal(prob)) / F.sum("m")).alias("command_surprisal"), F.sum(F.when(c("e_ab") == 0, c("m")).otherwise(0)).alias("unseen_bigram_count"))
    one = tok.join(per, "event_id").join(weight.where("len = 1"), "event_id")
    back1 = F.when(c("c_tot") > 0, S.smoothed(c("c_a"), c("c_tot"), c("c_v"), SMOOTHING)).when(c("g_tot") > 0, S.smoothed(c("g_a"), c("g_tot"), c("g_v"), SMOOTHING)).otherwise(1 / F.greatest(c("e_v"), F.lit(1)))
    single = one.select("event_id", S.surprisal(c("w") * S.smoothed(c("e_a"), c("e_tot"), c("e_v"), SMOOTHING) + (1 - c("w")) * back1).alias("command_surprisal"), F.lit(0).alias("unseen_bigram_count"))
    out = base.select("event_id").join(many.unionByName(single), "event_id", "left")
    return _doubles(out, command_surprisal=c("command_surprisal"), unseen_bigram_count=c("unseen_bigram_count"))


def edges(ev: DataFrame) -> DataFrame:
    """First accesses: ``cohort, entity_id, resource, at`` with ``at`` the struct (ts_us, event_id)."""
    return ev.groupBy("cohort", "entity_id", F.col("resource_accessed").alias("resource")).agg(F.min(F.struct("ts_us", "event_id")).alias("at"))


def _marked(ev: DataFrame) -> DataFrame:
    """Events with what they add: ``first`` for an entity's first access of a resource in its cohort, ``new_peers`` for its first event there."""
    first = edges(ev).select(F.col("at.event_id").alias("event_id"), F.lit(1).alias("first"))
    peers = ev.groupBy("cohort", "entity_id").agg(F.min(F.struct("ts_us", "event_id")).alias("at")).select(F.col("at.event_id").alias("event_id"), F.lit(1).alias("new_peers"))
    out = ev.select("event_id", "entity_id", "cohort", "ts_us", F.col("resource_accessed").alias("resource")).join(first, "event_id", "left").join(peers, "event_id", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("first", "new_peers")})


def _against_cohort(ev: DataFrame) -> DataFrame:
    """``event_id, cohort, ts_us, peers, own, m, divergence, overlap``: how each event's entity stands to its cohort just before it.

    A cohort's events are cut in the order of time into spans of SPAN events. Counts before a span are running sums over rows by
    (entity, resource, span) and (cohort, resource, span); each span then goes once through its events, with its entities' counts as vectors
    (``_walk_span``). So a row an event is shuffled, and a row per span and resource of an entity that is active in it, but none per
    event and resource; no task has more than SPAN events and the resources of their entities. An entity that changes its cohort has its
    events in the spans of all its cohorts, where those of others add to its own counts alone.
    """
    homes = ev.select("entity_id", F.col("cohort").alias("home")).distinct()
    rows = _marked(ev).join(homes, "entity_id").withColumn("here", (F.col("cohort") == F.col("home")).cast("int"))
    rows = rows.select("event_id", "entity_id", F.col("home").alias("cohort"), "ts_us", "resource", "here", (F.col("first") * F.col("here")).alias("first"), (F.col("new_peers") * F.col("here")).alias("new_peers"), F.col("first").alias("edge"))
    rows = W.with_bucketed_past(rows, {"c_n": F.col("here"), "peers": F.col("new_peers"), "place": F.lit(1)}, "cohort")
    mine = ("cohort", "entity_id")
    rows = rows.withColumns({"e_n": W.past_count(*mine), "own": W.past_sum(F.col("edge"), *mine), "span": F.floor(F.col("place") / SPAN), "m": F.greatest(F.lit(1), F.floor(F.col("peers") / CENTROID_SHARE)).cast("int")})
    rows = stored(rows.drop("place", "edge", "new_peers"), "spans")
    added = rows.groupBy("cohort", "entity_id", "resource", "span").agg(F.count("*").alias("a"), F.sum("here").alias("c"), F.sum("first").alias("p"))
    since = added.groupBy("cohort", "entity_id", "resource").agg(F.min("span").alias("since"))
    asked = added.select("cohort", "entity_id", "span").distinct().join(since, list(mine)).where("since < span").drop("since")
    so_far = lambda *keys: Window.partitionBy("cohort", *keys, "resource").orderBy("span").rangeBetween(Window.unboundedPreceding, -1)
    held = asked.withColumns({"a": F.lit(0), "kind": F.lit(0)}).unionByName(added.drop("c", "p").withColumn("kind", F.lit(2)))
    held = held.withColumn("a", F.sum("a").over(so_far("entity_id"))).where("kind = 0").withColumn("b", F.lit(0))
    shared = added.drop("a", "entity_id").unionByName(asked.drop("entity_id").withColumns({"c": F.lit(0), "p": F.lit(0)})).groupBy("cohort", "resource", "span").agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
    shared = shared.select("cohort", "resource", "span", F.lit(1).alias("kind"), *[F.coalesce(F.sum(n).over(so_far()), F.lit(0)).alias(k) for n, k in (("c", "a"), ("p", "b"))])
    events = rows.select("cohort", "entity_id", "resource", "span", "event_id", "ts_us", "c_n", "e_n", "m", F.col("here").alias("a"), F.col("first").alias("b"), F.lit(2).alias("kind"))
    parts = events.unionByName(held, allowMissingColumns=True).unionByName(shared, allowMissingColumns=True)
    walked = parts.groupBy("cohort", "span").applyInPandas(_walk_span, "event_id string, divergence double, overlap long")
    return rows.where("here = 1").select("event_id", "cohort", "ts_us", "peers", "own", "m").join(walked, "event_id")


def _walk_span(g: pd.DataFrame) -> pd.DataFrame:
    """The events of a span in order: kind 0 has an entity's count of a resource before the span, 1 the cohort's and the number of peers,
    2 the events. Vectors are over the resources that an entity has here."""
    resource = pd.factorize(g["resource"], use_na_sentinel=False)[0]
    entity = pd.factorize(g["entity_id"])[0]
    kind, a, b = (g[n].to_numpy(np.int64) for n in ("kind", "a", "b"))
    width = resource.max() + 1
    total, peers = np.zeros(width), np.zeros(width, np.int64)
    total[resource[kind == 1]], peers[resource[kind == 1]] = a[kind == 1], b[kind == 1]
    cell = entity * width + resource
    cells = np.unique(cell[kind != 1])
    column, begins = cells % width, np.searchsorted(cells, np.arange(entity.max() + 2) * width)
    slot = np.searchsorted(cells, cell)
    counts = np.zeros(len(cells))
    counts[slot[kind == 0]] = a[kind == 0]
    events = g[kind == 2]
    order = np.flatnonzero(kind == 2)[np.lexsort((events["event_id"].to_numpy(str), events["ts_us"].to_numpy(np.int64)))]
    e_n, c_n, m = (g[n].fillna(0).to_numpy(np.int64) for n in ("e_n", "c_n", "m"))
    divergence, overlap = np.zeros(len(g)), np.zeros(len(g), np.int64)
    for i in order.tolist():
        if a[i]:
            at = slice(begins[entity[i]], begins[entity[i] + 1])
            has = np.flatnonzero(counts[at])
            if len(has):
                met = column[at][has]
                overlap[i] = np.count_nonzero(peers[met] >= m[i])
                p, q = counts[at][has] / e_n[i], total[met] / max(c_n[i], 1)
                terms = p * np.log2(2 * p / (p + q)) + q * np.log2(np.where(q > 0, 2 * q / (p + q), 1.0)) - q
                divergence[i] = max(terms.sum() / 2 + 0.5, 0.0)
        counts[slot[i]] += 1
        total[resource[i]] += a[i]
        peers[resource[i]] += b[i]
    out = order[a[order] == 1]
    return pd.DataFrame({"event_id": g["event_id"].to_numpy()[out], "divergence": divergence[out], "overlap": overlap[out]})


def _jaccard(ev: DataFrame, stand: DataFrame) -> DataFrame:
    """With m the number of peers needed at an event, the centroid's size is how many resources had their m-th peer before it: running counts
    over events and first accesses together."""
    ranked = edges(ev).withColumn("m", F.row_number().over(Window.partitionBy("cohort", "resource").orderBy("at")))
    reached = ranked.join(stand.select("cohort", "m").distinct(), ["cohort", "m"])
    rows = reached.select("cohort", "m", "at.ts_us", "at.event_id", F.lit(1).alias("one"), F.lit(1).alias("kind")).unionByName(stand.select("cohort", "m", "ts_us", "event_id", F.lit(0).alias("one"), F.lit(0).alias("kind")))
    centroid = W.with_bucketed_past(rows, {"centroid": F.col("one")}, "cohort", "m", order=("ts_us", "event_id", "kind")).where("kind = 0").select("event_id", "centroid")
    union = F.col("own") + F.col("centroid") - F.col("overlap")
    return _doubles(stand.join(centroid, "event_id"), graph_jaccard_vs_cohort=F.when((F.col("peers") > 0) & (union > 0), F.col("overlap") / union))


def jaccard_feature(ev: DataFrame) -> DataFrame:
    """Jaccard similarity of what the entity has accessed and the cohort's centroid: resources that a tenth of
    the peers, at least one, have accessed."""
    return _jaccard(ev, stored(_against_cohort(ev), "stand"))


def divergence_feature(ev: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence of the entity's resource counts and its cohort's, both before the event.

    Only resources the entity has accessed have terms of their own; the others add their cohort share.
    """
    return _doubles(_against_cohort(ev), resource_js_divergence=F.col("divergence"))


def cohort_overlap_features(ev: DataFrame) -> DataFrame:
    """``jaccard_feature`` and ``divergence_feature`` from one pass over the events."""
    stand = stored(_against_cohort(ev), "stand")
    return _jaccard(ev, stand).join(_doubles(stand, resource_js_divergence=F.col("divergence")), "event_id")


def extra_features(ev: DataFrame) -> DataFrame | None:
    return _doubles(ev, **{n: b() for n, (_, b) in EXTRA.items()}) if EXTRA else None


def all_features(ev: DataFrame) -> DataFrame:
    """``event_id`` and all 43 features (and registered ones), in the catalogue's order.

    The events are written once, so that what they are derived from is read and parsed once for all families.
    """
    ev = stored(ev, "events")
    frames = [entity_features(ev), ip_features(ev), cohort_features(ev), command_features(ev), cohort_overlap_features(ev)]
    if (extra := extra_features(ev)) is not None:
        frames.append(extra)
    return W.join_all(frames).select("event_id", *NAMES, *EXTRA)
