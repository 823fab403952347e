"""Detectors, fusion, signature rules and explanations over feature rows.

Fitting is a Spark aggregate, scoring a projection after joins with what was fitted. Feature rows are the
43 feature columns with ``event_id, entity_id, cohort, split``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.operators import tables as T
from tidewatch.operators import windows as W
from tidewatch.operators.features import NAMES
from tidewatch.sources.storage import stored

Z_CLIP, MIN_VARIANCE, SHRINK_K = 5.0, 1e-6, 20.0
#: Fusion weights, prior log-odds, and the rows a distribution needs before ranks count.
WEIGHTS = {"profile": 1.00, "isolation": 0.85, "sequence": 0.80, "graph": 0.70, "gru": 0.60}
BIAS, MIN_WINDOW, WARMUP = -3.0, 500, 0.5
#: Weights of the graph detector's parts.
GRAPH_WEIGHTS = (0.35, 0.25, 0.20, 0.20)
SEQUENCE_FEATURES = ("command_surprisal", "unseen_bigram_count", "sequence_length_zscore")
GRAPH_FEATURES = ("graph_entity_novel_resource", "graph_peer_resource_count", "graph_jaccard_vs_cohort", "graph_entity_degree_deviation")

c = F.col


def fit_profiles(train: DataFrame, names: tuple[str, ...] = NAMES) -> tuple[DataFrame, DataFrame]:
    """Means and variances of every feature by entity and by cohort."""
    return T.profile_wide(train, "entity_id", names), T.profile_wide(train, "cohort", names)


def profile_scores(rows: DataFrame, entities: DataFrame, cohorts: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Adds ``z array`` (shrunk z-scores, clipped), ``rms_z`` and ``profile`` (rms_z / 5, at most 1).

    An entity's statistics weigh n / (n + 20) against its cohort's; what isn't known counts as 0. Detectors' scores are rounded, since they are
    ranked and sums differ in their last bits from run to run.
    """
    stats = joined_stats(rows, entities, cohorts, names)
    same = c("entity_id").eqNullSafe(c("_e")) & c("cohort").eqNullSafe(c("_k"))
    out = rows.join(stats, same, "left")
    z = lambda i, name: F.greatest(F.lit(-Z_CLIP), F.least(F.lit(Z_CLIP), (c(name) - F.get("_m", F.lit(i))) / F.get("_s", F.lit(i))))
    out = out.withColumn("z", F.array(*[z(i, n) for i, n in enumerate(names)])).drop(*stats.columns)
    out = out.withColumn("rms_z", F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x) / len(names)))
    return out.withColumn("profile", F.least(F.lit(1.0), F.round("rms_z", 6) / 5))


def joined_stats(rows: DataFrame, entities: DataFrame, cohorts: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """``_e, _k, _m array, _s array, _c array``: for each entity in its cohort the means and deviations that z-scores are taken by, and the cohort's means. The few rows of
    statistics meet here, so that feature rows are dealt out once."""
    e = entities.select(c("entity_id").alias("_e"), c("n").alias("_n"), c("mean").alias("_em"), c("var").alias("_ev"))
    k = cohorts.select(c("cohort").alias("_k"), c("mean").alias("_cm"), c("var").alias("_cv"))
    out = rows.select(c("entity_id").alias("_e"), c("cohort").alias("_k")).distinct().join(e, "_e", "left").join(k, "_k", "left")
    w = S.shrink_weight(F.coalesce("_n", F.lit(0)), SHRINK_K)
    at = lambda a, i: F.coalesce(F.get(a, F.lit(i)), F.lit(0.0))
    both = lambda own, all_, i: w * at(own, i) + (1 - w) * at(all_, i)
    deviation = lambda i: F.sqrt(F.greatest(both("_ev", "_cv", i), F.lit(MIN_VARIANCE)))
    each = range(len(names))
    return out.select("_e", "_k", F.array(*[both("_em", "_cm", i) for i in each]).alias("_m"), F.array(*[deviation(i) for i in each]).alias("_s"), F.array(*[at("_cm", i) for i in each]).alias("_c"))


def sequence_scores(rows: DataFrame, train: DataFrame, value: str = "command_surprisal") -> DataFrame:
    """Adds ``sequence``: the share of the cohort's training values at most this one; else of all; else 0.5."""
    own = T.ecdf_rank(rows, value, train, value, "_own", "cohort")
    both = T.ecdf_rank(rows, value, train, value, "_all", onto=own)
    return both.withColumn("sequence", F.round(F.coalesce("_own", "_all", F.lit(0.5)), 9)).drop("_own", "_all")


def graph_scores(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Adds ``graph``: weighted sum of novelty, few peers, low overlap and unusual degree, against the cohort's
    training statistics (else all rows')."""
    names = ["graph_peer_resource_count", "graph_jaccard_vs_cohort"]
    stats = T.cohort_and_global(train, "cohort", names)
    own = stats.where("cohort IS NOT NULL").toDF("cohort", "_pm", "_ps", "_jm", "_js")
    rest = stats.where("cohort IS NULL").drop("cohort").toDF("_gpm", "_gps", "_gjm", "_gjs")
    out = rows.join(own, "cohort", "left").crossJoin(rest)  # one row
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    pm, jm, js = F.coalesce("_pm", "_gpm", F.lit(10.0)), F.coalesce("_jm", "_gjm", F.lit(0.5)), F.coalesce("_js", "_gjs", F.lit(0.2))
    parts = (
        unit(c("graph_entity_novel_resource")),
        F.when(pm > 0, unit(1 - F.least(c("graph_peer_resource_count") / F.greatest(pm, F.lit(1.0)), F.lit(2.0)) / 2)).otherwise(0.5),
        F.when(js > 1e-9, unit(((jm - c("graph_jaccard_vs_cohort")) / js + 3) / 6)).otherwise(0.5),
        unit((F.abs(c("graph_entity_degree_deviation")) + 3) / 6 - 0.5),
    )
    total = sum((w * p for w, p in zip(GRAPH_WEIGHTS[1:], parts[1:])), GRAPH_WEIGHTS[0] * parts[0])
    return out.withColumn("graph", F.round(total, 9)).drop("_pm", "_ps", "_jm", "_js", "_gpm", "_gps", "_gjm", "_gjs")


def active_weights(detectors: tuple[str, ...], redistribute: bool = True) -> dict[str, float]:
    """Weights of the detectors there are; the others' weight is dealt to them in proportion."""
    own = {d: WEIGHTS[d] for d in detectors}
    scale = sum(WEIGHTS.values()) / sum(own.values()) if redistribute and own else 1.0
    return {d: w * scale for d, w in own.items()}


def fuse(rows: DataFrame, reference: DataFrame, detectors: tuple[str, ...] = ("profile", "sequence", "graph"), redistribute: bool = True, bias: float = BIAS, min_window: int = MIN_WINDOW, fixed: dict[str, float] | None = None) -> DataFrame:
    """Adds ``<detector>_logodds`` and ``risk_score`` (0 to 100): additive fusion of ranks in log-odds.

    A score's rank is its share among the reference rows' scores (0.5 below ``min_window`` of them).
    Without detectors the risk is 50. ``fixed``: detectors whose score is the same in all rows, and that score; its rank is one number, without a join of all rows
    on one value. Rows are shuffled once a detector, so they should hold few columns.
    """
    if not detectors:
        return rows.withColumn("risk_score", F.lit(50.0))
    weights = active_weights(detectors, redistribute)
    # all detectors' values are ranked in one long table; ranks are made from the rows as given, not from the growing join
    fixed = fixed or {}
    names = [d for d in weights if d not in fixed]
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("detector"), c(d).cast("double").alias("value")) for d in names])).alias("x")).select("x.*")
    ranks = T.ecdf_table(long(rows), "value", long(reference), "value", "detector") if names else None
    one = [F.avg((c(d).cast("double") <= v).cast("double")).alias(f"_p_{d}") for d, v in fixed.items()]
    out = rows.crossJoin(reference.agg(F.count("*").alias("_n"), *one))  # one row
    for d, w in weights.items():
        if d not in fixed:
            own = ranks.where(c("detector") == d).select(c("_v").alias(f"_v_{d}"), c("_rank").alias(f"_p_{d}"))
            out = out.join(own, c(d).cast("double") == c(f"_v_{d}"), "left").drop(f"_v_{d}")
        p = F.when(c("_n") < min_window, F.lit(WARMUP)).otherwise(F.coalesce(f"_p_{d}", F.lit(WARMUP)))
        out = out.withColumn(f"{d}_logodds", w * S.logit(p)).drop(f"_p_{d}")
    total = sum((c(f"{d}_logodds") for d in weights), F.lit(bias))
    return out.drop("_n").withColumn("risk_score", 100 * S.sigmoid(total))


def ablated(rows: DataFrame, reference: DataFrame, detectors: tuple[str, ...] = ("profile", "sequence", "graph"), bias: float = BIAS) -> DataFrame:
    """Rows with ``without, risk_score``: each row as fused by all detectors (none) and with each put in turn at one value in all rows and the reference.

    Such a value's rank is 1, and the other detectors' log-odds don't change, so rows are fused once.
    """
    full = fuse(rows, reference, detectors, bias=bias).drop("risk_score")
    top = reference.agg(F.when(F.count("*") < MIN_WINDOW, F.lit(WARMUP)).otherwise(1.0).alias("_top"))
    full = full.crossJoin(top)  # one row
    weights = active_weights(detectors)
    risk = lambda left: 100 * S.sigmoid(sum((w * S.logit(c("_top")) if d == left else c(f"{d}_logodds") for d, w in weights.items()), F.lit(bias)))
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("without"), risk(d).alias("risk_score")) for d in ("none", *detectors)])).alias("x")
    return full.select(*rows.columns, each).select(*rows.columns, "x.*")


def signature(f=c) -> Column:
    """Struct ``attack_type, confidence`` of the first signature rule that fires, else normal and 0.5."""
    one = F.lit(1.0)
    # fixed values: the rules' features, bounds, confidences and order
    rules = (
        ((f("ip_failure_count_5m") > 15) & (f("entity_failure_count_5m") > 5), "brute_force", F.least(one, 0.7 + 0.01 * (f("ip_failure_count_5m") - 15))),
        ((f("success_after_failures") > 0) & (f("entity_failure_count_5m") > 8), "brute_force", F.lit(0.75)),
        ((f("distinct_entities_per_ip") > 5) & (f("ip_failure_count_1h") > 10), "credential_stuffing", F.least(one, 0.65 + 0.02 * (f("distinct_entities_per_ip") - 5))),
        ((f("distinct_entities_per_ip") > 8) & (f("ip_failure_count_5m") > 5), "credential_stuffing", F.lit(0.72)),
        (f("geo_velocity_kmh") > 1000, "impossible_travel", F.least(one, 0.70 + 0.0001 * (f("geo_velocity_kmh") - 1000))),
        ((f("new_country_flag") > 0) & (f("geo_velocity_kmh") > 500), "impossible_travel", F.lit(0.68)),
        ((f("cohort_novel_resource") > 0) & (f("distinct_resources_1h") > 8), "lateral_movement", F.least(one, 0.65 + 0.02 * f("distinct_resources_1h"))),
        ((f("graph_peer_resource_count") < 2) & (f("graph_entity_novel_resource") > 0) & (f("entity_novel_resource") > 0), "lateral_movement", F.lit(0.68)),
        ((f("fingerprint_unknown") > 0) & (f("os_mismatch") > 0) & (f("mac_oui_change") > 0), "device_spoofing", F.lit(0.85)),
        ((f("fingerprint_unknown") > 0) & (f("protocol_novelty") > 0), "device_spoofing", F.lit(0.65)),
        ((f("offhours_bytes_rolling_7d") > 50_000) & (f("transfer_to_duration_ratio") > 500), "low_and_slow_exfil", F.least(one, 0.60 + 0.0001 * f("offhours_bytes_rolling_7d") / 1000)),
        ((f("bytes_zscore") > 3) & (f("is_offhours") > 0), "low_and_slow_exfil", F.lit(0.62)),
    )
    out = None
    for test, name, confidence in rules:
        value = F.struct(F.lit(name).alias("attack_type"), confidence.cast("double").alias("confidence"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit("normal").alias("attack_type"), F.lit(0.5).alias("confidence")))


def resolve(rule: Column, tree: Column, least: float = 0.35) -> Column:
    """Struct ``attack_type, confidence, agreement, is_novel`` from the rules' and the trees' answers (null trees: rules alone)."""
    st, sc_, tt, tc = rule["attack_type"], rule["confidence"], tree["attack_type"], tree["confidence"]
    make = lambda t, p, a, n: F.struct(t.alias("attack_type"), p.alias("confidence"), a.alias("agreement"), n.alias("is_novel"))
    yes, no, novel = F.lit(True), F.lit(False), F.lit("unknown_novel")

    def bounded(t: Column, p: Column, a: Column, n: Column) -> Column:
        low = (p < least) & (t != "normal")
        return make(F.when(low, novel).otherwise(t), p, a, n | low)

    alone = make(F.when((st == "normal") | (sc_ < least), F.lit("normal")).otherwise(st), sc_, yes, no)
    return (
        F.when(tt.isNull(), alone).when(st == tt, bounded(st, F.greatest(sc_, tc), yes, no)).when((st == "normal") & (tc >= least), bounded(tt, tc, no, no))
        .when((tt == "normal") & (sc_ >= least), bounded(st, sc_, no, no)).otherwise(bounded(novel, F.greatest(sc_, tc) * 0.7, no, yes))
    )


def naive_baseline(ev: DataFrame, failures: int = 8, kmh: float = 800.0, new_resources: int = 3, off_from: int = 22, off_to: int = 6, factor: float = 8.0) -> DataFrame:
    """``event_id, naive_score``: five rules, a point each but half for the hour.

    Median bytes are of all an entity's rows; the other rules look back only. Travel is measured between
    successes.
    """
    e = "entity_id"
    hour = S.utc_hour(c("ts_us"))
    median = ev.groupBy(e).agg(F.median("bytes_transferred").alias("_median"))
    df = ev.select("event_id", e, "ts_us", "auth_result", "resource_accessed", "geo_lat", "geo_lon", "bytes_transferred").withColumn("ft", W.first_touch(e, "resource_accessed"))
    df = W.with_run_length(df, c("auth_result") == "failure", "run", e, including=True)
    good = c("auth_result") == "success"
    last = F.last(F.when(good, F.struct("geo_lat", "geo_lon", "ts_us")), ignorenulls=True).over(W.past(e))
    df = df.withColumns({"prev": last, "new": F.sum("ft").over(W.upto(e))}).join(median, e)
    hours = F.greatest(F.lit(1e-6), (c("ts_us") - c("prev.ts_us")) / 3.6e9)
    fast = good & (S.haversine_km(c("prev.geo_lat"), c("prev.geo_lon"), c("geo_lat"), c("geo_lon")) / hours > kmh)
    point = lambda x: F.when(x, 1.0).otherwise(0.0)
    score = point((hour >= off_from) | (hour < off_to)) * 0.5 + point((c("_median") > 0) & (c("bytes_transferred") > c("_median") * factor)) + point(c("run") >= failures) + point(fast) + point(c("new") >= new_resources)
    return df.select("event_id", score.alias("naive_score"))


def display_value(feature: Column, value: Column) -> Column:
    """A feature's value as text."""
    whole = lambda unit: F.concat(F.format_number(value, 0), F.lit(unit))
    flags = ("is_offhours", "new_country_flag", "new_subnet_flag", "entity_novel_resource", "cohort_novel_resource", "fingerprint_unknown", "os_mismatch", "mac_oui_change", "success_after_failures", "protocol_novelty", "auth_method_novelty", "graph_entity_novel_resource", "is_cold_start_flag")
    return (
        F.when(feature == "geo_velocity_kmh", whole(" km/h")).when(feature.rlike("^(entity|ip)_failure_count_"), F.concat(F.floor(value).cast("string"), F.lit(" failures"))).when(feature.isin("offhours_bytes_rolling_7d", "bytes_zscore"), F.format_string("%.1f", F.round(value, 1)))
        .when(feature.isin(*flags), F.when(value > 0.5, "yes").otherwise("no")).when(feature.contains("zscore"), F.concat(F.format_string("%+.2f", F.round(value, 2)), F.lit("σ"))).when(feature == "geo_centroid_distance_km", whole(" km"))
        .when(feature == "transfer_to_duration_ratio", whole(" B/s")).otherwise(F.format_string("%.3f", F.round(value, 3)))
    )


def contributions(rows: DataFrame, importances: DataFrame | None = None, k: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """``event_id, rank, feature, contribution, value``: log-odds dealt to features, the k largest in size; and the columns to ``keep``, with the feature's ``i`` and ``z``.

    The profile's go by size of z over the features that aren't the sequence's or the graph's, the sequence's and the
    graph's evenly over their own, the isolation's by importance (evenly without any). The dealt terms
    add up to each detector's log-odds.
    """
    flags = lambda test: F.array(*[F.lit(1.0 if test(n) else 0.0) for n in NAMES])
    mine, seq, gra = flags(lambda n: n not in GRAPH_FEATURES and n not in SEQUENCE_FEATURES), flags(lambda n: n in SEQUENCE_FEATURES), flags(lambda n: n in GRAPH_FEATURES)
    has = lambda d: c(f"{d}_logodds") if f"{d}_logodds" in rows.columns else F.lit(0.0)
    share = F.array_repeat(F.lit(1 / len(NAMES)), len(NAMES))
    if importances is not None:
        weights = importances.groupBy("cohort").agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("_imp"))
        rows = rows.join(weights, "cohort", "left")
        share = F.when(c("_imp").isNotNull(), F.array(*[F.coalesce(c("_imp")[n], F.lit(0.0)) for n in NAMES])).otherwise(share)
    total = F.aggregate(F.zip_with("z", mine, lambda z, m: F.abs(z) * m), F.lit(0.0), lambda a, x: a + x)
    rows = rows.select("event_id", *keep, "z", F.array(*[c(n) for n in NAMES]).alias("_values"), has("profile").alias("_p"), has("isolation").alias("_i"), has("sequence").alias("_s"), has("graph").alias("_g"), F.explode(F.array(F.struct(total.alias("zsum"), share.alias("share")))).alias("_x"))

    def term(z: Column, i: Column) -> Column:
        profile = F.when(c("_x.zsum") > 1e-12, c("_p") * F.abs(z) * F.get(mine, i) / c("_x.zsum")).otherwise(0.0)
        return profile + c("_i") * F.get(c("_x.share"), i) + c("_s") * F.get(seq, i) / len(SEQUENCE_FEATURES) + c("_g") * F.get(gra, i) / len(GRAPH_FEATURES)

    names = F.array(*[F.lit(n) for n in NAMES])
    items = F.transform("z", lambda z, i: F.struct((-F.round(F.abs(term(z, i)), 9)).alias("key"), i.alias("at"), term(z, i).alias("contribution")))
    top = F.slice(F.array_sort(F.filter(items, lambda x: F.abs(x["contribution"]) >= 1e-12)), 1, k)
    out = rows.select("event_id", *keep, "z", "_values", F.posexplode(top).alias("rank", "t"))
    more = [*keep, c("t.at").alias("i"), F.get("z", c("t.at")).alias("z")] if keep else []
    return out.select("event_id", (c("rank") + 1).alias("rank"), F.get(names, c("t.at")).alias("feature"), "t.contribution", F.get("_values", c("t.at")).alias("value"), *more)


#: Phrases by feature; {} is the value.
PHRASES = {
    "geo_velocity_kmh": "a trip at {} since the last login", "geo_centroid_distance_km": "a place {} off the usual ones", "new_country_flag": "a country not used before", "new_subnet_flag": "a network not used before",
    "source_ip_novelty": "an address not used before", "entity_novel_resource": "a resource not used before", "cohort_novel_resource": "a resource that no one of the cohort uses", "graph_entity_novel_resource": "a link to a new resource",
    "graph_peer_resource_count": "a resource that {} peers use", "graph_jaccard_vs_cohort": "{} overlap with the cohort's resources", "graph_entity_degree_deviation": "a range of resources out of line with the cohort",
    "entity_failure_count_5m": "{} within five minutes", "entity_failure_count_1h": "{} within an hour", "entity_failure_count_24h": "{} within a day", "ip_failure_count_5m": "{} from the address within five minutes", "ip_failure_count_1h": "{} from the address within an hour",
    "fingerprint_unknown": "a device not met before", "os_mismatch": "an operating system not met before", "mac_oui_change": "a network card of another maker", "success_after_failures": "a login that worked after several that failed",
    "distinct_entities_per_ip": "an address shared by {} entities", "offhours_bytes_rolling_7d": "{} bytes outside working hours in a week", "transfer_to_duration_ratio": "a transfer of {}", "bytes_zscore": "a volume of {} deviations",
    "command_surprisal": "commands of {} bits each", "unseen_bigram_count": "{} pairs of commands not met before", "is_offhours": "an hour outside of work", "protocol_novelty": "a protocol not met before", "auth_method_novelty": "a login method not met before",
}


def narratives(top: DataFrame, k: int = 3, most: int = 200) -> DataFrame:
    """``event_id, narrative``: the first k contributions as one sentence of at most ``most`` characters."""
    shown = display_value(c("feature"), c("value"))
    phrase = F.concat(c("feature"), F.lit(": "), shown)
    for name, text in PHRASES.items():
        before, mark, after = text.partition("{}")
        phrase = F.when(c("feature") == name, F.concat(F.lit(before), shown, F.lit(after)) if mark else F.lit(text)).otherwise(phrase)
    lines = top.where(c("rank") <= k).withColumn("phrase", phrase).groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]).alias("p"))
    full = F.concat(F.lit("Stands out for "), F.array_join("p", "; "), F.lit("."))
    short = F.concat(F.lit("Stands out for "), F.get("p", F.lit(0)), F.lit("; and for "), (F.size("p") - 1).cast("string"), F.lit(" more reasons."))
    cut = F.when(F.length(short) > most, F.concat(F.substring(short, 1, most - 3), F.lit("..."))).otherwise(short)
    return lines.select("event_id", F.when(F.length(full) <= most, full).otherwise(cut).alias("narrative"))


def counterfactuals(rows: DataFrame, stats: DataFrame, reference: DataFrame, k: int = 3, neutral: float = 0.3) -> DataFrame:
    """``event_id, feature, neutralised_risk, delta``: the risk with one top feature at its cohort's mean. ``stats`` as ``joined_stats`` gives it.

    Only that feature's z changes, so the profile's score follows in closed form; the other detectors
    are put at ``neutral``.
    """
    few = contributions(rows, k=k, keep=("entity_id", "cohort", "rms_z", "risk_score"))
    same = c("entity_id").eqNullSafe(c("_e")) & c("cohort").eqNullSafe(c("_k"))
    out = few.drop("rank", "contribution", "value").join(stats, same, "left")
    get = lambda a: F.get(a, c("i"))
    z = F.greatest(F.lit(-Z_CLIP), F.least(F.lit(Z_CLIP), (get("_c") - get("_m")) / get("_s")))
    squares = F.greatest(F.lit(0.0), c("rms_z") * c("rms_z") * len(NAMES) - c("z") * c("z") + z * z)
    out = out.select("event_id", "feature", c("risk_score").alias("_risk"), F.least(F.lit(1.0), F.sqrt(squares / len(NAMES)) / 5).alias("profile"))
    fused = fuse(stored(out, "changed"), reference, fixed={"sequence": neutral, "graph": neutral})
    return fused.select("event_id", "feature", c("risk_score").alias("neutralised_risk"), (c("risk_score") - c("_risk")).alias("delta"))
