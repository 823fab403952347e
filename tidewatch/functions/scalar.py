"""Scalar functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, SMALL, LOGIT_EPS, LOGIT_CLIP = 6371.0, 1e-10, 1e-7, 6.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def _term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two arrays of counts; 0 if either sums to 0."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    terms = F.zip_with(p, q, lambda x, y: (_term(x / total(p), (x / total(p) + y / total(q)) / 2) + _term(y / total(q), (x / total(p) + y / total(q)) / 2)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), total(terms)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 1 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(1.0)


def surprisal(p: Column) -> Column:
    return F.when(p.isNotNull(), -F.log2(F.greatest(p, F.lit(SMALL))))


def subnet24(ip: Column) -> Column:
    return F.when(F.size(F.split(ip, r"\.")) == 4, F.substring_index(ip, ".", 3)).otherwise(ip)


def mac_oui(mac: Column) -> Column:
    return F.when(mac.contains(":"), F.substring_index(mac, ":", 3)).otherwise(F.substring(mac, 1, 6))


def shrink_weight(n: Column, k: float = 20.0) -> Column:
    return n / (n + F.lit(float(k)))


def shrink(own: Column, prior: Column, n: Column, k: float = 20.0) -> Column:
    w = shrink_weight(n, k)
    return w * own + (1 - w) * prior


def shrink_histogram(own: Column, prior: Column, n: Column, k: float = 20.0) -> Column:
    return F.zip_with(own, prior, lambda a, b: shrink(a, b, n, k))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, clip: float = LOGIT_CLIP) -> Column:
    q = F.greatest(F.lit(LOGIT_EPS), F.least(F.lit(1 - LOGIT_EPS), p))
    return F.when(p.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), F.log(q / (1 - q)))))


def smoothed(count: Column, total: Column, vocabulary: Column, smoothing: float = 0.5) -> Column:
    """Additive smoothing; a vocabulary counts as one word at least."""
    return (count + smoothing) / (total + smoothing * F.greatest(vocabulary, F.lit(1)))


def bigrams(a: Column) -> Column:
    """Neighbouring pairs of an array as structs ``a, b``."""
    return F.when(F.size(a) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: F.struct(F.get(a, i - 1).alias("a"), F.get(a, i).alias("b")))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def fingerprint(os: Column, version: Column, mac: Column, protocol: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", os, version, mac, protocol), 256), 1, 16)


def event_key(*parts: Column) -> Column:
    """Deterministic 16-digit id."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def clean(x: Column, bound: float | None = None) -> Column:
    """Null and NaN become 0; clipped to +-bound if there is one (infinities too, else they become 0)."""
    y = F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    if bound is None:
        return F.when(F.abs(y) == F.lit(float("inf")), 0.0).otherwise(y)
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), y))


def inverted_unit(x: Column, low: Column, high: Column) -> Column:
    """1 at ``low`` or below, 0 at ``high`` or above; 0.5 where the range is empty; null stays null."""
    return F.when(x.isNull(), F.lit(None).cast("double")).when(high - low < 1e-12, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (x - low) / (high - low))))


#: Prefix of a resource and its type.
RESOURCE_TYPES = {"fs": "file", "api": "endpoint", "port": "port", "func": "device_function"}


def resource_type(resource: Column) -> Column:
    prefix = F.substring_index(resource, ":", 1)
    out = None
    for p, t in RESOURCE_TYPES.items():
        out = F.when(prefix == p, t) if out is None else out.when(prefix == p, t)
    return out


def utc_hour(ts_us: Column) -> Column:
    return F.floor(F.pmod(ts_us, F.lit(86_400_000_000)) / 3_600_000_000).cast("int")


def weekday(ts_us: Column) -> Column:
    """Monday is 0."""
    return F.pmod(F.floor(ts_us / 86_400_000_000) + 3, F.lit(7)).cast("int")


def day_index(ts_us: Column, start_us: int) -> Column:
    return F.floor((ts_us - F.lit(start_us)) / 86_400_000_000).cast("long")


def risk_band(score: Column) -> Column:
    """low below 40, medium below 65, high below 85, else critical; null and NaN are low."""
    return F.when(score.isNull() | F.isnan(score) | (score < 40), "low").when(score < 65, "medium").when(score < 85, "high").otherwise("critical")


def bytes_text(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.format_string("%.1f KB", F.round(n / 1024, 1))).when(n < 1024**3, F.format_string("%.1f MB", F.round(n / 1024**2, 1))).otherwise(F.format_string("%.2f GB", F.round(n / 1024**3, 2)))


def duration_text(s: Column) -> Column:
    whole = F.floor(s)
    h, m, r = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def compact_text(x: Column) -> Column:
    return F.when(F.abs(x) >= 1e6, F.format_string("%.1fM", F.round(x / 1e6, 1))).when(F.abs(x) >= 1e3, F.format_string("%.1fk", F.round(x / 1e3, 1))).otherwise(F.floor(x + 0.5).cast("string"))


def percent_text(x: Column) -> Column:
    return F.format_string("%.1f%%", F.round(x * 100, 1))


#: Budget in percent and risk threshold, between which is interpolated.
BUDGET_POINTS = ((0.1, 80.0), (0.5, 65.0), (1.0, 50.0), (2.0, 40.0), (5.0, 25.0))


def threshold_for_budget(pct: Column) -> Column:
    out = F.when(pct < BUDGET_POINTS[0][0], BUDGET_POINTS[0][1])
    for (x0, y0), (x1, y1) in zip(BUDGET_POINTS, BUDGET_POINTS[1:]):
        out = out.when(pct <= x1, F.lit(y0) + (pct - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(BUDGET_POINTS[-1][1])
