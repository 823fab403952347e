"""Folds against windows, leakage, guards and unit cases of the behavioural operators."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.operators import detectors as D
from tidewatch.operators import evaluation as E
from tidewatch.operators import features as X
from tidewatch.operators import isolation as I
from tidewatch.operators import tables as T
from tidewatch.operators import windows as W
from tidewatch.plans.model_queries import detector_frame
from tidewatch.sources import access_events as A
from tidewatch.sources.storage import stored

H = 3_600_000_000


@pytest.fixture(scope="module")
def ev(spark, sf_dir):
    return A.access_events(spark, sf_dir).cache()


def tied(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows = [(f"e{i:04d}", f"u{rng.randrange(5)}", rng.randrange(60) * 2 * H, rng.choice(["failure", "success"]), rng.choice("abcd")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id string, entity_id string, ts_us long, auth_result string, resource string")


def test_windows_equal_a_fold_with_tied_times(spark):
    rows, df = tied(spark)
    df = W.with_run_length(df, F.col("auth_result") == "failure", "run", "entity_id")
    df = df.withColumns({"n": W.past_count("entity_id"), "recent": W.rolling_count(6 * 3600, "entity_id"), "ft": W.first_touch("entity_id", "resource")}).withColumn("distinct", W.running_distinct("ft", "entity_id"))
    df = W.with_rolling_distinct(df, "resource", 6 * 3600, "rolling", "entity_id")
    got = {r.event_id: r for r in df.collect()}
    past = {}
    for i, u, t, a, x in sorted(rows, key=lambda r: (r[2], r[0])):
        own = past.setdefault(u, [])
        run = 0
        for p in reversed(own):
            if p[1] != "failure":
                break
            run += 1
        r = got[i]
        assert (r.n, r.run, r.ft) == (len(own), run, int(x not in {p[2] for p in own}))
        assert r.recent == sum(p[0] >= t - 6 * H for p in own)
        assert r["distinct"] == len({p[2] for p in own})
        assert r.rolling == len({p[2] for p in own if p[0] >= t - 6 * H})
        own.append((t, a, x))


def test_two_levels_equal_one(spark):
    _, df = tied(spark)
    out = W.with_bucketed_past(df, {"n2": F.lit(1)}, "entity_id", bucket_us=10 * H).withColumn("n1", W.past_count("entity_id"))
    assert out.where("n1 <> n2").count() == 0 and out.count() == 300


def test_future_rows_change_no_feature(spark, ev):
    cut = ev.approxQuantile("ts_us", [0.5], 0.01)[0]
    early = ev.where(F.col("ts_us") <= cut)
    for f in (X.entity_features, X.ip_features, X.cohort_features):
        a, b = f(early), f(ev).join(early.select("event_id"), "event_id", "left_semi")
        assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_travel_from_new_york_to_london(spark, ev):
    base = ev.limit(1).drop("event_id", "ts_us", "geo_lat", "geo_lon", "entity_id")
    rows = spark.createDataFrame([("a", "u", 0, 40.71, -74.01), ("b", "u", 1_800_000_000, 51.51, -0.13)], "event_id string, entity_id string, ts_us long, geo_lat double, geo_lon double")
    got = {r.event_id: r for r in X.entity_features(rows.crossJoin(base)).collect()}
    assert got["a"].geo_velocity_kmh == 0 and got["a"].geo_centroid_distance_km == 0 and got["b"].geo_velocity_kmh > 3000


def test_empty_events_give_empty_features(spark, ev):
    none = ev.where("false")
    for f in (X.entity_features, X.ip_features, X.cohort_features, X.command_features, X.jaccard_feature, X.divergence_feature):
        assert f(none).count() == 0


def test_divergence_of_an_entity_that_changes_its_cohort(spark, monkeypatch):
    """Its own counts go on, those of either cohort hold what was accessed there; all by a plain loop. Resources may be null."""
    monkeypatch.setattr(X, "SPAN", 4)
    names = ["x", "y", "z", None]
    data = [(f"e{i:02}", "moves" if i % 3 == 0 else f"u{i % 5}", "a" if i % 2 == 0 or i % 3 and i % 5 < 3 else "b", i * i % 97, names[i * 7 % 11 % 4]) for i in range(60)]
    got = {r.event_id: r.resource_js_divergence for r in X.divergence_feature(spark.createDataFrame(data, "event_id string, entity_id string, cohort string, ts_us long, resource_accessed string")).collect()}
    past, want = [], {}
    for event, entity, cohort, _, resource in sorted(data, key=lambda r: (r[3], r[0])):
        mine, all_ = [r for _, e, _, _, r in past if e == entity], [r for _, _, c, _, r in past if c == cohort]
        js = 0.5 if mine else 0.0
        for r in set(mine):
            p, q = mine.count(r) / len(mine), all_.count(r) / max(len(all_), 1)
            js += (p * math.log2(2 * p / (p + q)) + (q * math.log2(2 * q / (p + q)) if q else 0) - q) / 2
        want[event] = max(js, 0.0)
        past.append((event, entity, cohort, _, resource))
    assert got == pytest.approx(want)


def test_register_feature(spark, ev):
    @X.register_feature("is_weekend", "Weekend")
    def weekend():
        return S.weekday(F.col("ts_us")) >= 5

    try:
        assert "is_weekend" in X.extra_features(ev).columns
        with pytest.raises(ValueError):
            X.register_feature("is_weekend", "again")(weekend)
    finally:
        X.EXTRA.clear()


def test_guards(spark, sf_dir, tmp_path):
    df = A.declared(A.access_events(spark, sf_dir))
    with pytest.raises(A.SchemaError):
        A.write_events(df.withColumn("label", F.lit("x")), str(tmp_path / "a"))
    with pytest.raises(A.SchemaError):
        A.write_events(df.drop("cohort"), str(tmp_path / "b"))
    A.write_events(df.withColumn("command_sequence", F.lit(None).cast("array<string>")), str(tmp_path / "c"))
    assert A.read_events(spark, str(tmp_path / "c")).where("size(command_sequence) <> 0").count() == 0
    good, bad = A.validated(df.withColumn("geo_lat", F.when(F.col("split") == "val", 100.0).otherwise(F.col("geo_lat"))))
    assert bad.count() == df.where("split = 'val'").count() and good.count() + bad.count() == df.count()


@pytest.mark.parametrize(("score", "band"), [(0.0, "low"), (39.99, "low"), (40.0, "medium"), (64.99, "medium"), (65.0, "high"), (84.99, "high"), (85.0, "critical"), (float("nan"), "low"), (None, "low")])
def test_bands(spark, score, band):
    assert one(spark, S.risk_band(F.lit(score).cast("double"))) == band


def vector(spark, **changes):
    base = {n: 0.0 for n in X.NAMES} | {"entity_event_count": 240.0, "graph_peer_resource_count": 22.0, "graph_jaccard_vs_cohort": 0.55, "days_observed": 61.0} | changes
    return spark.createDataFrame([tuple(float(v) for v in base.values())], ", ".join(f"{n} double" for n in base))


@pytest.mark.parametrize(
    ("changes", "name"),
    [
        ({}, "normal"), ({"ip_failure_count_5m": 20, "entity_failure_count_5m": 8}, "brute_force"), ({"distinct_entities_per_ip": 9, "ip_failure_count_1h": 12}, "credential_stuffing"), ({"geo_velocity_kmh": 5000}, "impossible_travel"),
        ({"cohort_novel_resource": 1, "distinct_resources_1h": 10}, "lateral_movement"), ({"fingerprint_unknown": 1, "os_mismatch": 1, "mac_oui_change": 1}, "device_spoofing"), ({"offhours_bytes_rolling_7d": 60_000, "transfer_to_duration_ratio": 600}, "low_and_slow_exfil"),
    ],
)
def test_signatures(spark, changes, name):
    assert vector(spark, **changes).select(D.signature().alias("s")).first()["s"]["attack_type"] == name


def test_page_hinkley_fires_on_a_shift_alone(spark):
    rows = [("stable", f"s{i:03d}", i, 20.0 + i % 3) for i in range(200)] + [("shift", f"t{i:03d}", i, 20.0 if i < 100 else 80.0) for i in range(200)]
    out = W.with_page_hinkley(spark.createDataFrame(rows, "entity_id string, event_id string, ts_us long, x double"), "x", "entity_id")
    fired = {r.entity_id for r in out.where("ph_drift").select("entity_id").distinct().collect()}
    assert fired == {"shift"}


def test_contributions_add_up(spark):
    names = ["profile_logodds", "sequence_logodds", "graph_logodds"]
    row = vector(spark, geo_velocity_kmh=3000).withColumns({"event_id": F.lit("e"), "z": F.array(*[F.lit(float(i % 4)) for i in range(len(X.NAMES))]), **dict(zip(names, map(F.lit, (2.0, -1.5, 0.5))))})
    out = D.contributions(row, k=len(X.NAMES))
    assert abs(out.agg(F.sum("contribution")).first()[0] - 1.0) < 1e-9
    assert D.narratives(out).where("length(narrative) > 200").count() == 0


def test_weights_are_redistributed():
    w = D.active_weights(("profile", "graph"))
    assert abs(sum(w.values()) - sum(D.WEIGHTS.values())) < 1e-12


def test_a_fixed_score_is_ranked_as_a_column_of_it(spark):
    rng = random.Random(6)
    df = stored(spark.createDataFrame([(f"e{i}", *[round(rng.random(), 2) for _ in range(3)]) for i in range(700)], "event_id string, profile double, sequence double, graph double"), "scores")
    names = ("profile", "sequence", "graph")
    risks = lambda rows, name="risk_score": {r.event_id: r[name] for r in rows.collect()}
    want = risks(D.fuse(df.withColumns({"sequence": F.lit(0.3), "graph": F.lit(0.3)}), df))
    assert risks(D.fuse(df.select("event_id", "profile"), df, fixed={"sequence": 0.3, "graph": 0.3})) == pytest.approx(want)
    got = D.ablated(df, df)
    for left in ("none", *names):
        rows = df if left == "none" else df.withColumn(left, F.lit(0.5))
        assert risks(got.where(F.col("without") == left)) == pytest.approx(risks(D.fuse(rows, rows)))


def test_scores_are_kept_without_features(spark, sf_dir):
    """What is ranked and joined by score holds no feature columns, which would be shuffled once a detector."""
    assert not {"z", *X.NAMES} & set(detector_frame(spark, sf_dir)[0].columns)


def test_areas_at_the_edges(spark):
    df = spark.createDataFrame([(0.9, True), (0.9, False), (0.1, False)], "score double, is_anomaly boolean")
    assert E.pr_auc(df).first()[0] == 0.5 and E.roc_auc(df).first()[0] == 0.75
    assert E.pr_auc(df.where("NOT is_anomaly")).first()[0] == 0 and E.roc_auc(df.where("NOT is_anomaly")).first()[0] == 0.5


def test_isolation_forest_ranks_an_outlier_first(spark):
    rng = random.Random(1)
    rows = [(f"e{i}", "c", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [("far", "c", 9.0, -9.0)]
    df = spark.createDataFrame(rows, "event_id string, cohort string, a double, b double")
    forest = I.fit(df, ("a", "b"), trees=30)
    scores = I.path_scores(df, forest, ("a", "b"))
    assert scores.orderBy(F.desc("anomaly")).first().event_id == "far"
    other = df.limit(1).withColumn("cohort", F.lit("unseen"))
    assert I.isolation_scores(other, forest, scores, ("a", "b")).first().isolation == 0.5


def test_many_draws_equal_single_ones():
    rng = random.Random(2)
    some = [(rng.randrange(200), rng.randrange(1, 20_000)) for _ in range(400)]
    a, b = I.node_draws("cohort_é", np.array([t for t, _ in some]), np.array([n for _, n in some]), 7)
    assert list(zip(a.tolist(), b.tolist())) == [I.node_draw("cohort_é", t, n, 7) for t, n in some]


def test_trees_of_a_cohort_take_seconds():
    rng = np.random.default_rng(1)
    x, u = rng.integers(0, 101, (1000, 43)) << 20, rng.integers(0, I.PRIME, 1000)
    began = time.process_time()
    nodes = sum(len(t.node) for t in I.grown(x, u, 1000, "c", range(200), 4096, 7))
    assert nodes > 100_000 and time.process_time() - began < 3


@pytest.mark.parametrize("together", [40, 20_000])
def test_scores_without_a_table_equal_those_with_one(spark, monkeypatch, together):
    """Cohorts that are scored where their trees grow, and those that go by a table; one has no rows to fit on."""
    monkeypatch.setattr(I, "TOGETHER", together)
    rng = random.Random(4)
    rows = [(f"e{i}", f"c{i % 3 if i % 40 else 9}", i % 40 > 0 and i % 5 < 3, rng.gauss(0, 1), float(rng.randrange(3))) for i in range(240)]
    df = spark.createDataFrame(rows, "event_id string, cohort string, fits boolean, a double, b double")
    train, kind = df.where("fits"), {"trees": 30, "sample": 64}
    forest = I.fit(train, ("a", "b"), **kind)
    want = {r.event_id: r.anomaly for r in I.path_scores(df, forest, ("a", "b")).collect()}
    got = {r.event_id: r for r in I.fitted_scores(df, "fits", ("a", "b"), **kind).collect()}
    assert {k: r.anomaly for k, r in got.items()} == pytest.approx(want) and None in want.values()
    assert {k for k, r in got.items() if r.fits} == {r.event_id for r in train.collect()}
    key = lambda f: sorted((r.cohort, r.feature, round(r.importance, 9)) for r in I.importances(f, ("a", "b")).collect())
    assert key(I.split_counts(train, ("a", "b"), **kind)) == key(forest) == key(I.grow(train, ("a", "b"), **kind))


def test_ecdf_without_fitted_rows(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, x double")
    assert T.ecdf_rank(df, "x", df.where("false"), "x", "p", "k").first().p is None


def test_repository_runs_without_the_training_data_operators(tmp_path):
    """A copy without the two folders, the pipeline and its tests imports, and registers and plans the other queries."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parents[1]
    shutil.copytree(root / "tidewatch", tmp_path / "tidewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_a_subpackage_that_cannot_be_imported_takes_nothing_down(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parents[1]
    shutil.copytree(root / "tidewatch", tmp_path / "tidewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "tidewatch" / "llm").mkdir()
    (tmp_path / "tidewatch" / "llm" / "__init__.py").write_text("import no_such_module_anywhere")
    (tmp_path / "tidewatch" / "llm" / "queries.py").write_text("")
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 100"], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_shared_folder_on_a_cluster_must_be_set():
    from types import SimpleNamespace

    from tidewatch.sources import storage

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: ""), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        storage.shared_dir(session)
