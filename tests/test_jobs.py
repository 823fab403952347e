"""Streams that go on where they stopped, models that are saved and loaded, and windows at their limits."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import boosting
from tidewatch.operators import features as X
from tidewatch.operators import incremental as N
from tidewatch.operators import isolation as I
from tidewatch.operators import isotonic
from tidewatch.operators import scoring as M
from tidewatch.operators import tables as T
from tidewatch.operators import windows as W
from tidewatch.operators.features import NAMES
from tidewatch.sources.access_events import access_events, labels, scored
from tidewatch.sources.storage import new_folder, stored
from tidewatch.streaming import jobs as J


def spans(spark, sf_dir, source=scored):
    """The events in two spans of time, and their schema as text."""
    ev = source(spark, sf_dir)
    middle = ev.agg(F.percentile("ts_us", 0.5)).first()[0]
    return ev, ev.where(F.col("ts_us") < middle), ev.where(F.col("ts_us") >= middle), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ev.schema.fields)


def test_a_stream_goes_on_where_it_stopped(spark, sf_dir):
    ev, early, late, schema = spans(spark, sf_dir)
    path, folder = new_folder(spark, "in"), new_folder(spark, "job")
    run = lambda: J.to_table(J.stateful_features(J.replay(spark, path, schema), "entity_id"), "state", folder=folder)
    early.repartition(3).write.mode("append").parquet(path)
    assert run().count() == early.count()
    late.repartition(3).write.mode("append").parquet(path)
    whole = {r.event_id: (r.n, r.run, r.new_resource) for r in run().collect()}
    one = new_folder(spark, "in")
    ev.repartition(1).write.parquet(one)
    want = {r.event_id: (r.n, r.run, r.new_resource) for r in J.to_table(J.stateful_features(J.replay(spark, one, schema), "entity_id"), "state").collect()}
    assert whole == want and len(whole) == ev.count()


def test_a_batch_that_runs_again_counts_once(spark, sf_dir):
    _, early, late, _ = spans(spark, sf_dir)
    table = J.Batches(spark, new_folder(spark, "t"), early.select("event_id").schema)
    for rows, number in ((early, 0), (late, 1), (late, 1), (early, 0)):
        table.write(rows, number)
    assert table.read().count() == early.count() + late.count() and table.read(before=1).count() == early.count()


def test_online_ranks_warm_up_and_resume(spark):
    path, folder = new_folder(spark, "in"), new_folder(spark, "job")
    rows = lambda a, b: spark.createDataFrame([(f"e{i}", i, float(i % 10)) for i in range(a, b)], "event_id string, ts_us long, x double").coalesce(1)
    run = lambda: J.online_ranks(J.replay(spark, path, "event_id string, ts_us long, x double", 1), "x", "r", least=50, folder=folder)
    rows(0, 40).write.mode("append").parquet(path)
    assert {r["rank"] for r in run()[0].collect()} == {0.5}
    rows(40, 100).write.mode("append").parquet(path)
    assert {r["rank"] for r in run()[0].collect()} == {0.5}  # 40 seen before
    rows(100, 110).write.mode("append").parquet(path)
    ranks, sample = run()
    got = {r.event_id: r["rank"] for r in ranks.collect()}
    assert len(got) == 110 and all(got[f"e{i}"] == pytest.approx((i % 10 + 1) / 10) for i in range(100, 110)) and sample.count() == 110


def test_online_ranks_are_of_all_values_seen(spark):
    """More values than the sample holds: ranks are among all of them."""
    path = new_folder(spark, "in")
    value = lambda i: float(i * 7919 % 1009)
    for a, b in ((0, 900), (900, 1800)):
        spark.createDataFrame([(f"e{i}", i, value(i)) for i in range(a, b)], "event_id string, ts_us long, x double").coalesce(1).write.mode("append").parquet(path)
    ranks, sample = J.online_ranks(J.replay(spark, path, "event_id string, ts_us long, x double", 1), "x", "r", size=50, least=50)
    got = {r.event_id: r["rank"] for r in ranks.collect()}
    assert len(got) == 1800 and sample.count() == 50
    assert all(got[f"e{i}"] == pytest.approx(sum(value(j) <= value(i) for j in range(900)) / 900) for i in range(900, 1800))


def test_features_from_state_equal_the_batch_job(spark, sf_dir):
    ev, early, late, _ = spans(spark, sf_dir, access_events)
    state = N.FeatureState(spark, new_folder(spark, "state"))
    got = {r.event_id: r for part, number in ((early, 0), (late, 1)) for r in N.advance(part, state, number).collect()}
    again = {r.event_id: r for r in N.advance(late, N.FeatureState(spark, state.path), 1).collect()}
    want = X.all_features(ev).collect()
    assert len(want) == len(got)
    for r in want:
        assert list(r)[1:] == pytest.approx(list(got[r.event_id])[1:], abs=1e-6) and (r.event_id not in again or list(again[r.event_id]) == pytest.approx(list(got[r.event_id])))
    # an empty batch changes nothing
    assert N.advance(late.where("false"), state, 2).count() == 0
    key = lambda n: sorted(map(tuple, state.newest("totals", N.TOTALS, N.KEYS, n).collect()))
    assert key(2) == key(3)


def test_state_tables_read_back_to_the_last_whole_one(spark):
    state = N.FeatureState(spark, new_folder(spark, "state"))
    want = {}
    for number in range(18):
        rows = [("e", f"k{number % 5}", "a", str(number % 3), number), ("c", "x", "a", "", number)]
        want |= {r[:4]: r[4] for r in rows}
        state.write("totals", N.TOTALS, N.KEYS, spark.createDataFrame(rows, "scope string, key string, attr string, value string, total long"), number, N.total_bucket())
        if number in (0, 7, 8, 17):
            assert {tuple(r)[:4]: r.total for r in state.newest("totals", N.TOTALS, N.KEYS, number + 1).collect()} == want
    read = {int(f.split("version=")[1].split("/")[0]) for f in state._versions("totals", N.TOTALS, 18).inputFiles()}
    assert min(read) == 15 and max(read) == 17  # what came before isn't read
    one = state._versions("totals", N.TOTALS, 18).where("bucket = 3").inputFiles()
    assert state.newest("totals", N.TOTALS, N.KEYS, 18, []).count() == 0 and one


@pytest.fixture(scope="module")
def models(spark, sf_dir):
    """Feature rows, and a folder of models fitted on their training split with few trees."""
    rows, path = M.feature_rows(access_events(spark, sf_dir)), new_folder(spark, "models")
    M.fit_models(rows.where("split = 'train'"), path, labels(spark, sf_dir), rows.where("split = 'val'"), trees=8)
    return rows, path


def close(got, want):
    """Equal risks: what is ranked is rounded before, so sums in another order change nothing."""
    assert set(got) == set(want) and [i for i in got if got[i] != pytest.approx(want[i], abs=1e-6)] == []


def test_saved_models_score_rows_without_fitting(rows_scored, models, spark):
    rows, path = models
    assert len(rows_scored) == rows.count() and all(0 <= r.calibrated <= 1 and 0 <= r.risk_score <= 100 for r in rows_scored.values())
    assert {"classifier", "calibrator", "forest", "entities"} <= {f.name for f in __import__("pathlib").Path(path.removeprefix("file://")).iterdir()}
    few = {r.event_id: r.risk_score for r in M.score_rows(rows.where("split = 'test'"), path).collect()}
    close(few, {i: rows_scored[i].risk_score for i in few})


def test_live_scores_equal_the_batch_job(spark, sf_dir, models, rows_scored):
    ev, early, late, schema = spans(spark, sf_dir, access_events)
    source, folder = new_folder(spark, "in"), new_folder(spark, "live")
    for part in (early, late):
        part.repartition(2).write.mode("append").parquet(source)
        live = J.live_scores(J.replay(spark, source, schema), models[1], folder)
    close({r.event_id: r.risk_score for r in live.collect()}, {i: r.risk_score for i, r in rows_scored.items()})


@pytest.fixture(scope="module")
def rows_scored(models):
    return {r.event_id: r for r in M.score_rows(*models).collect()}


def test_trees_draw_rows_by_hash_and_scores_follow_the_table(spark):
    rng = random.Random(3)
    df = stored(spark.createDataFrame([(f"e{i}", f"c{i % 2}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(600)], "event_id string, cohort string, a double, b double"), "rows")
    forest = stored(I.fit(df, ("a", "b"), trees=20, sample=64), "forest")
    sizes = [r["size"] for r in forest.where("node = 1").collect()]
    assert len(sizes) == 40 and 30 < sum(sizes) / len(sizes) < 100
    nodes = {(r.cohort, r.tree, r.node): r for r in forest.collect()}
    for r in I.path_scores(df, forest, ("a", "b")).limit(60).collect():
        x = next((y.a, y.b) for y in df.where(F.col("event_id") == r.event_id).collect())
        total, roots = 0.0, []
        for t in range(20):
            node, depth = nodes[r.cohort, t, 1], 0
            roots.append(node["size"])
            while node.feature >= 0:
                node, depth = nodes[r.cohort, t, node.left if math.floor(x[node.feature] * I.STEPS + 0.5) <= node.threshold else node.right], depth + 1
            total += depth + float(I.average_path(node["size"]))
        assert r.anomaly == pytest.approx(2 ** (-total / 20 / float(I.average_path(sum(roots) / 20))))


def test_values_a_last_bit_apart_are_one(spark):
    rows = [(f"e{i}", "c", 0.1 if i % 2 else math.nextafter(0.1, 1), float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id string, cohort string, a double, b double")
    forest = I.fit(df, ("a", "b"), trees=30)
    assert forest.where("feature = 0").count() == 0 and forest.where("size < 1").count() == 0
    again = I.fit(df.repartition(3), ("a", "b"), trees=30)
    assert sorted(forest.collect()) == sorted(again.collect())


def test_ranks_of_equal_scores_are_split(spark):
    rows = [(f"e{i:05d}", 7.0 if i % 50 else float(i % 9)) for i in range(6000)] + [("x", None)]
    df = spark.createDataFrame(rows, "event_id string, score double").repartition(3)
    got = {r.event_id: r.position for r in T.budget_rank(df, "score").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(want)}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in df.repartitionByRange(n, F.desc("score"), F.asc("event_id")).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.6 * len(rows)  # though 98 of 100 rows have one score


def test_isotonic_blocks_equal_the_min_max_formula(spark):
    rng = random.Random(8)
    for n, values in ((1, 3), (300, 40), (400, 10_000)):
        rows = [(float(rng.randrange(values)), float(rng.random() < 0.3 + 0.5 * (i % 7 > 3))) for i in range(n)] + [(None, 1.0), (1.0, None)]
        df = spark.createDataFrame(rows, "x double, y double")
        kept = [r for r in rows if None not in r]
        xs = sorted({x for x, _ in kept})
        y, w = [sum(b for a, b in kept if a == x) for x in xs], [sum(a == x for a, _ in kept) for x in xs]
        mean = lambda a, b: sum(y[a : b + 1]) / sum(w[a : b + 1])
        few = range(len(xs)) if len(xs) < 60 else range(0, len(xs), 25)
        want = {xs[i]: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in few}
        got = {r.x: r.p for r in isotonic.predict(df, isotonic.fit(df, "x", "y"), "x", "p").collect()}
        assert got[None] is None and all(got[x] == pytest.approx(v) for x, v in want.items())
    line = isotonic.fit(spark.createDataFrame([(1.0, 0.0), (3.0, 1.0)], "x double, y double"), "x", "y")
    ends = isotonic.predict(spark.createDataFrame([(0.0,), (1.0,), (1.5,), (3.0,), (9.0,)], "x double"), line, "x", "p").orderBy("x").collect()
    assert [r.p for r in ends] == pytest.approx([0, 0, 0.25, 1, 1])


def test_boosted_trees_learn_and_equal_a_walk_in_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(9)
    rows = []
    for i in range(900):
        a, b = rng.random(), rng.random()
        rows.append((f"e{i:04d}", "x" if a > 0.6 else "y" if b > 0.5 else "z", a, b, rng.random()))
    df = spark.createDataFrame(rows, "event_id string, label string, a double, b double, noise double")
    names = ("a", "b", "noise")
    trees = stored(boosting.fit(df.where("event_id < 'e0600'"), "label", names, rounds=40), "trees")
    assert sorted(trees.collect()) == sorted(boosting.fit(df.where("event_id < 'e0600'").repartition(3), "label", names, rounds=40).collect())
    got = {r.event_id: r for r in df.select("event_id", "label", boosting.predict(trees, names).alias("p")).collect()}
    held = [r for r in got.values() if r.event_id >= "e0600"]
    assert sum(r.label == r.p.attack_type for r in held) > 0.95 * len(held)
    con = duckdb.connect()
    con.register("t", trees.toPandas())
    con.register("d", df.toPandas())
    sql = f"""WITH RECURSIVE q AS (SELECT event_id, [floor(a * {I.STEPS} + 0.5), floor(b * {I.STEPS} + 0.5), floor(noise * {I.STEPS} + 0.5)] AS x FROM d),
    w AS (SELECT event_id, class, tree, node, feature, threshold, value, x FROM q, t WHERE node = 1 UNION ALL
      SELECT w.event_id, w.class, w.tree, t.node, t.feature, t.threshold, t.value, x FROM w JOIN t ON t.class = w.class AND t.tree = w.tree AND t.node = 2 * w.node + CASE WHEN x[w.feature + 1] > w.threshold THEN 1 ELSE 0 END WHERE w.feature >= 0),
    s AS (SELECT event_id, class, 1 / (1 + exp(-sum(value))) AS p FROM w WHERE feature < 0 GROUP BY ALL)
    SELECT event_id, max_by(class, p), max(p) / sum(p) FROM s GROUP BY 1"""
    for i, name, p in con.execute(sql).fetchall():
        assert got[i].p.attack_type == name and got[i].p.confidence == pytest.approx(p)
    assert boosting.fit(df.where("label = 'x'"), "label", names) is None and boosting.fit(df.where("false"), "label", names) is None


def test_ewma_of_very_long_histories(spark):
    day = 86_400_000_000
    rows = [("a", f"e{i:04d}", i * day, float(i % 7)) for i in range(400)]
    out = W.with_ewma(spark.createDataFrame(rows, "entity_id string, event_id string, ts_us long, x double"), "x", "m", 0.01, "entity_id").orderBy("ts_us").collect()
    rate, mean, last = math.log(2) / 864, None, None
    for r, (_, _, ts, x) in zip(out, rows):
        step = None if last is None else (ts - last) / 1e6 + 1
        mean = x if mean is None else mean + (1 - math.exp(-rate * step)) * (x - mean)
        last = ts
        assert r.m == pytest.approx(mean, abs=1e-9)
    half = W.with_ewma(spark.createDataFrame([("a", f"e{i:05d}", i * 3_600_000_000, float(i % 5)) for i in range(3000)], "entity_id string, event_id string, ts_us long, x double"), "x", "m", 0.05, "entity_id").orderBy("ts_us").collect()
    rate, mean = math.log(2) / 4320, None
    for i, r in enumerate(half):
        mean = float(i % 5) if mean is None else mean + (1 - math.exp(-rate * 3601)) * (i % 5 - mean)
        assert r.m == pytest.approx(mean, abs=1e-6)


def test_running_sums_over_ranges(spark):
    rng = random.Random(5)
    rows = [(k, v, rng.randrange(9)) for k in ("a", "b", None) for v in sorted({rng.randrange(1000) for _ in range(200)})]
    df = spark.createDataFrame(rows, "k string, v long, n long")
    for keys in ((), ("k",)):
        use = df if keys else df.groupBy("v").agg(F.sum("n").alias("n"))
        got = T.with_running(use, "v", {"s": "n"}, *keys, descending=True).collect()
        for r in got:
            same = [x for x in got if not keys or x.k == r.k]
            assert r.s == sum(x.n for x in same if x.v >= r.v) and r.s_all == sum(x.n for x in same)
