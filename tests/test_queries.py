"""Registered queries against their SQL; all of them with FULL=1."""

import os

import duckdb
import pytest
from compare import connection, same

from tidewatch.operators import features
from tidewatch.plans import catalogue

QUICK = (
    "entry_alert_queue f_temporal f_geo f_auth f_source_ip f_cohort f_commands f_jaccard f_divergence s_event_roundtrip s_validation s_json_ingest s_budget_thresholds p_anomaly p_risk_band p_clean j_ecdf_lookup j_counts_as_of j_similar_alerts "
    "j_distance_band a_entity_profile a_hour_histogram a_manifest a_episodes w_past_windows w_run_length w_ewma w_last_16 w_page_hinkley w_two_level t_budget_top t_top_resources u_overlap sc_scalars sc_js_divergence m_signatures m_resolution m_isolation_scores m_isolation_importances m_calibration q_baseline_report "
    "m_naive_baseline q_areas q_summary q_budgets q_time_to_detect v_alert_details v_learn_decisions st_entity_state"
).split()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES) if os.environ.get("FULL") else QUICK)
def test_matches_sql(spark, sf_dir, con, name):
    same(catalogue.QUERIES[name](spark, sf_dir), con, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", ["f_jaccard", "f_divergence"])
def test_matches_sql_over_many_spans(spark, sf_dir, con, name, monkeypatch):
    """A cohort's events in spans of 7 events give what one span gives."""
    monkeypatch.setattr(features, "SPAN", 7)
    same(catalogue.QUERIES[name](spark, sf_dir), con, catalogue.ORACLES[name])


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", ["m_score_events", "st_live_alerts", "st_late_rows"])
def test_rows_only(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_sequence_of_few_training_values(spark, sf_dir, tmp_path):
    """Values below all of a cohort's training values, and a cohort without any, come out as in SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    # few users a cohort, and one cohort of late events alone
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (user_id * 96 AS user_id) FROM read_parquet('{sf_dir}/events.parquet') WHERE user_id > 0 OR ts >= TIMESTAMP '2024-01-23'")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    sql = catalogue.ORACLES["m_sequence"]
    nulls, n = con.execute(f"SELECT count(*) FILTER (sequence IS NULL), count(*) FROM ({sql})").fetchone()
    assert nulls > 0 and n < con.execute("SELECT count(*) FROM events").fetchone()[0]
    same(catalogue.QUERIES["m_sequence"](spark, str(tmp_path)), con, sql)
