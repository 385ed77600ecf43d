"""Registered queries: SQL twins on the small tables, plan shapes, streaming."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from catalog import check

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")

SAMPLE = ("factor_w07_ma", "factor_w16_first_extreme", "xs_x02_decile", "asof_j04_fundamentals", "eval_a09_ndcg", "events_b03_w47_filing_features",
          "signal_b05_a13_report", "prop_l01_panel_features", "tech_w40_score", "merge_k06_single_active", "stream_st1_price_alerts",
          "stream_st7_tick_bars", "panel_b02_training_set", "source_s17_bar_payload")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_sql_twin(spark, con, name):
    msg = check.compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert msg.startswith("ok"), msg


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns[0] == "year"
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["eval_ic_by_year", "xs_x04_composite", "prop_l01_panel_features", "signal_j09_next_bars", "asof_j04_fundamentals",
                                  "backtest_b01_metrics", "sector_j13_peer_events", "events_b03_w47_filing_features"])
def test_no_cross_joins_and_no_python(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas", plan)


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = entry.queries()["eval_t01_topk_rows"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_factor_means_do_not_explode_the_frame(spark):
    plan = entry.queries()["factor_full_frame"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_means_of_the_full_panel_share_one_vector(spark):
    plan = entry.queries()["panel_b02_full_training_set"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("avg(") < 50
