"""Plan-shape regression tests: the physical operators the design relies on."""

import re

import pytest

import __spark_entry__ as E

from .conftest import SF001


def plan(spark, name):
    return E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


def test_caps_are_window_group_limits(spark):
    p = plan(spark, "src_news")
    assert p.count("WindowGroupLimit") >= 2  # map-side partial + final


def test_portfolio_is_distributed_top_k(spark):
    assert plan(spark, "pl_portfolio").count("TakeOrderedAndProject") == 2


@pytest.mark.parametrize("name", ["pl_ts_corpus", "st_union_headlines", "jn_asof_next_day", "pl_volatility_news",
                                  "pn_stats_string"])
def test_no_cartesian_or_nested_loop_joins(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_corpus_spreads_before_explode(spark):
    p = plan(spark, "pl_ts_corpus")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    assert re.search(r"Exchange RoundRobinPartitioning\(" + width + r"\), REPARTITION_BY_NUM", p)
    assert "Generate explode" in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(spark, "pl_portfolio")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and all("l_comment" not in s and "l_tax" not in s and "l_discount" not in s for s in schemas)


def test_bars_are_hashed_not_sorted(spark):
    from pricelab.sources import tables as T

    p = T.bars(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in p and "Sort [" not in p.replace("SortMergeJoin", "") and p.count("HashAggregate") >= 2


@pytest.mark.parametrize("name", ["pl_ingest", "pl_portfolio", "pl_ts_corpus", "pl_sentiment_corpus", "pl_backtest"])
def test_lineitem_is_read_once(spark, name):
    assert "lineitem.parquet" not in plan(spark, name)  # bars come from the table written once for the call


def test_explicit_asof_drops_the_subquery_and_keeps_results(spark):
    from pricelab.plans import pipelines as PL
    from pricelab.sources import tables as T

    bars = T.bars(spark, SF001)
    last = bars.agg({"date": "max"}).first()[0]
    implicit = PL.pl_portfolio(bars)
    explicit = PL.pl_portfolio(bars, asof=str(last))
    assert "Subquery" in implicit._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" not in explicit._jdf.queryExecution().executedPlan().toString()
    assert sorted(implicit.collect()) == sorted(explicit.collect())
