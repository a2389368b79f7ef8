import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF001

FAST = ["pl_portfolio", "tk_interleave", "pl_ingest", "wn_window_choice", "sc_training_prompt", "src_news",
        "st_union_headlines", "jn_asof_next_day", "ag_forecast_error", "pn_rsi", "ud_classify_headlines",
        "pl_ts_corpus", "pl_sentiment_corpus", "pl_analyze", "pl_backtest", "jn_horizon_lookup",
        "sc_trend3", "sc_one_shot_prompt", "wn_one_shot_example", "jn_forecast_actual", "prj_ticker_from_url", "prj_news_query",
        "sc_report_prompts", "sc_inference_prompt", "ag_context_stats", "snk_result_records"]


def test_entry_returns_portfolio(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 15 and {r.side for r in rows} == {"volatile", "stable"}


def test_every_query_has_oracle():
    from pricelab.plans import catalog

    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(E.queries()) >= set(catalog.QUERIES) and set(E.oracle_sql()) >= set(catalog.ORACLE)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle_sf0001(spark, name):
    con = duckdb.connect()
    for t in ["lineitem", "part", "pages", "documents"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    s = E.queries()[name](spark, SF001).toPandas()
    d = con.sql(E.oracle_sql()[name]).to_arrow_table().to_pandas(date_as_object=True)
    assert sorted(s.columns) == sorted(d.columns)
    cols = sorted(s.columns)

    def norm(df):
        out = []
        for rec in df[cols].itertuples(index=False):
            out.append(tuple((None if x != x else round(x, 6)) if isinstance(x, float) else x for x in rec))
        return sorted(out, key=repr)

    assert norm(s) == norm(d)


def test_cli_lists_and_runs(spark, tmp_path, capsys):
    from pricelab.__main__ import main

    assert main(["--list"]) == 0
    assert "pl_portfolio" in capsys.readouterr().out.split()
    out = str(tmp_path / "portfolio")
    assert main(["pl_portfolio", SF001, out, "json"]) == 0
