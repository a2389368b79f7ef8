"""Variants of prompts and parsers, and caps that bind."""

from pyspark.sql import functions as F

from pricelab.functions import constants as K
from pricelab.functions.text import loose_forecast_text
from pricelab.operators import corpus as CO
from pricelab.operators import models as M
from pricelab.plans import pipelines as PL
from pricelab.plans import queries_variants as V
from pricelab.plans import standins as SI

SF001 = "/root/testdata/sf0.001"


def test_loose_forecast_is_prices_or_a_message(spark):
    texts = {"x PREDICTION: [1.5, 2]": "[1.5, 2.0]", "no marker 1.5": K.MSG_LOOSE_PARSE, "PREDICTION: 1.2.3, 4": K.MSG_LOOSE_PARSE,
             "PREDICTION: 3 or so.": K.MSG_LOOSE_PARSE, "PREDICTION: none": "[]", None: K.MSG_LOOSE_PARSE, "": K.MSG_LOOSE_PARSE}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["f"] for r in df.select("text", loose_forecast_text("text").alias("f")).collect()}
    assert got == texts


def test_parsed_answers_keep_the_group_only():
    model = M.parsed_answers(lambda: lambda ps: ["a UPDATED_summary: one\ntwo  Prediction: 3", "Prediction: UPDATED_SUMMARY:", None, ""], K.RE_DRAFT_SUMMARY)()
    assert model(["p"] * 4) == ["one\ntwo", "", "", ""]


def test_draft_prompts_fall_back_where_no_summary_is_parsed(spark):
    rows = [("WITH", [100.0] * 150 + [100.08] * 150), ("NONE", [100.0 + 0.01 * (k % 2) + 0.01 for k in range(400)]), ("LAST", [100.08] * 180 + [100.01] * 200), ("ONE", [8.0]), ("EMPTY", [])]
    df = spark.createDataFrame(rows, "ticker string, closes array<double>")
    got = {r["ticker"]: r for r in PL.draft_forecast_prompts(df, SI.draft_summarizer, 7).collect()}
    assert got["WITH"]["summary"] == "From 100.08\nto 100.08." and 'summarized as: "From 100.08\nto 100.08."' in got["WITH"]["prompt"]
    assert got["LAST"]["summary"] == "From 100.08\nto 100.08."  # what no later chunk replaced
    for t in ("NONE", "EMPTY"):
        assert got[t]["summary"] == K.FALLBACK_SUMMARY and "summarized" not in got[t]["prompt"] and "Predict the next 7 " in got[t]["prompt"]
    assert "CONTEXT_DAYS: 180\n" in got["NONE"]["prompt"] and got["ONE"]["summary"] == "From 8.00\nto 8.00."

    def broken():
        raise OSError("no model")

    one = PL.draft_forecast_prompts(df.where("ticker = 'WITH'"), broken, 7).collect()[0]
    assert (one["summary"], one["error"], one["prompt"]) == (None, "no model", None)


def test_exploration_report(spark):
    df = spark.createDataFrame([("T", ["b", "a"]), ("U", [])], "ticker string, a array<string>")
    got = dict(df.select("ticker", PL.exploration_report_prompt("ticker", F.lit("5"), F.lit("[1.0]"), F.col("a"))).collect())
    assert "Price Forecast for T (next 5 days): [1.0]\n\nRecent News Analysis:\n- b\n- a\n\n--- END DATA ---" in got["T"]
    assert "Recent News Analysis:\n\n--- END DATA ---" in got["U"]


def test_every_window_that_fits(spark):
    import datetime as dt

    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(200)]
    prices = spark.createDataFrame([("A", d, 10.0 + k) for k, d in enumerate(days)], "ticker string, date date, close double")
    got = {(r["pred_days"], r["context_days"]): r["count"] for r in CO.ts_corpus(prices, every=True).groupBy("pred_days", "context_days").count().collect()}
    assert got == {(p, c): 201 - p - c for p, c in K.CORPUS_HORIZONS if 201 - p - c > 0}
    one = CO.ts_corpus(prices, fixed=(30, 1)).select("i", "text")
    assert CO.ts_corpus(prices, every=True).where("context_days = 30 and pred_days = 1").select("i", "text").exceptAll(one).count() == 0


def test_caps_bind(spark):
    whole = V.corpus_df(spark, SF001).count()
    split = {r["split"]: r["count"] for r in V.q_tk_shuffle_split_binding(spark, SF001).groupBy("split").count().collect()}
    assert split["eval"] == V.EVAL_CAP and split["eval_overflow"] > 0 and 0 < sum(split.values()) < whole
    many = V.q_tk_news_cap_binding(spark, SF001).groupBy("ticker").count().agg(F.max("count")).collect()[0][0]
    assert many == V.NEWS_CAP
