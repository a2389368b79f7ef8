import os
import re

import pytest
from pyspark.sql import functions as F

from pricelab.functions import constants as K
from pricelab.operators import memo as MM
from pricelab.operators import models as M
from pricelab.plans import pipelines as PL
from pricelab.plans import standins as SI
from pricelab.session import scratch_path

from .conftest import bars_df
from .test_pipelines import requests

HEADLINES = "ticker string, date date, published_at timestamp_ntz, title string, source string, lang string, relevancy long"


def test_a_failing_batch_is_halved_to_the_failing_prompts():
    calls = []

    def model(prompts):
        calls.append(list(prompts))
        if any(p == "bad" for p in prompts):
            raise ValueError("cannot")
        return [p.upper() for p in prompts]

    got = M.attempt(model, ["a", "b", "bad", "c", "d"])
    assert got == (["A", "B", None, "C", "D"], [None, None, "cannot", None, None])
    assert calls.count(["bad"]) == 2  # tried once more
    assert M.attempt(lambda ps: ["x"], ["a", "b"])[0] == ["x", "x"]  # too few answers: alone, each has its one
    assert M.attempt(lambda ps: [], ["a"]) == ([None], ["the model gave 0 answers to 1 prompts"])


def test_generate_keeps_errors_as_values(spark):
    df = spark.createDataFrame([(k, None if k % 5 == 0 else f"p{k}") for k in range(40)], "id int, p string")

    def sometimes():
        def model(prompts):
            if any(p.endswith("7") for p in prompts):
                raise RuntimeError("seven")
            return ["ok " + p for p in prompts]
        return model

    for r in M.generate(df, "p", "out", sometimes, "err").collect():
        want = (None, None) if r.p is None else (None, "seven") if r.p.endswith("7") else ("ok " + r.p, None)
        assert (r.out, r.err) == want

    def broken():
        raise OSError("no such model")

    rows = M.generate(df, "p", "out", broken, "err").collect()
    assert {(r.out, r.err) for r in rows if r.p} == {(None, "no such model")}
    lab = M.classify(df, "p", "l", SI.md5_classifier).where("p is null").select("l.*").distinct().collect()
    assert [tuple(r) for r in lab] == [(None, None, None)]


def test_one_failing_prompt_is_one_failure_row(spark):
    import datetime as dt

    bars = bars_df(spark, {t: [100.0 + (k % 9) for k in range(400)] for t in ("AAA", "BBB", "CCC", "DDD", "EEE")})
    req = requests(spark, [(k, f"https://q.example.com/quote/{t}", 5) for k, t in enumerate(("AAA", "BBB", "CCC", "DDD", "EEE"))])
    day = dt.datetime(2024, 1, 1) + dt.timedelta(days=391)
    news = spark.createDataFrame([(t, day.date(), day, f"{t} {k}", "pages", "en", k) for t in ("AAA", "BBB", "CCC", "DDD", "EEE") for k in range(2)], HEADLINES)

    def on(word, factory):
        def made():
            model = factory()

            def answer(prompts):
                if any(re.search(word, p) for p in prompts):
                    raise RuntimeError("failed on " + word)
                return model(prompts)
            return answer
        return made

    def summary(prompts):
        return ["Fell from " + p.split("NEW_DATA_CHUNK: [")[1][:6] for p in prompts]

    models = (on("AAA", SI.last_value_forecaster), lambda: summary, on("BBB", SI.md5_writer), on("CCC", SI.md5_classifier))
    for run, report in ((PL.pl_analyze, "analyst_report"), (PL.pl_backtest, "final_test_report")):
        got = {r.ticker: r for r in run(req, bars, news, *models, period=None).collect()}
        assert {t: (r.status, r.error_message) for t, r in got.items()} == {
            "AAA": (K.STATUS_FAIL, "failed on AAA"), "BBB": (K.STATUS_FAIL, "failed on BBB"), "CCC": (K.STATUS_FAIL, "failed on CCC"),
            "DDD": (K.STATUS_OK, None), "EEE": (K.STATUS_OK, None)}
        assert got["DDD"][report].startswith("REPORT ") and got["BBB"][report] is None
    # a fold whose step raises
    models = (SI.last_value_forecaster, on("CHUNK", SI.chunk_summarizer), SI.md5_writer, SI.md5_classifier)
    assert {r.error_message for r in PL.pl_analyze(req, bars, news, *models, period=None).collect()} == {"failed on CHUNK"}


def never():
    def model(prompts):
        raise AssertionError("the model was called")
    return model


def test_second_run_makes_no_model_call(spark):
    memo = scratch_path(spark, "t-memo")
    df = spark.createDataFrame([(k, None if k == 9 else f"prompt {k % 4}") for k in range(12)], "id int, p string")
    first = MM.generate(df, "p", "out", SI.md5_writer, memo, name="writer", recalled_as="old").collect()
    assert {r.old for r in first} == {False, None} and spark.read.parquet(memo).count() == 4  # each different prompt once
    again = MM.generate(df, "p", "out", never, memo, name="writer", error="err", recalled_as="old").collect()
    assert {(r.id, r.out) for r in again} == {(r.id, r.out) for r in first}
    assert {r.err for r in again} == {None} and {r.old for r in again if r.p} == {True}
    # errors are not kept: what failed is asked again; another model's answers are its own
    failed = MM.generate(df, "p", "out", never, memo, name="other", error="err").where("p is not null").collect()
    assert {r.err for r in failed} == {"the model was called"}
    good = MM.generate(df, "p", "out", SI.md5_writer, memo, name="other", error="err", recalled_as="old").where("p is not null").collect()
    assert {(r.err, r.old) for r in good} == {(None, False)}


def test_fold_resumes_where_it_stopped(spark):
    memo = scratch_path(spark, "t-fold")
    text = ", ".join("1.00" for _ in range(40))
    chunks = spark.createDataFrame([(t, k, text if k else text + ", 2.00") for t in "AB" for k in range(6)], "ticker string, chunk_no int, chunk_text string")

    def stops():  # fails at A's and B's fifth step
        model = SI.chunk_summarizer()

        def answer(prompts):
            if any("Chunk 4," in p for p in prompts):
                raise RuntimeError("out of memory")
            return model(prompts)
        return answer

    run = lambda rows, f: {r.ticker: (r.summary, r.error, r.n_called) for r in MM.ordered_fold(rows, "ticker", "chunk_no", "chunk_text", f, memo, name="m").collect()}
    assert run(chunks, stops)["A"] == (None, "out of memory", 5)
    got = run(chunks, SI.chunk_summarizer)
    assert got["A"][0].startswith("Chunk 6,") and got["A"][1:] == (None, 2)  # steps five and six
    assert run(chunks, never)["B"] == (got["B"][0], None, 0)
    want = {r.ticker: r.summary for r in PL.ordered_fold(chunks, "ticker", "chunk_no", "chunk_text", SI.chunk_summarizer).collect()}
    assert {t: v[0] for t, v in got.items()} == want
    changed = chunks.withColumn("chunk_text", F.when(F.col("chunk_no") == 2, F.lit(text + ", 3.00")).otherwise(F.col("chunk_text")))
    assert run(changed, SI.chunk_summarizer)["A"][2] == 4  # from the changed chunk on


@pytest.mark.parametrize("run", [PL.pl_analyze, PL.pl_backtest])
def test_no_series_crosses_an_exchange_or_checkpoint(spark, run, monkeypatch):
    seen = []
    kept = PL._materialize
    monkeypatch.setattr(PL, "_materialize", lambda df: (seen.append((df.columns, df._jdf.queryExecution().executedPlan())), kept(df))[1])
    bars = bars_df(spark, {"AAA": [100.0 + (k % 9) for k in range(400)]})
    req = requests(spark, [(k, "https://q.example.com/quote/AAA", 5) for k in range(6)])
    out = run(req, bars, spark.createDataFrame([], HEADLINES), SI.last_value_forecaster, *SI.MODELS[1:], period=None)
    seen.append(([], out._jdf.queryExecution().executedPlan()))
    assert out.count() == 6 and len(seen) == 3

    def nodes(plan):
        yield plan
        inner = [plan.inputPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.children().apply(k) for k in range(plan.children().size())]
        for x in inner:
            yield from nodes(x)

    for columns, plan in seen:
        assert {"closes", "dates", "_ctx"}.isdisjoint(columns)
        moved = [{x.output().apply(k).name() for k in range(x.output().size())} for x in nodes(plan) if "Exchange" in x.nodeName()]
        assert moved and all(names.isdisjoint({"closes", "dates", "_ctx", "_final", "chunk"}) for names in moved), moved
    assert any("Bucketed: true" in plan.toString() for _, plan in seen)


def test_requests_of_one_ticker_and_horizon_share_one_job(spark):
    calls = scratch_path(spark, "t-calls")
    os.makedirs(calls)

    def counting():
        model = SI.last_value_forecaster()

        def answer(prompts):
            import uuid
            for _ in prompts:
                open(os.path.join(calls, uuid.uuid4().hex), "w").close()
            return model(prompts)
        return answer

    bars = bars_df(spark, {"AAA": [100.0 + (k % 9) for k in range(400)]})
    req = requests(spark, [(k, "https://q.example.com/quote/AAA", 1 + k % 2) for k in range(20)])
    out = PL.pl_analyze(req, bars, spark.createDataFrame([], HEADLINES), counting, *SI.MODELS[1:], period=None)
    assert out.where("status = 'Success'").count() == 20 and len(os.listdir(calls)) == 2
