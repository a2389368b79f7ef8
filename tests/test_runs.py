"""Numbering, shards, corpus runs, spans by request, news search by index, records with prices."""

import datetime as dt
import glob
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from pricelab.operators import corpus as CO
from pricelab.operators import features as FE
from pricelab.operators import news as NW
from pricelab.operators.numbering import numbered, numbered_keys
from pricelab.session import scratch_path
from pricelab.sources import files as IO
from pricelab.sources import runs as RU
from pricelab.sources import shards as SH

from .conftest import SF001, bars_df


def test_numbering_is_dense_and_in_order(spark):
    values = [(k * 7919) % 1000 for k in range(3000)]
    got = numbered(spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v int, k int"), "v", "k").orderBy("pos").collect()
    assert [(r.v, r.k, r.pos) for r in got] == [(v, k, p) for p, (v, k) in enumerate(sorted((v, k) for k, v in enumerate(values)))]
    keys = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "ticker string")
    assert sorted(tuple(r) for r in numbered_keys(keys).collect()) == [(0, "a"), (1, "b"), (2, "c")]
    assert numbered_keys(keys.limit(0)).count() == 0
    assert numbered(spark.createDataFrame([(1,)] * 500, "v int"), "v").agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()[:] == (0, 499, 500)


@pytest.mark.parametrize("name", ["tk_sorted_universe", "jn_resume_positional"])
def test_universe_is_not_collected(spark, name):
    import __spark_entry__ as E

    plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
    for part in plan.split("Exchange SinglePartition")[1:]:  # only the ranges' sizes, or a largest position, are ordered in one place
        assert "ticker" not in part.split("\n")[1]


def small_corpus(spark, n=130):
    return CO.ts_corpus(FE.ingest(bars_df(spark, {t: [50.0 + (k * 7 % 13) for k in range(n)] for t in ("AA", "BB", "CC", "DD", "EE")}), None))


def test_shards_in_order_and_by_seek(spark):
    rows = CO.split_corpus(small_corpus(spark))
    path = scratch_path(spark, "t-shards")
    SH.write_shards(rows, path, shard_rows=50, columns=("ticker", "i", "text"))
    want = [(r.ticker, r.i, r.text) for r in rows.orderBy("order_key", "ticker", "i").collect()]
    files = sorted(glob.glob(os.path.join(path, "shards", "shard=*", "part-*")), key=lambda f: int(f.split("shard=")[1].split("/")[0]))
    lines = [open(f, "rb").read().splitlines() for f in files]
    assert [len(x) for x in lines[:-1]] == [50] * (len(files) - 1) and 0 < len(lines[-1]) <= 50
    got = [json.loads(x) for x in sum(lines, [])]
    assert [(r["ticker"], r["i"], r["text"]) for r in got] == want
    for r in SH.read_index(spark, path).where("pos % 37 = 0").collect():  # a line by its bytes
        with open(files[r.shard], "rb") as f:
            f.seek(r.begin)
            assert json.loads(f.read(r["size"]))["text"] == want[r.pos][2]
    back = SH.read_shards(spark, path, "ticker string, i int, text string").orderBy("pos").collect()
    assert [(r.ticker, r.i, r.text) for r in back] == want


def test_a_shard_is_joined_once_and_not_once_a_line(spark):
    path = scratch_path(spark, "t-shards")
    SH.write_shards(CO.split_corpus(small_corpus(spark)), path, shard_rows=50, columns=("ticker", "i", "text"))
    back = SH.read_shards(spark, path, "ticker string, i int, text string")
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate ") < plan.index("Join ") < plan.index("Aggregate [shard")  # cut after the join, index grouped before it
    index = SH.read_index(spark, path)
    assert sorted(r.pos for r in back.collect()) == sorted(r.pos for r in index.collect())
    shards = sum(1 for _ in glob.glob(os.path.join(path, "shards", "shard=*", "part-*")))
    assert shards == 2 and index.select("shard").distinct().count() == shards


def test_shards_hold_lines_of_many_bytes_and_rows_alike(spark):
    rows = spark.createDataFrame([(k // 2, "é" * (k % 7) + '"\n' + str(k // 2)) for k in range(40)], "k int, text string")
    path = scratch_path(spark, "t-shards")
    SH.write_shards(rows, path, shard_rows=7, order=("k",))
    got = SH.read_shards(spark, path).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(40))
    assert sorted(r.text for r in got) == sorted(r.text for r in rows.collect()) and [int(r.text.split("\n")[1]) for r in got] == [k // 2 for k in range(40)]
    assert SH.read_index(spark, path).where("begin = 0").count() == 6


def stopping(at):
    def after(k):
        if k == at:
            raise InterruptedError
    return after


def test_killed_run_resumes_to_the_same_corpus(spark):
    prices = FE.ingest(bars_df(spark, {t: [50.0 + (k * 7 % 13) for k in range(130)] for t in ("AA", "BB", "CC", "DD", "EE")} | {"SHORT": [1.0] * 30}), None)
    universe, built = prices.select("ticker").distinct(), []
    path = scratch_path(spark, "t-run")

    def build(some):
        built.append({r.ticker for r in some.collect()})
        return CO.ts_corpus(prices.join(some, "ticker", "left_semi"))

    whole = {(r.ticker, r.i, r.text) for r in CO.ts_corpus(prices).collect()}
    content = lambda: sorted((r.ticker, r.i, r.text) for r in RU.corpus(spark, path).collect())
    assert content() == [] and RU.done_tickers(spark, path).count() == 0
    with pytest.raises(InterruptedError):
        RU.run(universe, build, path, parts=3, after_part=stopping(0))
    first = {r.ticker for r in RU.done_tickers(spark, path).collect()}
    # a part whose data is there, but no manifest: killed between the two
    lost = glob.glob(os.path.join(path, "data", "part=*"))
    shutil.copytree(lost[0], lost[0] + "x")
    built.clear()
    RU.run(universe, build, path, parts=2)
    assert set().union(*built) == {"AA", "BB", "CC", "DD", "EE", "SHORT"} - first
    assert content() == sorted(whole) and RU.damaged(spark, path).count() == 0
    assert {r.ticker for r in RU.done_tickers(spark, path).collect()} >= {"SHORT"}  # done, though it has no prompt
    built.clear()
    RU.run(universe, build, path)
    assert set().union(*built) == set()
    with pytest.raises(FileExistsError):
        RU.run(universe, build, path, mode="abort")
    with pytest.raises(ValueError):
        RU.run(universe, build, path, mode="other")
    some = universe.where("ticker in ('AA', 'BB')")
    RU.run(some, build, path, mode="overwrite", parts=2)
    assert content() == sorted(x for x in whole if x[0] in ("AA", "BB"))
    RU.run(universe, build, path, parts=2)
    assert content() == sorted(whole)
    # a file that was changed behind the manifest's back
    part = glob.glob(os.path.join(path, "data", "part=*", "ticker=CC", "*.json"))[-1]
    text = open(part).read().splitlines()
    used = {r.part for r in RU.manifest(spark, path).where("ticker = 'CC'").collect()}
    part = next(f for f in glob.glob(os.path.join(path, "data", "part=*", "ticker=CC", "*.json")) if any(p in f for p in used))
    text = open(part).read().splitlines()
    open(part, "w").write("\n".join(text[1:]) + "\n")
    crc = os.path.join(os.path.dirname(part), "." + os.path.basename(part) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)
    assert [r.ticker for r in RU.damaged(spark, path).collect()] == ["CC"]


def test_corpus_without_a_manifest_is_read_by_its_tags(spark):
    path = scratch_path(spark, "t-tags")
    small_corpus(spark).where("ticker in ('AA', 'CC')").select("text").write.json(path)
    assert sorted(r.ticker for r in RU.done_tickers(spark, path).collect()) == ["AA", "CC"]


def test_history_by_request(spark):
    bars = bars_df(spark, {"A": [float(k) for k in range(2200)], "B": [1.0] * 40})
    last = bars.agg(F.max("date")).first()[0]
    rows = [(1, "A", "1mo"), (2, "A", "5y"), (3, "A", "5y"), (4, "B", "3y"), (5, "NONE", "1y"), (6, "A", "ever"), (7, "A", None), (8, None, "1y")]
    got = FE.price_history_by_request(bars, spark.createDataFrame(rows, "request_id long, ticker string, period string"))
    assert got.columns == ["request_id", *bars.columns]
    n = {r.request_id: (r["count"], r.first) for r in got.groupBy("request_id").agg(F.count("*").alias("count"), F.min("date").alias("first")).collect()}
    assert set(n) == {1, 2, 3} and n[2] == n[3]
    assert n[1][1] > last - dt.timedelta(days=32) and n[2][0] == (last - n[2][1]).days + 1
    assert FE.price_history_by_request(bars, spark.createDataFrame(rows, "request_id long, ticker string, period string"), asof="2024-02-05").where("request_id = 4").count() == 36


def test_search_looks_names_up_by_their_rarest_word(spark):
    titles = ["The Home Depot rises", "the home of the depot", "Home Depot, the", "A THE HOME DEPOT B", "The the", "new THD high", "Wal-Mart up", None, "", "The Home Depot rises"]
    h = spark.createDataFrame([("x", t, k) for k, t in enumerate(titles)], "ticker string, title string, k int")
    c = spark.createDataFrame([("THD", "The Home Depot"), ("TT", "The The"), ("WMT", "Wal-Mart"), ("NO", "Nowhere to be found"), ("ODD", "!!"), ("NUL", None)], "ticker string, name string")
    got = sorted((r.ticker, r.k) for r in NW.news_search(h, c).collect())
    assert got == [("THD", 0), ("THD", 3), ("THD", 5), ("THD", 9), ("TT", 4), ("WMT", 6)]
    assert NW.news_search(h.limit(0), c).count() == 0 and NW.news_search(h, c.limit(0)).count() == 0


def test_records_carry_their_prices(spark):
    bars = bars_df(spark, {"A": [1.0, 2.0, 3.0, 4.0]})
    res = spark.createDataFrame([(1, "A", dt.date(2024, 1, 3)), (2, "A", None), (3, None, None), (4, "B", dt.date(2024, 1, 3)), (5, "A", dt.date(2024, 1, 3))], "request_id long, ticker string, asof date")
    full, path = IO.with_prices(res, bars), scratch_path(spark, "t-records")
    IO.write_records(full, path)
    back = {r.request_id: [(x.date, x.close) for x in r.historical_data] for r in IO.read_records(spark, path, full.schema).collect()}
    days = [(dt.date(2024, 1, 1 + k), 1.0 + k) for k in range(3)]
    assert back == {1: days, 2: [], 3: [], 4: [], 5: days}
