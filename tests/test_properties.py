"""Property checks (hypothesis): render/parse round trip, metric bounds, chunk coverage."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricelab.functions import text as X
from pricelab.operators import backtest as BT
from pricelab.operators import features as FE

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
prices = st.lists(st.floats(min_value=0.01, max_value=1e6, allow_nan=False, allow_infinity=False),
                  min_size=1, max_size=40)


@SETTINGS
@given(prices)
def test_parse_of_render_is_two_decimal_rounding(spark, xs):
    df = spark.createDataFrame([(xs,)], "a array<double>")
    got = df.select(X.parse_prices(F.concat(F.lit("PREDICTION: ["), X.price_list_text("a"), F.lit("]"))).alias("p")).first().p
    assert got == [float("%.2f" % x) for x in xs]


@SETTINGS
@given(prices, prices)
def test_directional_accuracy_bounds(spark, f, a):
    df = spark.createDataFrame([(f, a)], "f array<double>, a array<double>")
    p = BT.pair_arrays("f", "a")
    r = df.select(BT.directional_accuracy(p).alias("da"), BT.forecast_error(p)["n_compared"].alias("n")).first()
    assert 0.0 <= r.da <= 100.0 and r.n == min(len(f), len(a))


@SETTINGS
@given(st.integers(min_value=0, max_value=900), st.sampled_from([(180, 30), (20, 5), (9, 8)]))
def test_chunks_cover_series_in_order(spark, n, so):
    size, overlap = so
    df = spark.createDataFrame([(list(range(n)),)], "closes array<int>").withColumn("ticker", F.lit("T"))
    ch = FE.overlap_chunks(df, size=size, overlap=overlap).orderBy("chunk_no").collect()
    seen = sorted({x for r in ch for x in r.chunk})
    assert seen == list(range(n))  # every row in some chunk
    assert all(len(r.chunk) <= size for r in ch)
    if ch:
        assert ch[-1].chunk[-1] == n - 1 and ch[0].chunk[0] == 0


def _py_trend3(first, last):
    pct = (last - first) / first * 100 if first > 0 else 0.0
    if abs(pct) < 5.0:
        return "stable"
    return "upward" if last > first else "downward"


def _py_jump(xs):
    return any(b < a * 0.5 or b > a * 2.0 for a, b in zip(xs, xs[1:]))


pairs = st.tuples(st.floats(min_value=-10, max_value=1e5, allow_nan=False, allow_infinity=False),
                  st.floats(min_value=0.01, max_value=1e5, allow_nan=False, allow_infinity=False))


@SETTINGS
@given(st.lists(pairs, min_size=1, max_size=30))
def test_trend3_matches_rule(spark, rows):
    from pricelab.functions.scalar import trend3

    df = spark.createDataFrame(rows, "f double, l double")
    got = [r.t for r in df.select(trend3("f", "l").alias("t")).collect()]
    assert got == [_py_trend3(f, l) for f, l in rows]


@SETTINGS
@given(st.lists(prices, min_size=1, max_size=10))
def test_jump_flag_matches_rule(spark, lists):
    from pricelab.functions.scalar import unreliable_jump

    df = spark.createDataFrame([(x,) for x in lists], "a array<double>")
    got = [r.j for r in df.select(unreliable_jump("a").alias("j")).collect()]
    assert got == [_py_jump(x) for x in lists]
