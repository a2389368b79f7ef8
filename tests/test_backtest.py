import numpy as np
from pyspark.sql import functions as F

from pricelab.operators import backtest as BT
from pricelab.operators.horizons import horizon_table, resolve_horizon, validate_requests


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def metrics(spark, f, a):
    p = BT.pair_arrays(arr(*f), arr(*a))
    m = BT.forecast_error(p)
    cols = [m[k].alias(k) for k in ("mae", "mape", "mse", "rmse", "n_compared")]
    return spark.range(1).select(*cols, BT.directional_accuracy(p).alias("da")).first()


def test_metrics_match_numpy(spark):
    f, a = [10, 11, 13, 12], [10.5, 11.5, 12, 12.5]
    r = metrics(spark, f, a)
    e = np.array(f) - np.array(a)
    assert abs(r.mae - np.mean(np.abs(e))) < 1e-12
    assert abs(r.mape - np.mean(np.abs(e) / np.array(a)) * 100) < 1e-12
    assert abs(r.rmse - np.sqrt(np.mean(e ** 2))) < 1e-12
    da = (np.sign(np.diff(a)) == np.sign(np.diff(f))).sum() / 3 * 100
    assert abs(r.da - da) < 1e-12 and 0 <= r.da <= 100


def test_unequal_lengths_truncate(spark):
    r = metrics(spark, [1, 2], [1, 2, 3, 4])
    assert r.n_compared == 2


def test_single_step_and_zero_actual(spark):
    r = metrics(spark, [5], [4])
    assert r.da == 0.0 and r.n_compared == 1
    z = metrics(spark, [1, 2], [0, 2])
    assert z.mape is None and z.mae == 0.5


def test_outlook_tie_is_bearish(spark):
    r = spark.range(1).select(BT.outlook(arr(1, 3), F.lit(2.0)).alias("o"), BT.outlook(arr(3, 3), F.lit(2.0)).alias("p")).first()
    assert r.o == "bearish" and r.p == "bullish"


def test_horizon_lookup_both_paths(spark):
    req = spark.createDataFrame([(1, 1), (2, 2), (3, 30), (4, 31), (5, 90), (6, 91)], "request_id long, prediction_days int")
    want = {1: (1, 30), 2: (5, 60), 3: (30, 365), 4: (90, 1000), 5: (90, 1000), 6: (91, 1000)}
    a = {r.request_id: (r.model_days, r.context_days) for r in resolve_horizon(req).collect()}
    b = {r.request_id: (r.model_days, r.context_days) for r in resolve_horizon(req, horizon_table(spark)).collect()}
    assert a == want and b == want
    v = {r.request_id: r.error_message for r in validate_requests(req).collect()}
    assert v[6] == "Prediction days must be between 1 and 90." and v[1] is None


def test_one_shot_example(spark):
    ctx = arr(*range(100))
    ex_c, ex_t = BT.one_shot_example(ctx, 10)
    r = spark.range(1).select(ex_c.alias("c"), ex_t.alias("t")).first()
    assert r.c == [float(x) for x in range(30, 90)] and r.t == [float(x) for x in range(90, 100)]
    ex_c, _ = BT.one_shot_example(arr(*range(65)), 10)
    assert spark.range(1).select(ex_c.alias("c")).first().c is None
