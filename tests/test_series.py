import numpy as np
import pandas as pd
import pytest
from conftest import ordered, prices
from pyspark.sql import functions as F

from barloom import Series
from barloom.functions.series import Ewm, drop_helpers, ewm_block, with_ewm, with_position

S = Series("ticker")


def by_ticker(pdf, fn):
    return np.concatenate([fn(g).to_numpy() for _, g in pdf.groupby("ticker")])


@pytest.mark.parametrize("alpha", [2 / 10, 2 / 13, 2 / 27, 1 / 14, 1 / 200, 0.9])
def test_ewm_matches_pandas_over_several_blocks(bars, bars_pdf, alpha):
    got = ordered(with_ewm(bars, S, y=Ewm("close", alpha)))
    want = by_ticker(bars_pdf, lambda g: g["close"].ewm(alpha=alpha, adjust=False).mean())
    np.testing.assert_allclose(got["y"], want, rtol=1e-12)


def test_ewm_warm_up_and_leading_nulls(bars, bars_pdf):
    late = bars.withColumn("x", F.when(F.col("date") >= F.lit("2015-02-02"), F.col("close")))
    got = ordered(with_ewm(late, S, warm=Ewm.wilder("close", 14), late=Ewm("x", 0.1, leading_nulls=True)))
    pdf = bars_pdf.assign(
        x=bars_pdf["close"].where(pd.to_datetime(bars_pdf["date"]) >= "2015-02-02")
    )
    warm = by_ticker(pdf, lambda g: g["close"].ewm(alpha=1 / 14, min_periods=14, adjust=False).mean())
    x = by_ticker(pdf, lambda g: g["x"].ewm(alpha=0.1, adjust=False).mean())
    np.testing.assert_allclose(got["warm"], warm, rtol=1e-12)
    np.testing.assert_allclose(got["late"], x, rtol=1e-12)


def test_rates_far_apart_get_blocks_of_their_own(bars, bars_pdf):
    assert ewm_block([Ewm("x", 0.001), Ewm("x", 0.99)]) is None
    spans = [2, 3, 5, 8, 50, 60, 100, 150, 900]
    got = ordered(with_ewm(bars, S, **{f"e{n}": Ewm.span("close", n) for n in spans}))
    for n in spans:
        want = by_ticker(bars_pdf, lambda g, n=n: g["close"].ewm(span=n, adjust=False).mean())
        np.testing.assert_allclose(got[f"e{n}"], want, rtol=1e-11)


def test_a_nan_leaves_with_its_row(spark):
    close = np.linspace(10, 20, 400)
    close[5] = np.nan
    for n in (20, 50, 200):
        got = ordered(prices(spark, close).withColumn("m", S.mean("close", n)))["m"]
        want = pd.Series(np.where(np.isnan(close), 1e9, close)).rolling(n).mean()
        assert got[5 + n :].notna().all()
        np.testing.assert_allclose(got[5 + n :], want[5 + n :], rtol=1e-12)


@pytest.mark.parametrize("n", [3, 20, 33, 200])
def test_rolling_matches_pandas(bars, bars_pdf, n):
    df = with_position(bars, S)
    df = df.select(
        "ticker", "date", S.mean("close", n).alias("mean"), S.std("close", n).alias("std"),
        S.rolling_max("close", n).alias("max"), S.pct_change("close", n).alias("chg"),
    )
    got = ordered(df)
    roll = lambda f: by_ticker(bars_pdf, lambda g: f(g["close"]))
    np.testing.assert_allclose(got["mean"], roll(lambda c: c.rolling(n).mean()), rtol=1e-10)
    np.testing.assert_allclose(got["std"], roll(lambda c: c.rolling(n).std()), rtol=1e-7)
    np.testing.assert_allclose(got["max"], roll(lambda c: c.rolling(n, min_periods=1).max()))
    np.testing.assert_allclose(got["chg"], roll(lambda c: c.pct_change(n)), rtol=1e-10)


def test_slope_matches_least_squares(bars, bars_pdf):
    df = with_position(bars, S)
    got = ordered(df.select("ticker", "date", S.slope_pct("close", 20, "_pos").alias("slope")))
    fit = lambda a: np.polyfit(np.arange(len(a)), a, 1)[0] / a.mean() * 100
    want = by_ticker(bars_pdf, lambda g: g["close"].rolling(20).apply(fit, raw=True))
    np.testing.assert_allclose(got["slope"], want, rtol=1e-7, atol=1e-10)


def test_windows_with_gaps_are_null(spark):
    df = spark.createDataFrame([("X", i, None if i == 3 else float(i)) for i in range(8)], "ticker string, date int, v double")
    got = ordered(df.withColumn("m", S.mean("v", 3)))
    assert got["m"].isna().tolist() == [True, True, False, True, True, True, False, False]


def test_cumulative(bars, bars_pdf):
    got = ordered(bars.select("ticker", "date", S.drawdown("close").alias("dd"), S.cumprod(F.col("close") / 100).alias("p")))
    want = by_ticker(bars_pdf, lambda g: g["close"] / g["close"].cummax() - 1)
    np.testing.assert_allclose(got["dd"], want, atol=1e-12)
    np.testing.assert_allclose(got["p"], by_ticker(bars_pdf, lambda g: (g["close"] / 100).cumprod()), rtol=1e-9)


def test_helpers_are_dropped(bars):
    assert drop_helpers(with_ewm(bars, S, y=Ewm("close", 0.1))).columns == [*bars.columns, "y"]


def test_wide_windows_are_those_of_pandas(bars, bars_pdf):
    """Frames put together from pieces, with a gap and a NaN that leave with their rows."""
    from pyspark.sql import functions as F

    s = Series("ticker")
    odd = (F.col("_pos") == 300) & (F.col("ticker") == "B")
    df = bars.withColumn("_pos", s.position()).withColumn("hole", F.when(~odd, F.col("close"))).withColumn("nan", F.when(odd, float("nan")).otherwise(F.col("close")))
    sizes = (31, 32, 100, 252, 100_000)
    out = {}
    for n in sizes:
        out |= {f"mean{n}": s.mean("close", n), f"std{n}": s.std("close", n), f"max{n}": s.rolling_max("close", n), f"hole{n}": s.mean("hole", n), f"nan{n}": s.std("nan", n), f"slope{n}": s.slope_pct("close", n, "_pos")}
    got = ordered(df.select("ticker", "date", "hole", *(c.alias(k) for k, c in out.items())))
    by = bars_pdf.sort_values(["ticker", "date"], ignore_index=True).groupby("ticker")["close"]
    hole = got.groupby("ticker")["hole"]
    for n in sizes:
        for name, want in ((f"mean{n}", by.rolling(n).mean()), (f"std{n}", by.rolling(n).std()), (f"max{n}", by.rolling(n, min_periods=1).max()), (f"hole{n}", hole.rolling(n).mean())):
            np.testing.assert_allclose(got[name], want.reset_index(drop=True), rtol=1e-11, err_msg=name)
        touched = hole.transform(lambda h, n=n: h.isna().rolling(n, min_periods=1).max()).astype(bool)
        assert got[f"nan{n}"][touched].isna().all()
        np.testing.assert_allclose(got[f"nan{n}"][~touched], got[f"std{n}"][~touched], rtol=1e-11)
        fit = by.rolling(n).apply(lambda y: np.polyfit(np.arange(len(y)), y, 1)[0] / y.mean() * 100, raw=True).reset_index(drop=True)
        np.testing.assert_allclose(got[f"slope{n}"], fit, rtol=1e-5, atol=1e-9)


def test_rates_in_a_column_give_the_same_averages(bars):
    from pyspark.sql import functions as F

    from barloom.functions.series import with_ewm_of

    s = Series("ticker")
    rates = (1.0, 0.9, 2 / 13, 1 / 14, 2 / 1001)
    each = bars.withColumn("a", F.explode(F.array(*(F.lit(a) for a in rates))))
    got = with_ewm_of(each, s.within("a"), "a", y="close").select("a", "ticker", "date", "y").toPandas()
    for a in rates:
        want = ordered(with_ewm(bars, s, y=Ewm("close", a)).select("ticker", "date", "y"))
        mine = got[got.a == a].sort_values(["ticker", "date"], ignore_index=True)
        np.testing.assert_allclose(mine.y, want.y, rtol=1e-12)
