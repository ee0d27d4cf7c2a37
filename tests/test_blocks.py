import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import ordered
from pyspark.sql import functions as F

from barloom import Series
from barloom.functions.series import Ewm
from barloom.operators import blocks, indicators

S = Series("ticker")
COLUMNS = ["atr", "rsi", "sma", "momentum"]


@pytest.fixture(scope="module")
def minutes(spark):
    """Two series with uneven days: most bars on a few of them, and one series is most rows."""
    rng = np.random.default_rng(0)
    rows = []
    for ticker, n in (("hot", 6000), ("cold", 300)):
        at = np.unique(rng.integers(0, 40 * 24 * 60, n) ** 2 // (40 * 24 * 60))
        close = 100 * np.cumprod(1 + rng.normal(0, 0.001, len(at)))
        rows += [
            (ticker, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m)), float(c))
            for m, c in zip(at, close)
        ]
    df = spark.createDataFrame(rows, "ticker string, date timestamp_ntz, close double")
    return df.withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1, "volume": F.lit(1.0)}).cache()


def add(df, series):
    df = df.withColumns({"sma": series.mean("close", 50), "momentum": series.pct_change("close", 252)})
    return indicators.with_rsi(indicators.with_atr(df, series), series)


LOOKBACK = 252 + Ewm.wilder("x", 14).memory


@pytest.mark.parametrize("rows,bin", [(LOOKBACK, "hour"), (1000, "day"), (10**6, "day")])
def test_blocks_give_the_same_as_whole_series(minutes, rows, bin):
    whole = ordered(add(minutes, S).select("ticker", "date", *COLUMNS))
    cut = blocks.in_blocks(minutes, S, add, LOOKBACK, bin, rows)
    assert not {"_block", "_run_up", "_bin"} & set(cut.columns)
    got = ordered(cut.select("ticker", "date", *COLUMNS))
    assert len(got) == len(whole)
    for c in COLUMNS:
        np.testing.assert_allclose(got[c], whole[c], rtol=1e-9, err_msg=c)


def test_blocks_split_the_large_series(minutes):
    plan = blocks.block_plan(minutes, S, 100, "hour", 1000).toPandas()
    hot = plan[plan["ticker"] == "hot"]["_targets"].map(lambda t: t[0]["_block"])
    assert hot.nunique() >= 4
    with pytest.raises(ValueError):
        blocks.block_plan(minutes, S, 1001, "hour", 1000)


@pytest.mark.parametrize("bin", ["hour", "day", "year"])
def test_running_totals_in_bins(minutes, bin):
    df = minutes.withColumn("some", F.when(F.minute("date") % 7 == 0, F.col("close")))
    got = blocks.running_in_bins(
        df, S, bin, peak=("max", "close"), low=("min", "close"), n=("sum", "volume"),
        grown=("product", "volume"), known=("last", "some"),
    )
    want = df.withColumns(
        {
            "peak": S.running_max("close"), "low": F.min("close").over(S.upto),
            "n": F.sum("volume").over(S.upto), "grown": S.cumprod("volume"), "known": S.ffill("some"),
        }
    )
    names = ["ticker", "date", "peak", "low", "n", "grown", "known"]
    assert ordered(got.select(names)).equals(ordered(want.select(names)))


@pytest.mark.parametrize("bin", ["day", "month"])
def test_low_of_a_running_sum_in_bins(spark, bin):
    rng = np.random.default_rng(5)
    rows = [(t, pd.Timestamp("2022-01-03").date() + pd.Timedelta(days=i // 4), i, int(d)) for t in "ab" for i, d in enumerate(rng.choice([-1, 1], 200))]
    df = spark.createDataFrame(rows, "ticker string, date date, seq int, delta int").repartition(3)
    want = []
    for t in "ab":
        was = low = 0
        for _, day, i, d in (r for r in rows if r[0] == t):
            low, was = min(low, was), was + d
            want.append((t, i, was, low))
    got = blocks.running_in_bins(df, Series("ticker"), bin, ("date", "seq"), total=("sum", "delta"), low=("low", "delta"))
    assert sorted(tuple(r) for r in got.select("ticker", "seq", "total", "low").collect()) == want
    assert min(w[3] for w in want) < -1
    undated = spark.createDataFrame([("a", None, i, d) for i, d in enumerate((-1, 1, 1))], df.schema)
    got = blocks.running_in_bins(undated.unionByName(df), Series("ticker"), bin, ("date", "seq"), total=("sum", "delta"), low=("low", "delta"))
    moved = [(t, i, total + (t == "a"), low + (t == "a")) for t, i, total, low in want]
    assert sorted(tuple(r) for r in got.select("ticker", "seq", "total", "low").collect()) == moved


def test_underwater(spark):
    rng = np.random.default_rng(3)
    start = pd.Timestamp("2022-01-03")
    frames = []
    for name, steps in (("walk", rng.normal(0, 1, 900)), ("falls", -np.ones(300)), ("rises", np.ones(50)), ("flat", np.zeros(50))):
        close = 2000 + np.cumsum(np.round(steps))
        frames.append(pd.DataFrame({"ticker": name, "date": start + pd.to_timedelta(np.arange(len(close)) * 5, unit="h"), "close": close}))
    pdf = pd.concat(frames, ignore_index=True)
    want = {}
    for name, one in pdf.groupby("ticker"):
        longest = run = 0
        peak, fall = -np.inf, 0.0
        for c in one["close"]:
            peak = max(peak, c)
            run = run + 1 if c < peak else 0
            longest, fall = max(longest, run), min(fall, (c - peak) / peak)
        want[name] = (round(fall, 12), longest)
    holes = pdf.assign(close=None, date=pdf["date"] + pd.Timedelta(hours=1))
    df = spark.createDataFrame(pd.concat([pdf, holes]).astype({"close": float})).withColumn("close", F.nanvl("close", F.lit(None)))
    for bin in ("day", "month"):
        got = {r.ticker: (round(r.max_drawdown, 12), r.duration) for r in blocks.underwater(df.repartition(5), Series("ticker"), bin=bin).collect()}
        assert got == want
    assert want["falls"][1] == 299 and want["rises"] == want["flat"] == (0.0, 0)
    assert blocks.underwater(df.limit(0), Series("ticker")).count() == 0
