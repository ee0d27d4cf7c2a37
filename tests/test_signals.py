import numpy as np
import pandas as pd
import pytest
from conftest import ordered, prices
from pyspark.sql import functions as F

from barloom import Series
from barloom.operators import indicators, signals
from barloom.operators.signals import STRATEGIES

S = Series("ticker")


def wilder(x, n, warm=True):
    return x.ewm(alpha=1 / n, min_periods=n if warm else 0, adjust=False).mean()


@pytest.mark.parametrize("name", list(STRATEGIES))
def test_signals_are_valid_and_input_is_kept(bars, name):
    before = bars.columns
    out = STRATEGIES[name].signals(bars, S)
    assert {r.signal for r in out.select("signal").distinct().collect()} <= {-1, 0, 1}
    assert out.count() == bars.count()
    assert bars.columns == before
    assert not [c for c in out.columns if c.startswith("_")]


def test_names():
    assert STRATEGIES["Buy & Hold"].name() == "Buy & Hold"
    assert STRATEGIES["SMA Crossover"].name(short_window=20) == "SMA Crossover (20/200)"
    assert STRATEGIES["Bollinger Bands"].name() == "Bollinger Bands (20, 2.0σ)"


def test_sma_turns_up_after_a_valley(spark):
    df = prices(spark, np.concatenate([np.linspace(100, 80, 25), np.linspace(80, 120, 25)]))
    got = ordered(signals.sma_crossover(df, S, 3, 10))
    assert (got["signal"].tail(5) == 1).all()


def test_sma_is_neutral_until_the_long_window_is_full(spark):
    got = ordered(signals.sma_crossover(prices(spark, range(100, 120)), S, 5, 15))
    assert (got["signal"].head(14) == 0).all()
    assert got["signal"].iloc[14] == 1


def test_equal_averages_are_not_a_buy(spark):
    got = ordered(signals.sma_crossover(prices(spark, [0.1] * 60), S, 5, 40))
    assert set(got["signal"].tail(21)) == {-1}


def test_rsi_signals(spark):
    fall = ordered(signals.rsi_reversion(prices(spark, np.linspace(100, 50, 50)), S))
    rise = ordered(signals.rsi_reversion(prices(spark, 50 * np.exp(np.linspace(0, 1.5, 100))), S))
    assert 1 in set(fall["signal"]) and -1 in set(rise["signal"])


def test_rsi_matches_pandas(bars, bars_pdf):
    got = ordered(indicators.with_rsi(bars, S))
    want = []
    for _, g in bars_pdf.groupby("ticker"):
        move = g["close"].diff()
        gain, loss = move.clip(lower=0).fillna(0), (-move).clip(lower=0).fillna(0)
        want.append(100 - 100 / (1 + wilder(gain, 14) / wilder(loss, 14)))
    np.testing.assert_allclose(got["rsi"], np.concatenate(want), rtol=1e-10)


def test_rsi_of_flat_prices_is_100(spark):
    got = ordered(indicators.with_rsi(prices(spark, [50.0] * 20), S))
    assert got["rsi"].isna().sum() == 13
    assert (got["rsi"].dropna() == 100).all()


def test_atr_and_adx_match_pandas(bars, bars_pdf):
    df = indicators.with_adx(indicators.with_atr(bars, S), S)
    got = ordered(df)
    atr, adx = [], []
    for _, g in bars_pdf.groupby("ticker"):
        pc = g["close"].shift()
        tr = pd.concat([g.high - g.low, (g.high - pc).abs(), (g.low - pc).abs()], axis=1).max(axis=1)
        up, down = g.high.diff(), -g.low.diff()
        p = up.where((up > down) & (up > 0), 0.0)
        m = down.where((down > up) & (down > 0), 0.0)
        p, m = (100 * wilder(x, 14, False) / wilder(tr, 14, False) for x in (p, m))
        atr.append(wilder(tr, 14))
        adx.append(wilder(100 * (p - m).abs() / (p + m + 1e-10), 14, False))
    np.testing.assert_allclose(got["atr"], np.concatenate(atr), rtol=1e-10)
    np.testing.assert_allclose(got["adx"], np.concatenate(adx), rtol=1e-8, atol=1e-8)


def test_regimes(spark):
    wild = prices(spark, 100 * np.cumprod(1 + np.tile([0.08, -0.07], 40)), "wild")
    up = prices(spark, np.linspace(100, 200, 80), "up")
    got = ordered(indicators.with_regime(wild.unionByName(up), S))
    last = got.groupby("ticker")["regime"].last()
    assert last["wild"] == "crisis" and last["up"] == "trending"
    flat = ordered(indicators.with_regime(prices(spark, [5.0] * 40, high=5.0, low=5.0), S))
    assert set(flat["regime"]) == {"ranging"} and flat["adx"].isna().all()


@pytest.mark.parametrize("seed", range(4))
def test_hysteresis_matches_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"t{i % 3}", i, bool(rng.random() < 0.3), bool(rng.random() < 0.4)) for i in range(240)]
    df = spark.createDataFrame(rows, "ticker string, date int, e boolean, x boolean")
    got = ordered(signals.hysteresis(df, S, F.col("e"), F.col("x")))
    for _, g in got.groupby("ticker"):
        inside, want = False, []
        for e, x in zip(g["e"], g["x"]):
            if inside:
                want.append(-1 if x else 1)
                inside = not x
            else:
                want.append(1 if e else 0)
                inside = e
        assert g["signal"].tolist() == want


def test_momentum_needs_a_year_of_bars(bars):
    got = ordered(STRATEGIES["Momentum + MR"].signals(bars, S, entry_rsi=60))
    first = got[got["signal"] == 1].groupby("ticker").head(1)
    place = got.groupby("ticker").cumcount()
    assert (place[first.index] >= 252).all()


def test_custom_strategy(bars):
    fresh = signals.Strategy(lambda df, s, at=1: df.withColumn("signal", F.lit(at)), "Always {at}", {"at": 1})
    assert fresh.name(at=0) == "Always 0"
    assert fresh.signals(bars, S, at=-1).where("signal = -1").count() == bars.count()


def test_crossover_on_very_high_flat_and_very_low_rising_prices(spark):
    flat = ordered(signals.sma_crossover(prices(spark, [500000.1] * 300), S, 50, 200))["signal"]
    assert set(flat[199:]) == {-1}
    rising = ordered(signals.sma_crossover(prices(spark, 1e-9 * (1 + np.arange(150) / 100)), S, 10, 50))["signal"]
    assert set(rising[49:]) == {1}
