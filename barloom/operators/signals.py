"""Signal generators: bars in, the same bars with indicator columns and `signal` in {-1, 0, 1}.

The functions leave helper columns behind (see `drop_helpers`), so that strategies added one after
the other share averages; `Strategy.signals` removes them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import Series, drop_helpers, with_position
from barloom.operators.indicators import with_bands, with_macd, with_mean, with_rsi

# Averages closer than this share of the price are equal: the order of summation decides the last digits.
TIE = 1e-12


def _signal(buy: Column, sell: Column) -> Column:
    return F.when(buy, 1).when(sell, -1).otherwise(0)


def _points(condition: Column, n: int) -> Column:
    return F.when(condition, n).otherwise(0)


def buy_and_hold(df: DataFrame, series: Series) -> DataFrame:
    return df.withColumn("signal", F.lit(1))


def sma_crossover(df: DataFrame, series: Series, short_window=50, long_window=200) -> DataFrame:
    df = with_mean(df, series, short_window, "short_ma")
    df = with_mean(df, series, long_window, "long_ma")
    lead = F.col("short_ma") - F.col("long_ma")
    tie = F.abs("long_ma") * TIE
    return df.withColumn("signal", _signal(lead > tie, lead <= tie))


def rsi_reversion(df: DataFrame, series: Series, window=14, overbought=70, oversold=30) -> DataFrame:
    df = with_rsi(df, series, window)
    return df.withColumn("signal", _signal(F.col("rsi") < oversold, F.col("rsi") > overbought))


def bollinger(df: DataFrame, series: Series, window=20, num_std=2.0) -> DataFrame:
    df = with_bands(df, series, window, num_std)
    return df.withColumn(
        "signal",
        _signal(F.col("close") < F.col("lower_band"), F.col("close") > F.col("upper_band")),
    )


def macd_cross(df: DataFrame, series: Series, fast=12, slow=26, signal=9) -> DataFrame:
    df = with_macd(df, series, fast, slow, signal)
    lead, tie = F.col("macd_histogram"), F.abs("close") * TIE
    return df.withColumn("signal", _signal(lead > tie, lead < -tie))


def multi_factor(
    df: DataFrame,
    series: Series,
    min_score=4,
    rsi_window=14,
    bb_window=20,
    bb_std=2.0,
    macd_fast=12,
    macd_slow=26,
    macd_signal=9,
    trend_window=200,
    vol_window=20,
    vol_multiplier=1.5,
) -> DataFrame:
    """Points from RSI (2), bands (2), high volume (+1 only), MACD histogram (1), trend (1)."""
    df = with_bands(df, series, bb_window, bb_std, prefix="mf_")
    df = with_mean(df, series, vol_window, "mf_avg_volume", "volume")
    df = with_mean(df, series, trend_window, "mf_trend_ma")
    df = with_rsi(df, series, rsi_window, out="mf_rsi")
    df = with_macd(df, series, macd_fast, macd_slow, macd_signal)
    df = df.withColumn("_rise", series.diff("macd_histogram"))
    close, tie = F.col("close"), F.abs("close") * TIE
    score = (
        _points(F.col("mf_rsi") < 35, 2)
        - _points(F.col("mf_rsi") > 65, 2)
        + _points(close < F.col("mf_lower_band"), 2)
        - _points(close > F.col("mf_upper_band"), 2)
        + _points(F.col("volume") > F.col("mf_avg_volume") * vol_multiplier, 1)
        + _points(F.col("_rise") > tie, 1)
        - _points(F.col("_rise") < -tie, 1)
        + _points(close > F.col("mf_trend_ma"), 1)
        - _points(close < F.col("mf_trend_ma"), 1)
    )
    df = df.withColumn("mf_score", score).drop("_rise")
    return df.withColumn(
        "signal", _signal(F.col("mf_score") >= min_score, F.col("mf_score") <= -min_score)
    )


def hysteresis(df: DataFrame, series: Series, enter: Column, leave: Column) -> DataFrame:
    """`signal` of a two-state machine: 1 on entering and while in, -1 on leaving, 0 while out.

    A row that only enters or only leaves fixes the state whatever it was, and a row that does
    both flips it, so the state is the last fixed one plus the flips since: two running windows.
    """
    e, x = F.coalesce(enter, F.lit(False)), F.coalesce(leave, F.lit(False))
    df = df.withColumns({"_e": e, "_x": x})
    fixed = F.when(F.col("_e") & ~F.col("_x"), 1).when(F.col("_x") & ~F.col("_e"), 0)
    flips = F.count_if(F.col("_e") & F.col("_x")).over(series.upto)
    df = df.withColumns({"_fixed": fixed, "_flips": flips})
    at_fixed = F.last(F.when(F.col("_fixed").isNotNull(), F.col("_flips")), True).over(series.upto)
    state = F.coalesce(F.last("_fixed", True).over(series.upto), F.lit(0))
    df = df.withColumn("_in", (state + F.col("_flips") - F.coalesce(at_fixed, F.lit(0))) % 2)
    was_in = F.lag("_in", 1, 0).over(series.w) == 1
    signal = F.when(was_in, F.when(F.col("_x"), -1).otherwise(1)).otherwise(
        F.when(F.col("_e"), 1).otherwise(0)
    )
    return df.withColumn("signal", signal).drop("_e", "_x", "_fixed", "_flips", "_in")


def momentum_pullback(
    df: DataFrame,
    series: Series,
    momentum_window=252,
    momentum_threshold=0.0,
    rsi_window=14,
    entry_rsi=40,
    exit_rsi=55,
    trend_ma=200,
) -> DataFrame:
    """Enter on an RSI dip in a rising, trending series; leave when RSI has recovered."""
    df = with_position(df, series)
    df = df.withColumn("momentum_return", series.pct_change("close", momentum_window))
    df = with_mean(df, series, trend_ma, "trend_ma")
    df = with_rsi(df, series, rsi_window, out="momr_rsi")
    enter = (
        (F.col("_pos") >= momentum_window)
        & (F.col("momentum_return") > momentum_threshold)
        & (F.col("close") > F.col("trend_ma"))
        & (F.col("momr_rsi") < entry_rsi)
    )
    return hysteresis(df, series, enter, F.col("momr_rsi") > exit_rsi)


@dataclass(frozen=True)
class Strategy:
    """A named signal generator. Any function (DataFrame, Series, **params) -> DataFrame with a
    `signal` column serves."""

    make: Callable[..., DataFrame]
    title: str  # str.format pattern over the parameters
    params: dict = field(default_factory=dict)

    def name(self, **params) -> str:
        return self.title.format(**{**self.params, **params})

    def signals(self, df: DataFrame, series: Series, **params) -> DataFrame:
        return drop_helpers(self.make(df, series, **{**self.params, **params}))


# Display names and default parameters.
STRATEGIES = {
    "SMA Crossover": Strategy(
        sma_crossover,
        "SMA Crossover ({short_window}/{long_window})",
        {"short_window": 50, "long_window": 200},
    ),
    "RSI Reversion": Strategy(
        rsi_reversion,
        "RSI Reversion ({window}, {oversold}/{overbought})",
        {"window": 14, "overbought": 70, "oversold": 30},
    ),
    "Bollinger Bands": Strategy(
        bollinger, "Bollinger Bands ({window}, {num_std}σ)", {"window": 20, "num_std": 2.0}
    ),
    "MACD": Strategy(
        macd_cross, "MACD ({fast}/{slow}/{signal})", {"fast": 12, "slow": 26, "signal": 9}
    ),
    "Multi-Factor": Strategy(
        multi_factor,
        "Multi-Factor (score≥{min_score})",
        {
            "min_score": 4,
            "rsi_window": 14,
            "bb_window": 20,
            "bb_std": 2.0,
            "macd_fast": 12,
            "macd_slow": 26,
            "macd_signal": 9,
            "trend_window": 200,
            "vol_window": 20,
            "vol_multiplier": 1.5,
        },
    ),
    "Momentum + MR": Strategy(
        momentum_pullback,
        "Momentum+MR (RSI {entry_rsi}/{exit_rsi})",
        {
            "momentum_window": 252,
            "momentum_threshold": 0.0,
            "rsi_window": 14,
            "entry_rsi": 40,
            "exit_rsi": 55,
            "trend_ma": 200,
        },
    ),
    "Buy & Hold": Strategy(buy_and_hold, "Buy & Hold"),
}
