"""Technical indicators and market regimes, as added columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import TRADING_DAYS
from barloom.functions.series import Ewm, Series, drop_helpers, with_ewm, with_position

ANNUAL = math.sqrt(TRADING_DAYS)


def with_rsi(df: DataFrame, series: Series, window: int = 14, out: str = "rsi") -> DataFrame:
    """Wilder RSI. Row 0 counts as a move of 0 and towards the warm-up; 100 without losses."""
    shared = f"_ind_rsi{window}"
    if shared not in df.columns:
        move = F.coalesce(series.diff("close"), F.lit(0.0))
        df = df.withColumn("_move", move).withColumns(
            {
                "_gain": F.greatest("_move", F.lit(0.0)),
                "_loss": F.greatest(-F.col("_move"), F.lit(0.0)),
            }
        )
        df = with_ewm(
            df, series, _ag=Ewm.wilder("_gain", window), _al=Ewm.wilder("_loss", window)
        )
        rsi = F.when(F.col("_al") == 0, F.lit(100.0)).otherwise(
            100 - F.try_divide(F.lit(100.0), 1 + F.try_divide("_ag", "_al"))
        )
        df = df.withColumn(shared, rsi).drop("_move", "_gain", "_loss", "_ag", "_al")
    return df.withColumn(out, F.col(shared))


def with_mean(df: DataFrame, series: Series, window: int, out: str, value="close") -> DataFrame:
    """Simple moving average."""
    shared = f"_ind_ma{window}_{value}"
    if shared not in df.columns:
        df = df.withColumn(shared, series.mean(value, window))
    return df.withColumn(out, F.col(shared))


def with_bands(df: DataFrame, series: Series, window=20, num_std=2.0, prefix="") -> DataFrame:
    mid, std, shared = f"{prefix}bb_sma", f"{prefix}bb_std", f"_ind_std{window}"
    df = with_mean(df, series, window, mid)
    if shared not in df.columns:
        df = df.withColumn(shared, series.std("close", window))
    width = F.col(shared) * num_std
    return df.withColumns(
        {
            std: F.col(shared),
            f"{prefix}upper_band": F.col(mid) + width,
            f"{prefix}lower_band": F.col(mid) - width,
        }
    )


def with_macd(df: DataFrame, series: Series, fast=12, slow=26, signal=9) -> DataFrame:
    line, smooth = f"_ind_macd{fast}_{slow}", f"_ind_macd{fast}_{slow}_{signal}"
    if line not in df.columns:
        df = with_ewm(df, series, _fast=Ewm.span("close", fast), _slow=Ewm.span("close", slow))
        df = df.withColumn(line, F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    if smooth not in df.columns:
        df = with_ewm(df, series, **{smooth: Ewm.span(line, signal)})
    return df.withColumns(
        {
            "macd": F.col(line),
            "macd_signal": F.col(smooth),
            "macd_histogram": F.col(line) - F.col(smooth),
        }
    )


def with_true_range(df: DataFrame, series: Series, out: str = "true_range") -> DataFrame:
    prev = series.lag("close")
    # greatest() skips NULL, so the first row is high - low.
    widest = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )
    return df.withColumn(out, widest)


def with_atr(df: DataFrame, series: Series, window: int = 14, out: str = "atr") -> DataFrame:
    df = with_true_range(df, series, "_tr")
    return with_ewm(df, series, **{out: Ewm.wilder("_tr", window)}).drop("_tr")


def with_adx(df: DataFrame, series: Series, window: int = 14, out: str = "adx") -> DataFrame:
    """Average directional index from Wilder averages without warm-up."""
    df = with_true_range(df, series, "_tr").withColumns(
        {"_up": series.diff("high"), "_down": -series.diff("low")}
    )
    up, down = F.col("_up"), F.col("_down")
    df = df.withColumns(
        {
            "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        }
    )
    smooth = {n: Ewm.wilder(c, window, warm_up=False) for n, c in
              {"_atr": "_tr", "_p": "_pdm", "_m": "_mdm"}.items()}
    df = with_ewm(df, series, **smooth).withColumns(
        {"plus_di": F.try_divide("_p", "_atr") * 100, "minus_di": F.try_divide("_m", "_atr") * 100}
    )
    gap, total = F.col("plus_di") - F.col("minus_di"), F.col("plus_di") + F.col("minus_di")
    df = df.withColumn("_dx", 100 * F.abs(gap) / (total + 1e-10))
    df = with_ewm(df, series, **{out: Ewm("_dx", 1.0 / window, leading_nulls=True)})
    return df.drop("_tr", "_up", "_down", "_pdm", "_mdm", "_atr", "_p", "_m", "_dx")


def with_volatility(df: DataFrame, series: Series, window=20, out="volatility_ann") -> DataFrame:
    df = df.withColumn("_ret", series.pct_change("close"))
    return df.withColumn(out, series.std("_ret", window) * ANNUAL).drop("_ret")


def with_slope(df: DataFrame, series: Series, window: int = 20, out="price_slope") -> DataFrame:
    df = with_position(df, series)
    return df.withColumn(out, series.slope_pct("close", window, "_pos"))


def with_regime(
    df: DataFrame,
    series: Series,
    adx_window=14,
    adx_trend=25.0,
    adx_range=20.0,
    vol_window=20,
    vol_crisis=0.4,
    slope_window=20,
) -> DataFrame:
    """Crisis by volatility first, then trending or ranging by ADX, ranging in between. The
    slope is reported and does not decide."""
    df = with_volatility(df, series, vol_window)
    df = with_slope(df, series, slope_window)
    df = with_adx(df, series, adx_window)
    regime = (
        F.when(F.col("volatility_ann") > vol_crisis, "crisis")
        .when(F.col("adx") > adx_trend, "trending")
        .when(F.col("adx") < adx_range, "ranging")
        .otherwise("ranging")
    )
    return drop_helpers(df.withColumn("regime", regime))


def regime_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*(keys or ("ticker",)), "regime").agg(F.count("*").alias("days"))


# Which strategies suit which regime.
COMPATIBLE = {
    "trending": ["SMA Crossover", "MACD", "Momentum + MR", "Buy & Hold"],
    "ranging": ["RSI Reversion", "Bollinger Bands", "Multi-Factor"],
    "crisis": ["Buy & Hold"],
}


def compatible_strategies(spark: SparkSession) -> DataFrame:
    rows = [(regime, name) for regime, names in COMPATIBLE.items() for name in names]
    return spark.createDataFrame(rows, "regime string, strategy string")


def with_rolling_metrics(equity: DataFrame, series: Series, window: int = 60) -> DataFrame:
    """Rolling Sharpe and volatility (%) and return to date (%) of equity curves with at least
    `window` + 10 rows."""
    df = equity.withColumn("_rows", F.count("*").over(series.whole)).where(
        F.col("_rows") >= window + 10
    )
    df = df.withColumn("ret", series.pct_change("total_equity"))
    mean, std = series.mean("ret", window), series.std("ret", window)
    df = df.withColumns(
        {
            "rolling_sharpe": F.try_divide(mean, std) * ANNUAL,
            "rolling_volatility_pct": std * ANNUAL * 100,
            "cum_return_pct": (series.cumprod(1 + F.col("ret")) - 1) * 100,
        }
    )
    return df.where(F.col("ret").isNotNull()).drop("_rows")
