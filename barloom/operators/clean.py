"""Cleaning and validation of bars, one pass over all tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import Series

# The columns of a bar that must be there, and those that are filled.
EXPECTED = ("date", "open", "high", "low", "close", "volume")
FILLED = EXPECTED[1:]
MIN_ROWS = 30
ZERO_VOLUME_SHARE = 0.1


def missing_columns(bars: DataFrame) -> list[str]:
    return [c for c in EXPECTED if c not in bars.columns]


def fill_gaps(bars: DataFrame, series: Series) -> DataFrame:
    """Carry the last value forward, then the first one back. `adj_close` stays as it is."""
    present = [c for c in FILLED if c in bars.columns]
    return bars.withColumns({c: F.coalesce(series.ffill(c), series.first_known(c)) for c in present})


def fix_high_low(bars: DataFrame) -> DataFrame:
    swapped = F.col("high") < F.col("low")
    return bars.withColumns(
        {
            "high": F.when(swapped, F.col("low")).otherwise(F.col("high")),
            "low": F.when(swapped, F.col("high")).otherwise(F.col("low")),
        }
    )


def clamp_close(bars: DataFrame) -> DataFrame:
    known = F.col("close").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull()
    inside = F.least(F.greatest("close", "low"), "high")
    return bars.withColumn("close", F.when(known, inside).otherwise(F.col("close")))


def fix_volume(bars: DataFrame) -> DataFrame:
    return bars.withColumn("volume", F.when(F.col("volume") < 0, 0.0).otherwise(F.col("volume")))


def long_enough(bars: DataFrame, series: Series, min_rows: int = MIN_ROWS) -> DataFrame:
    """Only the series with at least `min_rows` bars."""
    return (
        bars.withColumn("_rows", F.count("*").over(series.whole))
        .where(F.col("_rows") >= min_rows)
        .drop("_rows")
    )


def too_short(bars: DataFrame, series: Series, min_rows: int = MIN_ROWS) -> DataFrame:
    """The series `long_enough` leaves out, with their lengths."""
    counts = bars.groupBy(*series.keys).agg(F.count("*").alias("available"))
    return counts.where(F.col("available") < min_rows).withColumn("required", F.lit(min_rows))


def clean(bars: DataFrame, series: Series, min_rows: int = MIN_ROWS) -> DataFrame:
    """All steps in their order: fill, high/low, close, volume, minimum history."""
    df = fill_gaps(bars, series)
    df = fix_volume(clamp_close(fix_high_low(df)))
    return long_enough(df, series, min_rows)


def require_history(bars: DataFrame, series: Series, min_rows: int = MIN_ROWS) -> DataFrame:
    """Like `long_enough`, but the job fails on a series that is too short."""
    n = F.count("*").over(series.whole)
    text = F.format_string(f"only %d rows after cleaning, need {min_rows}", n)
    checked = F.when(n < min_rows, F.raise_error(text)).otherwise(F.lit(True))
    return bars.withColumn("_ok", checked.cast("boolean")).where("_ok").drop("_ok")


def quality_report(bars: DataFrame, series: Series) -> DataFrame:
    """What cleaning would find, one row per series. Zero volume counts after negative volume
    has become zero."""
    nulls = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in FILLED}
    zero = F.count_if(F.col("volume") <= 0)
    return (
        bars.groupBy(*series.keys)
        .agg(
            F.count("*").alias("bars"),
            *(c.alias(n) for n, c in nulls.items()),
            F.count_if(F.col("high") < F.col("low")).alias("inverted"),
            F.count_if(F.col("volume") < 0).alias("negative_volume"),
            zero.alias("zero_volume"),
            (zero > F.count("*") * ZERO_VOLUME_SHARE).alias("volume_suspect"),
        )
    )
