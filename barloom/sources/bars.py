"""Bar schema, normalisation on ingest, ranged scans and benchmark series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.series import Series

PRICES = ("open", "high", "low", "close")
VALUES = (*PRICES, "adj_close", "volume")

BAR_SCHEMA = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in VALUES]
)

# Provider headers as they arrive, and our names for them.
PROVIDER_COLUMNS = {
    "Date": "date",
    "Datetime": "date",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Adj Close": "adj_close",
    "Volume": "volume",
    "Ticker": "ticker",
}


def normalise(raw: DataFrame, date_type: str = "date") -> DataFrame:
    """Provider frame to bars: our column names, DOUBLE values, NaN to NULL, `adj_close` from
    `close` where absent. A two-level header (`Close|AAPL`) keeps its first level."""
    renamed = {}
    for c in raw.columns:
        head = c.split("|")[0]
        renamed[c] = PROVIDER_COLUMNS.get(head, head.strip().lower().replace(" ", "_"))
    df = raw.withColumnsRenamed(renamed)
    values = {
        c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        for c in VALUES
        if c in df.columns
    }
    df = df.withColumns({"date": F.col("date").cast(date_type), **values})
    adj = F.coalesce("adj_close", "close") if "adj_close" in df.columns else F.col("close")
    return df.withColumn("adj_close", adj)


def read_landed(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Files landed by an outside job, as bars."""
    return normalise(spark.read.format(fmt).options(**options).load(path))


def scan(
    bars: DataFrame,
    ticker=None,
    start: str | None = None,
    end: str | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Bars of some tickers with dates from start to end, both included."""
    if ticker is not None:
        wanted = [ticker] if isinstance(ticker, (str, int)) else list(ticker)
        bars = bars.where(F.col("ticker").isin(wanted))
    kind = bars.schema["date"].dataType.simpleString()
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast(kind))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end).cast(kind))
    return bars.select(*columns) if columns else bars


def date_range(bars: DataFrame, *keys: str) -> DataFrame:
    return bars.groupBy(*(keys or ("ticker",))).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def tickers(bars: DataFrame) -> DataFrame:
    return bars.select("ticker").distinct()


def row_counts(bars: DataFrame, *keys: str) -> DataFrame:
    return bars.groupBy(*(keys or ("ticker",))).agg(F.count("*").alias("bars"))


def resample(trades: DataFrame, price: str, size: str, order: list[str], *keys: str) -> DataFrame:
    """Trades to bars per (keys, date). Partial aggregation runs before the shuffle, so a
    ticker holding a large share of the trades sends one row per date and task."""
    first = F.struct(*order)
    return (
        trades.groupBy(*(keys or ("ticker",)), "date")
        .agg(
            F.min_by(price, first).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, first).alias("close"),
            F.sum(size).cast("double").alias("volume"),
        )
        .withColumn("adj_close", F.col("close"))
    )


# -- benchmark ------------------------------------------------------------------------------------
def returns(bars: DataFrame, series: Series, value: str = "close", out: str = "ret") -> DataFrame:
    """Row-on-row change; the first row of each series has none and is left out."""
    return (
        bars.withColumn(out, series.pct_change(value))
        .where(F.col(out).isNotNull())
        .select(*series.keys, series.order, out)
    )


def benchmark_equity(bars: DataFrame, series: Series, initial: float = 10_000.0) -> DataFrame:
    """Growth of `initial` held in each series; starts on the second bar."""
    start = F.first("close").over(series.upto)
    return (
        bars.withColumns(
            {"benchmark_equity": F.try_divide("close", start) * initial, "_pos": series.position()}
        )
        .where(F.col("_pos") > 0)
        .select(*series.keys, series.order, "benchmark_equity")
    )


def one_per_date(benchmark: DataFrame, order: str = "date") -> DataFrame:
    """A benchmark ready to join: one row per date, the mean where a date repeats. On DATE bars the calendar then bounds
    it (366 rows a year), so it is broadcast; finer benchmarks are left to Spark's size check."""
    unique = benchmark.groupBy(order).agg(*(F.avg(c).alias(c) for c in benchmark.columns if c != order))
    daily = benchmark.schema[order].dataType.simpleString() == "date"
    return F.broadcast(unique) if daily else unique


def equal_weighted(rets: DataFrame, ret: str = "ret") -> DataFrame:
    """One benchmark return per date: the mean over the tickers trading that day."""
    return rets.groupBy("date").agg(F.avg(ret).alias("bench_ret"))
