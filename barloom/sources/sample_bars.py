"""Bar series derived from the sample tables, for queries, benchmarks and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.series import Series, dealt
from barloom.sources.bars import resample

TICKER = Series("ticker")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily return, opening gap and volume per supplier. Discounts and taxes are summed as
    whole hundredths, so the result does not depend on the order of the lines."""

    def hundredths(c: str):
        return F.sum(F.floor(F.col(c) * 100 + 0.5))

    lines = table(spark, sf_dir, "lineitem")
    n = F.count("*") * 100.0
    return lines.groupBy(
        F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")
    ).agg(
        ((hundredths("l_discount") / n - 0.05) * 0.4).alias("move"),
        ((hundredths("l_tax") / n - 0.04) * 0.1).alias("gap"),
        F.sum("l_quantity").alias("volume"),
    )


def walk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random walk per supplier with one bar per shipping date."""
    # The number of lines comes from the files' footers; there are no more bars than that.
    moves = dealt(daily_moves(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), "ticker")
    grown = F.sum(F.log(1 + F.col("move")))
    before = F.coalesce(grown.over(TICKER.before(1)), F.lit(0.0))
    df = moves.withColumns(
        {
            "close": F.exp(grown.over(TICKER.upto)) * 100,
            "open": F.exp(before) * 100 * (1 + F.col("gap")),
        }
    )
    return df.select(
        "ticker",
        "date",
        "open",
        (F.greatest("open", "close") * 1.005).alias("high"),
        (F.least("open", "close") * 0.995).alias("low"),
        "close",
        F.col("close").alias("adj_close"),
        "volume",
    )


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk with damage by row number: gaps, swapped high and low, closes above the high,
    negative and zero volumes."""
    rn = F.row_number().over(TICKER.w)
    df = walk_bars(spark, sf_dir).withColumn("rn", rn)
    null = F.lit(None).cast("double")

    def every(k: int):
        return F.col("rn") % k == 0

    return df.select(
        "ticker",
        "date",
        F.when(F.col("rn") <= 2, null).otherwise(F.col("open")).alias("open"),
        F.when(every(41), F.col("low")).otherwise(F.col("high")).alias("high"),
        F.when(every(41), F.col("high")).otherwise(F.col("low")).alias("low"),
        F.when(every(37), null)
        .when(every(43), F.col("high") + 50)
        .otherwise(F.col("close"))
        .alias("close"),
        "adj_close",
        F.when(every(47), -F.col("volume"))
        .when(every(53), 0.0)
        .otherwise(F.col("volume"))
        .alias("volume"),
    )


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the line prices themselves."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return resample(lines, "price", "l_quantity", order, "ticker")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event values, one series per event type."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("date"),
        "value", F.lit(1).alias("one"), "ts", "event_id",
    )
    return resample(events, "value", "one", ["ts", "event_id"], "ticker")


def market_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-weighted daily return of all suppliers: (date, bench_ret)."""
    return (
        daily_moves(spark, sf_dir).groupBy("date").agg(F.avg("move").alias("bench_ret"))
    )


def synthetic_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade log with surplus closes: lines as trades, by return flag and line number."""
    # Dealt out by day, which serves the moments of a day and, downstream, the bins of round_trips.
    day = {"ticker": F.col("l_suppkey"), "date": F.to_date("l_shipdate")}
    lines = table(spark, sf_dir, "lineitem").withColumns(day).repartition(*day)
    # `seq` orders the trades of one date.
    order = Window.partitionBy(*day, "l_shipdate").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.select(
        "ticker",
        "date",
        (F.row_number().over(order) - 1).alias("seq"),
        F.when(F.col("l_returnflag") == "A", "BUY")
        .when(F.col("l_returnflag") == "R", "SELL")
        .when(F.col("l_linenumber") % 2 == 0, "SHORT")
        .otherwise("COVER")
        .alias("action"),
        F.col("l_quantity").alias("quantity"),
        price.alias("price"),
        (F.col("l_extendedprice") * 0.001).alias("commission"),
    )
