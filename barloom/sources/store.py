"""Parquet bar store: one table for all tickers and intervals.

Layout: `interval=.../bucket=.../piece=.../*.parquet`, sorted by ticker and date in each file. Tickers share
a fixed number of buckets by their checksum, so the number of files and folders does not grow with that of
tickers. A piece is a month of fine bars, or a year of daily and longer ones, named by its first day: ticker,
interval and dates prune directories and row groups, a large ticker is neither one task nor one file, and
replacing bars rewrites only the pieces of buckets they fall into.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import scalars as X
from barloom.functions.series import Series
from barloom.operators.clean import MIN_ROWS, clean
from barloom.sources.bars import VALUES, date_range

KEYS = ("interval", "ticker", "date")
# Intervals of a day or more.
DAILY = ("1d", "5d", "1wk", "1mo", "3mo")
# Fixed for all stores: a ticker's bucket must be the same in every write.
BUCKETS = 64
TAIL_TOLERANCE_DAYS = 3
MIN_HIT_ROWS = 10

STORED = T.StructType(
    [T.StructField("date", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in VALUES]
    + [T.StructField("interval", T.StringType()), T.StructField("ticker", T.StringType())]
)
IN_PIECES = T.StructType([*STORED.fields, T.StructField("bucket", T.IntegerType()), T.StructField("piece", T.DateType())])
PLACE = ("interval", "bucket", "piece")


def prepare(bars: DataFrame, interval: str = "1d") -> DataFrame:
    """Bars in the stored shape; tickers in capitals, `adj_close` from `close` where absent.
    `seq` is the order of arrival, which decides between rows of one date; without it the rows of
    one date count by their values, the same on every run."""
    adj = "coalesce(adj_close, close)" if "adj_close" in bars.columns else "close"
    seq = F.col("seq") if "seq" in bars.columns else F.lit(0).cast("bigint")
    return bars.select(
        F.col("date").cast("timestamp_ntz").alias("date"),
        *(
            (F.expr(adj) if c == "adj_close" else F.col(c)).cast("double").alias(c)
            for c in VALUES
        ),
        F.lit(interval).alias("interval"),
        F.upper(F.trim(F.col("ticker").cast("string"))).alias("ticker"),
        seq.alias("seq"),
    )


def first_per_date(rows: DataFrame) -> DataFrame:
    """Earliest arrival of each key: an aggregate, so duplicates shrink before the shuffle."""
    kept = F.min_by(F.struct(*VALUES), F.struct("seq", *VALUES))
    return rows.groupBy(*KEYS).agg(kept.alias("v")).select(*KEYS, "v.*")


def last_per_date(rows: DataFrame, *order: str) -> DataFrame:
    """Latest arrival of each key."""
    kept = F.max_by(F.struct(*VALUES), F.struct(*(order or ("seq",)), *VALUES))
    return rows.groupBy(*KEYS).agg(kept.alias("v")).select(*KEYS, "v.*")


def absent_rows(stored: DataFrame, new: DataFrame) -> DataFrame:
    """First write wins: the new rows whose key is not stored yet."""
    return _unstored(first_per_date(new), stored)


def _unstored(rows: DataFrame, stored: DataFrame) -> DataFrame:
    # Sorted keys shrink so well in a shuffle that millions of them would be sent through the driver.
    return rows.join(stored.select(*KEYS).hint("merge"), list(KEYS), "left_anti")


def merged_rows(stored: DataFrame, new: DataFrame, *within: str) -> DataFrame:
    """Last write wins: stored and new rows of every series, or of every `within`, that the new rows touch."""
    keys = list(within or ("interval", "ticker"))
    touched = new.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    # A file of `within` is replaced whole, so rows without a date stay with it; no series is without a name.
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) if within else F.col(k) == F.col(f"_{k}") for k in keys]
    old = stored.join(touched, same, "left_semi")
    both = old.withColumns({"batch": F.lit(0), "seq": F.lit(0).cast("bigint")}).unionByName(
        new.withColumn("batch", F.lit(1)), allowMissingColumns=True
    )
    return last_per_date(both, "batch", "seq")


class BarStore:
    """`daily_pieces` is the piece of daily and longer bars: "year", or "month" where many single days are replaced."""

    def __init__(self, spark: SparkSession, path: str, daily_pieces: str = "year"):
        self.spark = spark
        self.path = path.rstrip("/")
        self.daily_pieces = daily_pieces

    # -- files ------------------------------------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _in_pieces(self, rows: DataFrame) -> DataFrame:
        day = F.col("date").cast("date")
        daily = F.col("interval").isin(*DAILY)
        piece = F.when(daily, F.trunc(day, self.daily_pieces)).otherwise(F.trunc(day, "month"))
        bucket = F.coalesce(F.crc32(F.col("ticker").cast("binary")) % BUCKETS, F.lit(0)).cast("int")
        return rows.withColumns({"bucket": bucket, "piece": piece})

    def _write(self, rows: DataFrame, path: str, mode: str, **options) -> int:
        """Write rows that are in one task per place, or in whole files of one; their number."""
        written = Observation()
        (
            rows.sortWithinPartitions(*PLACE, "ticker", "date")
            .observe(written, F.count(F.lit(1)).alias("n"))
            .write.partitionBy(*PLACE)
            .options(compression="snappy", **options)
            .mode(mode)
            .parquet(path)
        )
        return written.get["n"]

    def clear(self) -> None:
        fs, where = self._fs(self.path)
        fs.delete(where, True)

    # -- reads --------------------------------------------------------------------------------------
    def _table(self) -> DataFrame:
        fs, where = self._fs(self.path)
        if not fs.exists(where):
            return self.spark.createDataFrame([], IN_PIECES)
        return self.spark.read.schema(IN_PIECES).parquet(self.path)

    def read(self) -> DataFrame:
        return self._table().select(*STORED.fieldNames())

    def load(self, ticker=None, start=None, end=None, interval="1d", columns=None) -> DataFrame:
        """Rows of one interval with dates from start to end, both included. An unknown ticker
        gives no rows; a damaged file fails the job."""
        df = self._table().where(F.col("interval") == interval)
        if ticker is not None:
            wanted = [ticker] if isinstance(ticker, str) else list(ticker)
            wanted = [t.strip().upper() for t in wanted]
            held = sorted({zlib.crc32(t.encode()) % BUCKETS for t in wanted})
            df = df.where(F.col("ticker").isin(wanted) & F.col("bucket").isin(held))
        if start is not None:
            at = F.lit(start).cast("timestamp_ntz")
            # A piece that holds the start begins in its year, whatever the size of pieces.
            df = df.where((F.col("date") >= at) & (F.col("piece") >= F.trunc(at.cast("date"), "year")))
        if end is not None:
            at = F.lit(end).cast("timestamp_ntz")
            df = df.where((F.col("date") <= at) & (F.col("piece") <= at.cast("date")))
        return df.select(*(columns or STORED.fieldNames()))

    def date_range(self, interval: str = "1d") -> DataFrame:
        return date_range(self.read().where(F.col("interval") == interval), "ticker")

    def row_count(self, ticker: str, interval: str = "1d") -> int:
        return self.load(ticker, interval=interval).count()

    def tickers(self) -> DataFrame:
        return self.read().select("ticker").distinct().orderBy("ticker")

    def statistics(self) -> DataFrame:
        """Rows, files and megabytes per ticker and interval, with a total row (NULL keys).

        Tickers share files: each counts the files that hold its rows, and its part of their size by rows.
        """
        per_file = (
            self._table()
            .select("interval", "ticker", "_metadata.file_path", "_metadata.file_size")
            .groupBy("interval", "ticker", "file_path", "file_size")
            .agg(F.count("*").alias("n"))
        )
        whole = F.sum("n").over(Window.partitionBy("file_path"))
        return (
            per_file.withColumn("part", F.col("file_size") * F.col("n") / whole)
            .rollup("ticker", "interval")
            .agg(
                F.sum("n").alias("rows"),
                F.count_distinct("file_path").alias("files"),
                F.round(F.sum("part") / (1024 * 1024), 2).alias("size_mb"),
                F.grouping_id().alias("level"),
            )
            .where(F.col("level").isin(0, 3))
            .drop("level")
        )

    # -- writes -------------------------------------------------------------------------------------
    def insert_absent(self, bars: DataFrame, interval: str = "1d") -> int:
        """Append the bars whose (ticker, date) is not stored; the number appended."""
        return self._append(absent_rows(self.read(), prepare(bars, interval)))

    def _append(self, rows: DataFrame) -> int:
        return self._write(self._in_pieces(rows).repartition(*PLACE), self.path, "append")

    def upsert(self, bars: DataFrame, interval: str = "1d") -> int:
        """Replace or add bars by date; the row count of the touched series afterwards.

        The merged pieces are written beside the table first, because their own files are the
        input, and then replace exactly the directories they belong to; pieces that no new bar
        falls into, in any ticker of their bucket, are neither read nor written.
        """
        staging = f"{self.path}/_staging/{uuid.uuid4().hex}"
        new = self._in_pieces(prepare(bars, interval))
        # Other tickers share the pieces that are replaced, so the touched ones are noted apart.
        new.select("interval", "ticker").distinct().write.parquet(f"{staging}/touched")
        # Rows without a ticker are no series: those of a piece are replaced together.
        unnamed = new.where("ticker IS NULL").select(F.col("interval").alias("_interval"), F.col("piece").alias("_piece")).distinct()
        replaced = F.col("ticker").isNull() & (F.col("interval") == F.col("_interval")) & F.col("piece").eqNullSafe(F.col("_piece"))
        merged = merged_rows(self._table().join(unnamed, replaced, "left_anti"), new, *PLACE)
        n = self._write(self._in_pieces(merged).repartition(*PLACE), f"{staging}/rows", "overwrite")
        if n:
            staged = self.spark.read.schema(IN_PIECES).parquet(f"{staging}/rows")
            self._write(staged, self.path, "overwrite", partitionOverwriteMode="dynamic")
            touched = self.spark.read.parquet(f"{staging}/touched")
            n = self.read().join(touched, ["interval", "ticker"], "left_semi").count()  # no other columns are read
        fs, where = self._fs(staging)
        fs.delete(where, True)
        return n

    def ingest(self, source: DataFrame, requests: DataFrame, interval="1d", min_rows=MIN_ROWS):
        """Fill the store for all requests (ticker, start, end) at once from `source` bars and
        return the cleaned bars asked for. A ticker with nothing stored is cleaned before it is
        stored; missing ends of a known ticker are stored as they arrive."""
        requests = requests.withColumn("ticker", F.upper(F.trim("ticker")))
        series = Series("interval", "ticker")
        gaps = missing_ranges(self.read().where(F.col("interval") == interval), requests)
        gaps = gaps.selectExpr("ticker", "gap_start AS start", "gap_end AS end", "whole_request")
        found = bars_asked_for(prepare(source, interval), gaps, "whole_request")
        known = found.where("NOT whole_request").drop("whole_request")
        fresh = found.where("whole_request").drop("whole_request")
        fresh = clean(first_per_date(fresh), series, min_rows)
        self._append(_unstored(first_per_date(known).unionByName(fresh), self.read()))
        return clean(bars_asked_for(self.load(interval=interval), requests), series, min_rows)


def merged_requests(requests: DataFrame, *same: str) -> DataFrame:
    """ticker, start, end of the stretches that requests cover together, none overlapping another.

    `same` are columns that are equal in all requests of a ticker. Requests without a ticker or an end, and
    those that end before they start, ask for nothing.
    """
    at = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")]
    asked = requests.select("ticker", *same, *at).where("start <= end AND ticker IS NOT NULL")
    asked = asked.groupBy("ticker", *same, "start").agg(F.max("end").alias("end"))  # repeats shrink before the shuffle
    by = Window.partitionBy("ticker").orderBy("start")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = asked.withColumn("_new", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    numbered = marked.withColumn("_stretch", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("ticker", *same, "_stretch").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_stretch")


def bars_asked_for(bars: DataFrame, requests: DataFrame, *same: str) -> DataFrame:
    """The bars inside at least one request (ticker, start, end), each once, with the columns `same` of its ticker's requests.

    The requests are merged and cut by month. Their ends are sorted among the bars of the month, and a
    bar is taken while a request is open: one pass, no pairs of bars and requests, and no task holds more than a
    month of a ticker. Bars before the first or after the last day asked for are left out before the shuffle where the tickers are few.
    """
    covered = merged_requests(requests, *same)
    first, last = (F.trunc(F.col(c).cast("date"), "month") for c in ("start", "end"))
    months = covered.withColumn("_month", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))))
    opened = F.struct(F.greatest("start", F.col("_month").cast("timestamp_ntz")).alias("_at"), F.lit(0).alias("_edge"), F.lit(1).alias("_open"))
    closed = F.struct(F.col("end").alias("_at"), F.lit(2).alias("_edge"), F.lit(-1).alias("_open"))
    # A stretch that goes on in the next month is open to the end of this one.
    ends = F.when(F.col("_month") == last, F.array(opened, closed)).otherwise(F.array(opened))
    edges = months.select("ticker", *same, "_month", F.inline(ends))
    rows = bars.withColumns({
        "_month": F.trunc(F.col("date").cast("date"), "month"), "_at": F.col("date").cast("timestamp_ntz"), "_edge": F.lit(1)})
    # The first and last day of a ticker suffice here: a row for each month would be sent through the driver.
    spans = covered.groupBy(F.col("ticker").alias("_ticker")).agg(F.min("start").alias("_start"), F.max("end").alias("_end"))
    rows = rows.join(spans, (F.col("ticker") == F.col("_ticker")) & F.col("_at").between(F.col("_start"), F.col("_end")), "left_semi")
    sofar = Window.partitionBy("ticker", "_month").orderBy("_at", "_edge").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.unionByName(edges, allowMissingColumns=True).withColumns(
        {"_open": F.sum("_open").over(sofar), **{c: F.max(c).over(sofar) for c in same}})
    return swept.where("_edge = 1 AND _open > 0").select(*bars.columns, *same)


def bars_inside(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """ticker, start, end, hits: stored bars inside each request, without pairing bars with requests.

    The ends of the requests are sorted among the bars of their ticker; the running count of bars at the
    end less that before the start is the answer.
    """
    at = [F.col(c).cast("timestamp_ntz") for c in ("start", "end")]
    asked = requests.select("ticker", "start", "end").distinct()
    ends = asked.select("ticker", "start", "end", F.inline(F.array(
        F.struct(at[0].alias("at"), F.lit(0).alias("edge"), F.lit(-1).alias("sign")),
        F.struct(at[1].alias("at"), F.lit(2).alias("edge"), F.lit(1).alias("sign")))))
    bars = stored.select("ticker", F.col("date").cast("timestamp_ntz").alias("at"), F.lit(1).alias("edge"))
    both = ends.unionByName(bars, allowMissingColumns=True)
    sofar = Window.partitionBy("ticker").orderBy("at", "edge").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("_n", F.count(F.when(F.col("edge") == 1, 1)).over(sofar)).where("sign IS NOT NULL")
    return counted.groupBy("ticker", "start", "end").agg(F.sum(F.col("sign") * F.col("_n")).alias("hits"))


def missing_ranges(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """Ranges to fetch per request (ticker, start, end): before the first and after the last
    stored bar, or the whole request where nothing is stored or nothing stored falls inside.

    A request counts as served when its end is at most three days past the last bar and more
    than ten bars fall inside it. Holes between the first and last bar are not looked for.
    """
    have = date_range(stored, "ticker")
    inside = bars_inside(stored, requests)
    df = requests.join(have, "ticker", "left").join(inside, ["ticker", "start", "end"], "left")
    df = df.withColumns(
        {c: F.col(c).cast("date") for c in ("start", "end", "first_date", "last_date")}
    )
    absent = F.col("first_date").isNull()
    served = (
        (F.col("first_date") <= F.col("start"))
        & (F.col("last_date") >= F.date_sub("end", TAIL_TOLERANCE_DAYS))
        & (F.coalesce("hits", F.lit(0)) > MIN_HIT_ROWS)
    )

    def span(a, b):
        return F.struct(a.alias("gap_start"), b.alias("gap_end"))

    head = F.when(
        F.col("start") < F.col("first_date"), span(F.col("start"), F.date_sub("first_date", 1))
    )
    tail = F.when(F.col("end") > F.col("last_date"), span(F.date_add("last_date", 1), F.col("end")))
    outside = absent | (F.coalesce("hits", F.lit(0)) == 0)
    ranges = F.when(outside, F.array(span(F.col("start"), F.col("end")))).when(
        ~served, F.filter(F.array(head, tail), lambda x: x.isNotNull())
    )
    return df.select("ticker", absent.alias("whole_request"), F.explode(ranges).alias("r")).select(
        "ticker", "r.gap_start", "r.gap_end", "whole_request"
    )


def interior_gaps(stored: DataFrame) -> DataFrame:
    """ticker, gap_start, gap_end, days: each run of weekdays without a bar between two bars of a ticker.

    The first and last weekday missing, and their number. Weekends are no gaps, nor is what lies before
    the first or after the last bar. Finer bars count by their day.
    """
    days = stored.select("ticker", F.col("date").cast("date").alias("date")).where("date IS NOT NULL").distinct()
    after = F.lead("date").over(Window.partitionBy("ticker").orderBy("date"))
    pair = days.withColumn("_next", after).select("ticker", F.date_add("date", 1).alias("a"), F.date_sub("_next", 1).alias("b"))
    found = pair.withColumn("days", X.business_days("a", "b")).where("days > 0")
    monday = F.date_add("a", F.when(F.weekday("a") > 4, 7 - F.weekday("a")).otherwise(0))
    friday = F.date_sub("b", F.greatest(F.weekday("b") - 4, F.lit(0)))
    return found.select("ticker", monday.alias("gap_start"), friday.alias("gap_end"), "days")


def failed_tickers(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """Requested tickers for which no bars came."""
    return requests.select("ticker").distinct().join(bars.select("ticker"), "ticker", "left_anti")
