"""Long series in pieces, for bars too fine for the calendar to bound a series.

`in_blocks` cuts every series into blocks of whole time bins and gives each block enough of the
rows before it. `running_in_bins` computes running totals from totals per bin. Neither puts a
whole series into one task, so one ticker may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import Series

ROWS_PER_BLOCK = 1_000_000


def _bin_of(df: DataFrame, series: Series, bin: str) -> Column:
    """The time bin of a row. The day of a date is the date itself: rows dealt out by it then stay where they are."""
    if bin == "day" and df.schema[series.order].dataType.simpleString() == "date":
        return F.col(series.order)
    return F.date_trunc(bin, series.order)


def _bins(df: DataFrame, series: Series, bin: str, *aggs: Column) -> DataFrame:
    """Totals per key and time bin. Map-side aggregation leaves one row per bin and task."""
    return df.groupBy(*series.keys, F.date_trunc(bin, series.order).alias("_bin")).agg(*aggs)


def block_plan(
    df: DataFrame, series: Series, lookback: int, bin: str, rows: int
) -> DataFrame:
    """For every (keys, bin): the block it belongs to and the blocks it is run-up for.

    Blocks start every `rows` rows, on a bin boundary. Two neighbouring blocks hold more than
    `rows` rows together, so with rows >= lookback a block's run-up lies in the two before it.
    """
    if rows < lookback:
        raise ValueError("a block must be at least as long as the lookback")
    keys = list(series.keys)
    bins = _bins(df, series, bin, F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    bins = bins.withColumn("_block", F.floor(F.col("_from") / rows))
    starts = bins.groupBy(*keys, "_block").agg(F.min("_from").alias("_start"))
    nxt = Window.partitionBy(*keys).orderBy("_block")
    ahead = {}
    for i in (1, 2):
        ahead[f"_block{i}"] = F.lead("_block", i).over(nxt)
        ahead[f"_start{i}"] = F.lead("_start", i).over(nxt)
    starts = starts.withColumns(ahead).drop("_start")

    def target(block: str, run_up: bool) -> Column:
        return F.struct(F.col(block).alias("_block"), F.lit(run_up).alias("_run_up"))

    end = F.col("_from") + F.col("_n")
    needed = [
        F.when(end > F.col(f"_start{i}") - lookback, target(f"_block{i}", True)) for i in (1, 2)
    ]
    targets = F.filter(F.array(target("_block", False), *needed), lambda t: t.isNotNull())
    return bins.join(starts, [*keys, "_block"]).select(*keys, "_bin", targets.alias("_targets"))


def in_blocks(
    df: DataFrame,
    series: Series,
    fn: Callable[[DataFrame, Series], DataFrame],
    lookback: int,
    bin: str = "day",
    rows: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """`fn` on every series, block by block. A row of its output may depend on at most `lookback`
    earlier rows (an exponential average: its `memory` more than its input). `bin` is the
    largest time step whose bars one task can hold."""
    keys = list(series.keys)
    plan = block_plan(df, series, lookback, bin, rows)
    cut = (
        df.withColumn("_bin", F.date_trunc(bin, series.order))
        .join(plan, [*keys, "_bin"])
        .select(*df.columns, F.inline("_targets"))
    )
    return fn(cut, series.within("_block")).where("NOT _run_up").drop("_run_up", "_block")


# How a running total of each kind continues over the totals of the bins before.
JOINED = {
    "max": F.greatest,
    "min": F.least,
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + b,
    "product": lambda a, b: F.coalesce(a, F.lit(1)) * b,
    "last": lambda a, b: F.coalesce(b, a),
}
TOTAL = {
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "product": F.product,
}


def running_in_bins(
    df: DataFrame,
    series: Series,
    bin: str = "day",
    order: tuple[str, ...] = (),
    **totals: tuple[str, str],
) -> DataFrame:
    """Running totals per series: name=(kind, column) with kind max, min, sum, product, last
    (the last non-NULL value so far) or low (the least that the running sum has been before a row so far, 0 before the
    first). `order` replaces the series' order where dates repeat."""
    order = order or (series.order,)
    keys = list(series.keys)
    df = df.withColumn("_bin", _bin_of(df, series, bin))
    inside = (
        Window.partitionBy(*keys, "_bin")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)

    def total(kind: str, c: str) -> Column:
        if kind == "last":
            return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))
        return TOTAL[kind](c)

    def over(kind: str, c: str, w) -> Column:
        return F.last(c, ignorenulls=True).over(w) if kind == "last" else TOTAL[kind](c).over(w)

    # A low is the least of the sums so far; over the bins it goes on from the sum that each begins with. Rows without a
    # date come first and drop out: they count in sums, but no low is theirs.
    lows = {n: c for n, (k, c) in totals.items() if k == "low"}
    if lows:
        df = df.withColumns({f"_w_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) - F.coalesce(c, F.lit(0)) for n, c in lows.items()})
    sums = {f"_s_{n}": ("sum", c) for n, c in lows.items()}
    in_bin = {**{n: ("min", f"_w_{n}") if k == "low" else (k, c) for n, (k, c) in totals.items()}, **sums}
    per_bin = df.groupBy(*keys, "_bin").agg(*(total(k, c).alias(n) for n, (k, c) in in_bin.items()))
    if lows:
        start = {n: F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)) for n in lows}
        per_bin = per_bin.withColumns({f"_b_{n}": c for n, c in start.items()}).withColumns({n: F.when(F.col("_bin").isNotNull(), F.col(n) + F.col(f"_b_{n}")) for n in lows})
    carry = per_bin.select(
        *keys, "_bin", *(f"_b_{n}" for n in lows),
        *(over(in_bin[n][0], n, before).alias(f"_c_{n}") for n in totals),
    )
    local = df.withColumns({f"_l_{n}": over(*in_bin[n], inside) for n in totals})
    out = {
        n: F.least(f"_c_{n}", F.col(f"_b_{n}") + F.col(f"_l_{n}")) if k == "low"
        else JOINED[k](F.col(f"_c_{n}"), F.col(f"_l_{n}"))
        for n, (k, _) in totals.items()
    }
    drop = ["_bin", *(f"_{p}_{n}" for n in totals for p in "cl"), *(f"_{p}_{n}" for n in lows for p in "wb")]
    return local.join(carry, [*keys, "_bin"]).withColumns(out).drop(*drop)


def underwater(df: DataFrame, series: Series, value: str = "close", bin: str = "day", order: tuple[str, ...] = ()) -> DataFrame:
    """keys, max_drawdown, duration: the deepest relative fall of `value` below its peak so far, and the most
    consecutive rows below it. Rows without a value do not count; a series never below its peak has 0 rows.

    Each bin has a summary (its fall, its rows, those before its first peak, the longest stretch after one), and the
    summaries of a series are joined in order, so that no task holds a series.
    """
    order = order or (series.order,)
    keys = list(series.keys)
    known = df.where(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, series.order, *order, value]))
    rows = running_in_bins(known, series, bin, order, _peak=("max", value)).withColumn("_bin", F.date_trunc(bin, series.order))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order)
    at_peak = F.when(F.col(value) >= F.col("_peak"), F.col("_row"))
    rows = rows.withColumn("_row", F.row_number().over(inside))
    rows = rows.withColumn("_top", F.max(at_peak).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    per_bin = rows.groupBy(*keys, "_bin").agg(
        F.min(F.try_divide(F.col(value) - F.col("_peak"), "_peak")).alias("_fall"),
        F.count("*").alias("_rows"),
        F.max(F.when(F.col("_top").isNull(), F.col("_row"))).alias("_head"),
        F.max(F.col("_row") - F.col("_top")).alias("_longest"),
        F.max("_top").alias("_last"),
    )
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    summed = per_bin.withColumn("_done", F.coalesce(F.sum("_rows").over(before), zero))
    summed = summed.withColumn("_since", F.last(F.col("_done") + F.col("_last"), ignorenulls=True).over(before))
    joined = F.col("_done") - F.coalesce("_since", zero) + F.col("_head")
    run = F.greatest(F.coalesce("_longest", zero), F.coalesce(joined, zero))
    return summed.groupBy(*keys).agg(F.min("_fall").alias("max_drawdown"), F.max(run).cast("bigint").alias("duration"))
