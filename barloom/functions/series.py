"""Window expressions over one bar series.

A series is the set of rows sharing `keys`, ordered by `order`. A series of DATE bars is
bounded by the calendar (unique per key and date, so at most 366 rows a year), which is what
makes one window partition per series safe however many rows the whole table holds. Finer
bars have no such bound: run those through `barloom.operators.blocks.in_blocks`.

Warm-up is NULL, never NaN, because Spark orders NaN above every number.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# e^-40 is below double rounding, so one carry from the previous block is all a decayed
# average needs.
DECAY_NEGLIGIBLE = 40.0
DEFAULT_EWM_BLOCK = 512
MAX_WEIGHT_LOG10 = 280.0
# Frames of this many rows are put together from pieces, but of no more than PIECES.
WIDE = 32
PIECES = 64
# Rows of whole series that one task is given. A sort of them takes about one page of memory, and a chain of
# indicators has a dozen sorts.
ROWS_PER_TASK = 200_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Series:
    def __init__(self, *keys: str, order: str = "date"):
        self.keys = keys or ("ticker",)
        self.order = order

    def within(self, *extra: str) -> Series:
        """The same series split further by more key columns."""
        return Series(*extra, *self.keys, order=self.order)

    # -- frames ---------------------------------------------------------------------------
    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    @property
    def upto(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def last_n(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), 0)

    def before(self, n: int) -> WindowSpec:
        """Everything up to the row `n` rows back."""
        return self.w.rowsBetween(Window.unboundedPreceding, -n)

    # -- shifts ---------------------------------------------------------------------------
    def position(self) -> Column:
        """0-based row number in the series."""
        return F.row_number().over(self.w) - 1

    def lag(self, c, n: int = 1, default=None) -> Column:
        return F.lag(col(c), n, default).over(self.w)

    def diff(self, c) -> Column:
        return col(c) - self.lag(c)

    def pct_change(self, c, n: int = 1) -> Column:
        return F.try_divide(col(c), self.lag(c, n)) - 1

    # -- rolling: NULL until `n` observations are present ------------------------------------
    def _full(self, c, n: int) -> Column:
        seen = F.count(col(c)).over(self.upto) - F.count(col(c)).over(self.before(n))
        return seen == n

    def _pieces(self, value: Callable[[WindowSpec], Column], n: int) -> list[tuple[int, Column]]:
        """Sizes and values of the pieces that make up the last `n` rows, the latest first.

        A piece is worked out once per row, over about the root of `n` rows, and fetched from earlier rows for the others. So a
        frame costs twice the root of `n`, nothing is ever taken off, and a NaN leaves with its row.
        """
        size = max(math.isqrt(n), -(-n // PIECES)) if n >= WIDE else n
        whole, rest = divmod(n, size)
        last = [(size, value(self.last_n(size)))] * whole + ([(rest, value(self.last_n(rest)))] if rest else [])
        return [(k, F.lag(v, i * size).over(self.w) if i else v) for i, (k, v) in enumerate(last)]

    def _sum(self, c, n: int) -> Column:
        return reduce(add, (v for _, v in self._pieces(F.sum(col(c)).over, n)))

    def mean(self, c, n: int) -> Column:
        return F.when(self._full(c, n), self._sum(c, n) / n)

    def std(self, c, n: int) -> Column:
        if n < WIDE:
            return F.when(self._full(c, n), F.stddev_samp(col(c)).over(self.last_n(n)))
        # Squares about each piece's own mean, and of the means about that of all: no squares of whole values are taken off.
        mean = self._sum(c, n) / n
        means, spreads = (self._pieces(f(col(c)).over, n) for f in (F.avg, F.var_pop))
        squares = (k * (spread + F.pow(m - mean, 2)) for (k, m), (_, spread) in zip(means, spreads, strict=True))
        return F.when(self._full(c, n), F.sqrt(reduce(add, squares) / (n - 1)))

    def slope_pct(self, c, n: int, x) -> Column:
        """Least-squares slope per row as % of the window mean; 0 where the mean is 0."""
        # The places in a full window are known, so two sums give the fit: far cheaper per frame
        # than a regression aggregate. `x` is the row number in the series.
        total, weighted = self._sum(c, n), self._sum(col(c) * col(x), n)
        slope = (weighted - (col(x) - (n - 1) / 2) * total) / (n * (n * n - 1) / 12)
        pct = F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(slope * n, total) * 100)
        return F.when(self._full(c, n), pct)

    def rolling_max(self, c, n: int) -> Column:
        """Rolling maximum from the first row on (no warm-up)."""
        if n < WIDE:
            return F.max(col(c)).over(self.last_n(n))
        # Pieces may overlap here, so all have one size; those before the first row are NULL and do not count.
        size = max(math.isqrt(n), -(-n // PIECES))
        piece = F.max(col(c)).over(self.last_n(size))
        back = [*range(size, n - size, size), n - size]
        return F.greatest(piece, *(F.lag(piece, k).over(self.w) for k in back))

    # -- cumulative ---------------------------------------------------------------------------
    def running_max(self, c) -> Column:
        return F.max(col(c)).over(self.upto)

    def drawdown(self, c) -> Column:
        """Fraction below the running peak (0 or negative)."""
        peak = self.running_max(c)
        return F.try_divide(col(c) - peak, peak)

    def cumprod(self, c) -> Column:
        return F.product(col(c)).over(self.upto)

    def ffill(self, c) -> Column:
        return F.last(col(c), ignorenulls=True).over(self.upto)

    def first_known(self, c) -> Column:
        """The first value of the whole series that is not NULL, worked out once per series."""
        return F.first(col(c), ignorenulls=True).over(
            self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )


@dataclass(frozen=True)
class Ewm:
    """Exponential average of `c`: y0 = x0, y = alpha*x + (1-alpha)*y_prev."""

    c: str
    alpha: float
    min_periods: int = 0
    leading_nulls: bool = False  # the average then starts at the first non-NULL value

    @staticmethod
    def span(c: str, span: int) -> Ewm:
        return Ewm(c, 2.0 / (span + 1))

    @staticmethod
    def wilder(c: str, n: int, warm_up: bool = True) -> Ewm:
        return Ewm(c, 1.0 / n, n if warm_up else 0)

    @property
    def memory(self) -> int:
        """Rows after which an old value no longer shows in a double."""
        return 1 if self.alpha >= 1 else math.ceil(DECAY_NEGLIGIBLE / -math.log1p(-self.alpha))


def ewm_block(specs: list[Ewm]) -> int | None:
    """Rows of a block that serve all these rates; None if they are too far apart to share one.

    A block holds the memory of the slowest, and the weights of the steepest must stay in the range
    of a double over it. One rate alone always has a block.
    """
    need = max(s.memory for s in specs)
    steepest = max((-math.log10(1 - s.alpha) for s in specs if s.alpha < 1), default=0.0)
    for block in (max(need, DEFAULT_EWM_BLOCK), need):
        if block * steepest <= MAX_WEIGHT_LOG10:
            return block
    return None


def ewm_groups(specs: dict[str, Ewm]) -> list[dict[str, Ewm]]:
    """The averages in as few groups as their rates allow, each of which shares a block."""
    groups: list[dict[str, Ewm]] = []
    for name, spec in sorted(specs.items(), key=lambda s: s[1].memory):
        if groups and ewm_block([*groups[-1].values(), spec]) is not None:
            groups[-1][name] = spec
        else:
            groups.append({name: spec})
    return groups


def dealt(df: DataFrame, rows: int, *keys: str, per_task: int | None = None) -> DataFrame:
    """The series of a frame of about `rows` rows dealt out to as many tasks as that takes, each about `per_task` rows.

    Adaptive execution goes by the bytes of a shuffle, and up to 64 MB of those are millions of rows, which every sort above
    holds. Where its own number of tasks is enough, the frame is left to it.
    """
    tasks = -(-rows // (per_task or ROWS_PER_TASK))
    if tasks <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(tasks, *keys)


def with_position(df: DataFrame, series: Series) -> DataFrame:
    return df if "_pos" in df.columns else df.withColumn("_pos", series.position())


def with_ewm(df: DataFrame, series: Series, **specs: Ewm) -> DataFrame:
    """Add one exponential average per keyword, without leaving the JVM.

    A NULL input adds nothing, so the average decays towards zero over it; fill gaps before.

    The recurrence is unrolled inside blocks of rows (a running sum of x * q^-k, scaled by q^k,
    with k the place in the block) and the last value of the previous block is carried in.
    Blocks are long enough that the carry before that one is below rounding.
    """
    df = with_position(df, series)
    for group in ewm_groups(specs):
        df = _with_ewm_group(df, series, group)
    return df


def _with_ewm_group(df: DataFrame, series: Series, specs: dict[str, Ewm]) -> DataFrame:
    block = ewm_block(list(specs.values()))
    blk, place = f"_blk{block}", F.col("_pos") % block
    if blk not in df.columns:
        df = df.withColumn(blk, F.floor(F.col("_pos") / block))
    in_block = Window.partitionBy(*series.keys, blk).orderBy(series.order)
    # Ordered by block first, so the sort above serves this window too.
    in_series = Window.partitionBy(*series.keys).orderBy(blk, series.order)
    so_far = in_series.rowsBetween(Window.unboundedPreceding, 0)
    earlier = in_series.rowsBetween(Window.unboundedPreceding, -1)

    started = {n: F.count(s.c).over(so_far) for n, s in specs.items() if s.leading_nulls}
    if started:
        df = df.withColumns({f"_n_{n}": c for n, c in started.items()})

    local = {}
    for name, s in specs.items():
        q = 1.0 - s.alpha
        first = (F.col(f"_n_{name}") == 1) if s.leading_nulls else (F.col("_pos") == 0)
        x = F.when(first, F.col(s.c)).otherwise(F.col(s.c) * s.alpha)
        weighted = F.sum(x * F.pow(F.lit(q), -place)).over(in_block)
        local[f"_loc_{name}"] = weighted * F.pow(F.lit(q), place) if q > 0 else x
    df = df.withColumns(local)

    carry = {
        f"_car_{name}": F.last(
            F.when(place == block - 1, F.col(f"_loc_{name}")), ignorenulls=True
        ).over(earlier)
        for name in specs
    }
    df = df.withColumns(carry)

    out = {}
    for name, s in specs.items():
        q = 1.0 - s.alpha
        y = F.coalesce(F.col(f"_loc_{name}"), F.lit(0.0)) + F.pow(F.lit(q), place + 1) * F.coalesce(
            F.col(f"_car_{name}"), F.lit(0.0)
        )
        ready = F.col("_pos") + 1 >= s.min_periods
        if s.leading_nulls:
            ready = ready & (F.col(f"_n_{name}") > 0)
        out[name] = F.when(ready, y)
    return df.withColumns(out).drop(*local, *carry, *(f"_n_{n}" for n in started))


def with_ewm_of(df: DataFrame, series: Series, alpha: str, **inputs: str) -> DataFrame:
    """One exponential average per keyword of the named input, with the rate in column `alpha`, alike on all rows of a series.

    The plan has one size however many rates there are: each series gets a block that suits its own. Inputs are not NULL.
    """
    df = with_position(df, series)
    q = 1 - F.col(alpha)
    memory = F.when(q <= 0, 1).otherwise(F.ceil(-DECAY_NEGLIGIBLE / F.log(F.greatest(q, F.lit(1e-300)))))
    df = df.withColumns({"_q": q, "_block": memory}).withColumns({"_at": F.col("_pos") % F.col("_block"), "_nth": F.floor(F.col("_pos") / F.col("_block"))})
    in_series = Window.partitionBy(*series.keys).orderBy("_nth", series.order)
    in_block = Window.partitionBy(*series.keys, "_nth").orderBy(series.order)
    ended = F.col("_at") == F.col("_block") - 1
    local = {}
    for name, c in inputs.items():
        x = F.when(F.col("_pos") == 0, F.col(c)).otherwise(F.col(c) * F.col(alpha))
        local[f"_loc_{name}"] = F.sum(x * F.pow("_q", -F.col("_at"))).over(in_block) * F.pow("_q", F.col("_at"))
    df = df.withColumns(local)
    before = in_series.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_car_{n}": F.last(F.when(ended, F.col(f"_loc_{n}")), ignorenulls=True).over(before) for n in inputs})
    out = {n: F.col(f"_loc_{n}") + F.pow("_q", F.col("_at") + 1) * F.coalesce(f"_car_{n}", F.lit(0.0)) for n in inputs}
    return df.withColumns(out).drop("_q", "_block", "_at", "_nth", *local, *(f"_car_{n}" for n in inputs))


# Columns left on a frame while indicators are being added, so that the next one can use them:
# the position, block numbers, and shared indicators.
HELPERS = ("_pos", "_blk", "_ind_")


def helper_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(HELPERS)]


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*helper_columns(df))
