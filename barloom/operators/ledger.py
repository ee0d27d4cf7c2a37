"""Signals to trades to equity, for every series of the input in one job.

Only rows that can change a position reach the fold. Between two rows with opposite non-zero
signals the position is set by the first fill; a fill that fails for lack of cash can succeed
later in the same stretch only at a lower price, because the cash has not moved. So the rows
that matter are the turns and the new lows of the open within a stretch, and the array folded per
series is about as long as its trade list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import commission, position_size, slippage_cost, whole
from barloom.functions.series import Series, dealt

# Trades that a fold keeps loose; that many are put away together, so that adding one copies few.
LOOSE = 256
# Rows of equity curves that one task is given where their number is known.
CURVE_ROWS = 1_000_000

TRADE = (
    "date {date}, seq int, action string, quantity double, price double, commission double, "
    "slippage double, cash double, shares double"
)


@dataclass(frozen=True)
class Rules:
    """Capital, costs, sizing and shorting of a run.

    `cost_inclusive` sizes the order so that price and commission fit the allocation, has no
    one-share fallback and lets a cover overdraw the cash.
    """

    initial_capital: float = 10_000.0
    commission: float = 0.001
    slippage: float = 0.0005
    allow_short: bool = False
    cost_inclusive: bool = False
    method: str = "fixed_capital"
    allocation: float = 0.95
    shares: float = 100
    win_rate: float = 0.5
    avg_win: float = 0.02
    avg_loss: float = 0.02

    @property
    def sizing(self) -> dict:
        names = ("method", "allocation", "shares", "win_rate", "avg_win", "avg_loss")
        return {n: getattr(self, n) for n in names}


def with_trade_signal(signals: DataFrame, series: Series) -> DataFrame:
    """The previous bar's signal: what is known at this bar's open."""
    if "signal" not in signals.columns:
        raise ValueError("the bars need a 'signal' column")
    return signals.withColumn(
        "trade_signal", F.coalesce(F.lag("signal", 1, 0).over(series.w), F.lit(0)).cast("int")
    )


def decisive_rows(signals: DataFrame, series: Series) -> DataFrame:
    """Rows at which a position can change: turns of the signal and, within a stretch of equal
    signals, new lows of the open."""
    # Keys are never NULL. Saying so here keeps the plans of all readers of the trades alike: joins
    # on the keys would add it to some of them, and unlike plans are not reused.
    keyed = signals.where(" AND ".join(f"{k} IS NOT NULL" for k in series.keys))
    df = with_trade_signal(keyed, series).where("trade_signal <> 0")
    turn = F.coalesce(F.lag("trade_signal").over(series.w) != F.col("trade_signal"), F.lit(True))
    df = df.select(*series.keys, series.order, "open", "trade_signal", turn.alias("turn"))
    df = df.withColumn("stretch", F.count_if("turn").over(series.upto))
    earlier = (
        Window.partitionBy(*series.keys, "stretch")
        .orderBy(series.order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    low = F.min(F.when(F.col("open") > 0, F.col("open"))).over(earlier)
    new_low = (F.col("open") > 0) & (low.isNull() | (F.col("open") < low))
    return (
        df.withColumn("new_low", new_low)
        .where("turn OR new_low")
        .select(*series.keys, series.order, "open", "trade_signal")
        # The rows are few, and more than one result is usually made from the trades: an exchange
        # here is what Spark reuses, so the signals are computed once.
        .repartition(*series.keys, series.order)
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.transform(F.array(value), body)[0]


def _fill(rules: Rules, state: Column, row: Column, opening: bool, date_type: str) -> Column:
    """State after one order at this row's open: the closing of the opposite position, or the
    opening of a new one."""
    side, raw = row["trade_signal"].cast("double"), row["open"]
    cash, held = state["cash"], state["shares"]
    executed = raw * (1 + rules.slippage * side)
    per_share = executed * (1 + rules.commission)
    affordable = whole(F.try_divide(cash, per_share))

    if opening:
        wanted_when = (held == 0) & ((side > 0) | F.lit(rules.allow_short))
        if rules.cost_inclusive:
            size = F.when(raw > 0, whole(F.try_divide(cash * rules.allocation, per_share)))
        else:
            size = position_size(raw, cash, **rules.sizing)
        wanted = F.when(wanted_when, size)
    else:
        wanted = F.when(held * side < 0, F.abs(held))

    def capped(q: Column) -> Column:
        if rules.cost_inclusive:
            return q
        notional = q * executed
        buy_short_of_cash = (side > 0) & (notional + commission(notional, rules.commission) > cash)
        if not opening:
            return F.when(buy_short_of_cash, affordable).otherwise(q)
        margin_short = (side < 0) & (notional > cash)
        return F.when(buy_short_of_cash | margin_short, affordable).otherwise(q)

    if opening:
        action = F.when(side > 0, "BUY").otherwise("SHORT")
    else:
        action = F.when(side > 0, "COVER").otherwise("SELL")

    def settle(q: Column) -> Column:
        notional = q * executed
        fee = commission(notional, rules.commission)
        cash_after = cash - side * notional - fee
        shares_after = held + side * q
        trade = F.struct(
            row["date"].alias("date"),
            state["n"].alias("seq"),
            action.alias("action"),
            q.alias("quantity"),
            executed.alias("price"),
            fee.alias("commission"),
            slippage_cost(executed, raw, q).alias("slippage"),
            cash_after.alias("cash"),
            shares_after.alias("shares"),
        ).cast(f"struct<{_ddl(date_type)}>")
        done = F.struct(
            cash_after.alias("cash"),
            shares_after.alias("shares"),
            (state["n"] + 1).alias("n"),
            F.concat(state["new"], F.array(trade)).alias("new"),
        )
        return F.when(q > 0, done).otherwise(state)

    return _let(_let(F.coalesce(wanted, F.lit(0.0)), capped), settle)


def _ddl(date_type: str) -> str:
    fields = TRADE.format(date=date_type).split(", ")
    return ",".join(f.replace(" ", ":", 1) for f in fields)


def trades(signals: DataFrame, series: Series, rules: Rules = Rules()) -> DataFrame:
    """Trade list: keys, date, seq (order in the series), action, quantity, price (as
    executed), commission, slippage, and cash and shares after the trade."""
    date_type = signals.schema[series.order].dataType.simpleString()
    rows = F.struct(F.col(series.order).alias("date"), "open", "trade_signal")
    events = F.sort_array(F.collect_list(rows))
    none = F.array().cast(f"array<struct<{_ddl(date_type)}>>")
    start = F.struct(
        F.struct(
            F.lit(float(rules.initial_capital)).alias("cash"),
            F.lit(0.0).alias("shares"),
            F.lit(0).alias("n"),
            none.alias("new"),
        ).alias("state"),
        none.alias("loose"),
        F.array().cast(f"array<array<struct<{_ddl(date_type)}>>>").alias("away"),
    )

    def step(sofar: Column, row: Column) -> Column:
        """`_let` copies what it holds, so it holds the small state only. The trades of a row are put
        with the others a row later."""
        state, loose, full = sofar["state"], sofar["loose"], F.size(sofar["loose"]) >= LOOSE
        fresh = F.struct(*(state[c].alias(c) for c in ("cash", "shares", "n")), none.alias("new"))
        after = _let(fresh, lambda s: _let(
            _fill(rules, s, row, False, date_type),
            lambda closed: _fill(rules, closed, row, True, date_type),
        ))
        return F.struct(
            after.alias("state"),
            F.concat(F.when(full, none).otherwise(loose), state["new"]).alias("loose"),
            F.when(full, F.concat(sofar["away"], F.array(loose))).otherwise(sofar["away"]).alias("away"),
        )

    folded = F.aggregate("events", start, step, lambda s: F.flatten(
        F.concat(s["away"], F.array(s["loose"], s["state"]["new"]))))
    return (
        decisive_rows(signals, series)
        .groupBy(*series.keys)
        .agg(events.alias("events"))
        .select(*series.keys, F.inline(folded))
    )


def equity(
    bars: DataFrame, trade_list: DataFrame, series: Series, initial_capital: float = 10_000.0,
    rows: int | None = None,
) -> DataFrame:
    """Cash, position value and total equity at every bar's close.

    Trades and bars are interleaved on the series key instead of joined on (key, date): one
    shuffle that the metrics downstream keep using. `rows` is the number of bars, where it is known;
    the shuffle then has as many tasks as they need.
    """
    none = F.lit(None).cast("double")
    date = F.col(series.order)
    marks = bars.select(
        *series.keys, date, F.lit(2147483647).alias("_seq"), "close",
        none.alias("_cash"), none.alias("_shares"),
    )
    changes = trade_list.select(
        *series.keys, F.col("date").alias(series.order), F.col("seq").alias("_seq"),
        none.alias("close"), F.col("cash").alias("_cash"), F.col("shares").alias("_shares"),
    )
    upto = (
        Window.partitionBy(*series.keys)
        .orderBy(series.order, "_seq")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    start = F.lit(float(initial_capital))
    both = marks.unionByName(changes)
    if rows is not None:
        both = dealt(both, rows, *series.keys, per_task=CURVE_ROWS)
    return (
        both
        .withColumns(
            {
                "cash": F.coalesce(F.last("_cash", True).over(upto), start),
                "shares": F.coalesce(F.last("_shares", True).over(upto), F.lit(0.0)),
            }
        )
        .where(F.col("_seq") == 2147483647)
        .withColumn("positions_value", F.col("shares") * F.col("close"))
        .withColumn("total_equity", F.col("cash") + F.col("positions_value"))
        .select(*series.keys, date, "close", "cash", "shares", "positions_value", "total_equity")
    )


def run_summary(curve: DataFrame, trade_list: DataFrame, series: Series) -> DataFrame:
    """Start and end equity, total return and number of trades per series; without a trade, 0."""
    ends = curve.groupBy(*series.keys).agg(
        F.min_by("total_equity", series.order).alias("start_equity"),
        F.max_by("total_equity", series.order).alias("end_equity"),
    )
    counts = trade_list.groupBy(*series.keys).agg(F.count("*").alias("num_trades"))
    return ends.join(counts, list(series.keys), "left").select(
        *series.keys,
        "start_equity",
        "end_equity",
        (F.try_divide("end_equity", "start_equity") - 1).alias("total_return"),
        F.coalesce("num_trades", F.lit(0)).alias("num_trades"),
    )
