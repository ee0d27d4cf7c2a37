"""Ledger with ATR stops, trailing stops and a circuit breaker.

Here every bar can change the state (stop level, previous equity), so the bars of a series are
folded in order by a grouped function. It reads the group as a stream of batches and keeps a
dozen numbers between them: memory does not grow with the length of a series. Spark partitions,
sorts and feeds the groups; the function is the state machine only.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from types import SimpleNamespace

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import kelly_fraction
from barloom.functions.series import Series, drop_helpers
from barloom.operators.indicators import with_atr
from barloom.operators.ledger import TRADE, Rules, with_trade_signal

# The fold travels to the executors whole, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class StopRules:
    atr_window: int = 14
    atr_multiplier: float = 2.0
    trailing: bool = True
    circuit_breaker: bool = False
    circuit_breaker_pct: float = -0.03
    # The ATR of a bar already contains its close. 1 uses the previous bar's instead.
    atr_lag: int = 0
    # While tripped, the breaker compares with the equity before the drop. True moves on daily.
    breaker_resets: bool = False


@dataclass
class Book:
    """One series: cash, shares, the live stop, and the trades not yet handed over."""

    rules: SimpleNamespace  # the fields of Rules and StopRules, and the `share` to invest
    stops: SimpleNamespace
    cash: float = 0.0
    shares: float = 0.0
    stop: float | None = None
    extreme: float = 0.0
    stop_side: int = 0
    prev_equity: float = 0.0
    seq: int = 0
    out: list = field(default_factory=list)

    def size(self, price: float) -> float:
        r, cash = self.rules, self.cash
        if price <= 0 or cash <= 0:
            return 0
        if r.method == "fixed_shares":
            qty = math.floor(cash / price) if r.shares * price > cash else r.shares
        else:
            qty = math.floor(cash * r.share / price)
        return 1 if qty == 0 and price <= cash else qty

    def order(self, date, side: int, qty: float, raw: float, action: str) -> None:
        """Fill what the cash allows; sells of held shares always fill."""
        r = self.rules
        price = raw * (1 + side * r.slippage)
        need = {"SELL": 0.0, "SHORT": qty * price}.get(action, qty * price * (1 + r.commission))
        if need > self.cash:
            qty = math.floor(self.cash / (price * (1 + r.commission)))
        if qty <= 0:
            return
        notional = qty * price
        fee = notional * r.commission
        self.cash += -side * notional - fee
        self.shares += side * qty
        self.out.append(
            (date, self.seq, action, qty, price, fee, abs(price - raw) * qty, self.cash, self.shares)
        )
        self.seq += 1

    def close_position(self, date, raw: float) -> None:
        if self.shares > 0:
            self.order(date, -1, self.shares, raw, "SELL")
        else:
            self.order(date, 1, -self.shares, raw, "COVER")
        self.stop = None

    def stop_hit(self, raw: float, atr: float) -> bool:
        side = self.stop_side
        if self.stops.trailing and (raw - self.extreme) * side > 0:
            self.extreme = raw
            level = raw - side * self.stops.atr_multiplier * atr
            if (level - self.stop) * side > 0:
                self.stop = level
        return (raw - self.stop) * side <= 0

    def open_position(self, date, side: int, raw: float, atr: float) -> None:
        qty = self.size(raw)
        if qty <= 0:
            return
        # Still short after a part-filled cover: a buy then covers.
        covering = side > 0 and self.shares < 0
        action = "COVER" if covering else ("BUY" if side > 0 else "SHORT")
        self.order(date, side, min(qty, -self.shares) if covering else qty, raw, action)
        if atr > 0:
            self.stop, self.extreme, self.stop_side = (
                raw - side * self.stops.atr_multiplier * atr, raw, side,
            )

    def halted(self, raw: float) -> bool:
        if not self.stops.circuit_breaker or self.prev_equity <= 0:
            return False
        change = (self.cash + self.shares * raw - self.prev_equity) / self.prev_equity
        return change <= self.stops.circuit_breaker_pct

    def bar(self, date, raw: float, close: float, signal: int, atr: float) -> None:
        if self.halted(raw):
            if self.stops.breaker_resets:
                self.prev_equity = self.cash + self.shares * close
            return
        stopped = self.stop is not None and self.shares != 0 and self.stop_hit(raw, atr)
        if stopped:
            self.close_position(date, raw)
        elif signal > 0 and self.shares <= 0:
            if self.shares < 0:
                self.close_position(date, raw)
            self.open_position(date, 1, raw, atr)
        elif signal < 0 and self.shares >= 0:
            if self.shares > 0:
                self.close_position(date, raw)
            if self.rules.allow_short and self.shares == 0:
                self.open_position(date, -1, raw, atr)
        self.prev_equity = self.cash + self.shares * close


def trades_with_stops(
    signals: DataFrame,
    series: Series,
    rules: Rules = Rules(),
    stops: StopRules = StopRules(),
) -> DataFrame:
    """Trade list in the shape of `ledger.trades`. Signals need high, low, open and close."""
    keys, order = list(series.keys), series.order
    df = drop_helpers(with_atr(signals, series, stops.atr_window, out="_atr_now"))
    atr = F.lag("_atr_now", stops.atr_lag).over(series.w) if stops.atr_lag else F.col("_atr_now")
    df = with_trade_signal(df, series).select(
        *keys, order, "open", "close", "trade_signal",
        # No stop without an ATR: 0 says so, and keeps NULL out of the Python side.
        F.coalesce(atr, F.lit(0.0)).alias("atr"),
    )
    names = [f.split()[0] for f in TRADE.split(", ")]
    kelly = kelly_fraction(rules.win_rate, rules.avg_win, rules.avg_loss)
    share = kelly if rules.method == "kelly" else rules.allocation
    plain_rules = SimpleNamespace(**asdict(rules), share=share)
    plain_stops = SimpleNamespace(**asdict(stops))
    capital = rules.initial_capital

    def fold(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Book(plain_rules, plain_stops, cash=capital, prev_equity=capital)
        for pdf in batches:
            columns = (pdf[c].tolist() for c in (order, "open", "close", "trade_signal", "atr"))
            for row in zip(*columns):
                book.bar(*row)
            if book.out:
                found = pd.DataFrame(book.out, columns=names)
                for i, k in enumerate(keys):
                    found.insert(i, k, key[i])
                book.out = []
                yield found

    date_type = signals.schema[order].dataType.simpleString()
    key_ddl = ", ".join(f"{k} {signals.schema[k].dataType.simpleString()}" for k in keys)
    # Sorted by key and date: the grouped function asks for order by key only, which this
    # satisfies, so the dates arrive in order.
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, order)
    return ordered.groupBy(*keys).applyInPandas(
        fold, f"{key_ddl}, {TRADE.format(date=date_type)}"
    )
