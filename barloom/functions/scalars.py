"""Row-level expressions: costs, sizing, calendar, formatting, ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.series import col

TRADING_DAYS = 252


# -- arithmetic --------------------------------------------------------------------------------
def safe_division(a, b, default: float = 0.0) -> Column:
    return F.when(col(b) == 0, F.lit(default)).otherwise(F.try_divide(col(a), col(b)))


def annualised_return(ret, periods: int = TRADING_DAYS) -> Column:
    """Aggregate: geometric mean return per year; 0 for no rows."""
    n = F.count(col(ret))
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.pow(F.product(1 + col(ret)), F.try_divide(F.lit(float(periods)), n)) - 1
    )


# -- transaction costs ---------------------------------------------------------------------------
def execution_price(price, action, slippage: float) -> Column:
    p = col(price)
    return (
        F.when(col(action) == "BUY", p * (1 + slippage))
        .when(col(action) == "SELL", p * (1 - slippage))
        .otherwise(p)
    )


def commission(notional, rate: float) -> Column:
    return col(notional) * rate


def slippage_cost(executed, raw, quantity) -> Column:
    return F.abs(col(executed) - col(raw)) * col(quantity)


# -- position sizing: whole shares as DOUBLE -----------------------------------------------------
def whole(x: Column) -> Column:
    return F.floor(x).cast("double")


def size_fixed_capital(price, cash, allocation: float = 0.10) -> Column:
    return whole(F.try_divide(col(cash) * allocation, col(price)))


def size_fixed_shares(price, cash, shares: float = 100) -> Column:
    return F.when(
        col(price) * shares > col(cash), whole(F.try_divide(col(cash), col(price)))
    ).otherwise(F.lit(float(shares)))


def kelly_fraction(win_rate: float, avg_win: float, avg_loss: float) -> float:
    """Half of the Kelly stake, at most a quarter of the cash; 5% before halving if undefined."""
    full = 0.05 if 0 in (avg_win, avg_loss) else win_rate / avg_loss - (1 - win_rate) / avg_win
    return max(0.0, min(full / 2, 0.25))


def size_kelly(price, cash, win_rate=0.5, avg_win=0.02, avg_loss=0.02) -> Column:
    return size_fixed_capital(price, cash, kelly_fraction(win_rate, avg_win, avg_loss))


SIZING = {
    "fixed_capital": (size_fixed_capital, ("allocation",)),
    "fixed_shares": (size_fixed_shares, ("shares",)),
    "kelly": (size_kelly, ("win_rate", "avg_win", "avg_loss")),
}


def position_size(price, cash, method: str = "fixed_capital", **params) -> Column:
    """Shares to trade: 0 without price or cash, else the method's size, but 1 share where the
    method gives none and the cash still buys one."""
    size, names = SIZING.get(method, SIZING["fixed_capital"])
    qty = size(price, cash, **{k: v for k, v in params.items() if k in names})
    return (
        F.when((col(price) <= 0) | (col(cash) <= 0), F.lit(0.0))
        .when((qty == 0) & (col(price) <= col(cash)), F.lit(1.0))
        .otherwise(qty)
    )


# -- calendar --------------------------------------------------------------------------------------
def business_days(start, end) -> Column:
    """Mondays to Fridays from start to end, both included; 0 when reversed."""

    def weekdays_through(days: Column) -> Column:
        return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)) + 1, F.lit(5))

    monday = F.to_date(F.lit("1970-01-05"))
    first, last = F.date_diff(col(start), monday), F.date_diff(col(end), monday)
    count = weekdays_through(last) - weekdays_through(first - 1)
    return F.when(last < first, F.lit(0)).otherwise(count).cast("bigint")


# -- text ----------------------------------------------------------------------------------------
def percent_text(value, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f%%", col(value) * 100)


def currency_text(value, symbol: str = "$", decimals: int = 2) -> Column:
    return F.concat(F.lit(symbol), F.format_number(col(value), decimals))


# -- ratings ---------------------------------------------------------------------------------------
def rate_ulcer(c) -> Column:
    return F.when(col(c) < 5, "excellent").when(col(c) < 15, "moderate").otherwise("high stress")


def rate_omega(c) -> Column:
    return F.when(col(c) > 3, "excellent").when(col(c) > 1.5, "good").otherwise("weak")


def rate_tail(c) -> Column:
    return F.when(col(c) > 1, "right-skewed").otherwise("left-skewed")


def rate_stress_drawdown(pct) -> Column:
    return F.when(col(pct) > -15, "green").when(col(pct) > -30, "yellow").otherwise("red")
