"""One query per operator, over the whole sample tables. Doubles are rounded at the end only."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import scalars as X
from barloom.functions.series import Series, drop_helpers
from barloom.operators import blocks, clean, indicators, ledger, metrics, signals, stops
from barloom.operators.ledger import Rules
from barloom.operators.signals import STRATEGIES
from barloom.operators.stops import StopRules
from barloom.plans import bootstrap, experiments, views
from barloom.sources import bars as B
from barloom.sources import sample_bars as D
from barloom.sources import store
from barloom.sources.sample_bars import TICKER

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Parameters shared with the SQL side.
RSI_GRID = {"window": [7, 14, 21], "overbought": [65, 75], "oversold": [25, 40]}
BAD_GRID = {"short_window": [0, 5], "long_window": [-3, 12, 1_000_000]}
GRID = {"short_window": [5, 10, 20], "long_window": [20, 50]}
SHORT_SMA = {"short_window": 5, "long_window": 20}
FAST_MOMENTUM = {"momentum_window": 60, "trend_ma": 50, "entry_rsi": 45}
SIMS, HORIZON, SEED = 1000, 252, 7


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def sma(spark, d, **params) -> DataFrame:
    return signals.sma_crossover(D.walk_bars(spark, d), TICKER, **(params or SHORT_SMA))


def long_run(spark, d, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    bars = D.walk_bars(spark, d)
    signals = STRATEGIES["SMA Crossover"].signals(bars, TICKER, **SHORT_SMA)
    return experiments.backtest(signals, TICKER, rules, marks=bars)


# -- bars and storage --------------------------------------------------------------------------------
@query
def bars_resample(spark, d):
    # One division per price: the same double everywhere, so nothing to round.
    return D.raw_bars(spark, d)


@query
def bars_walk(spark, d):
    return rounded(D.walk_bars(spark, d), open=6, high=6, low=6, close=6, adj_close=6)


@query
def bars_normalise(spark, d):
    lines = D.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("Ticker"),
        F.col("l_shipdate").alias("Date"),
        F.col("l_extendedprice").alias("Open|X"),
        (F.col("l_extendedprice") * 2).alias("High|X"),
        F.col("l_quantity").alias("Low|X"),
        F.when(F.col("l_linenumber") == 1, F.lit(float("nan")))
        .otherwise(F.col("l_extendedprice"))
        .alias("Close|X"),
        F.col("l_linenumber").alias("Volume|X"),
    )
    return B.normalise(lines)


@query
def bars_range_scan(spark, d):
    return B.scan(
        D.raw_bars(spark, d), start="1996-01-01", end="1998-12-31",
        columns=["ticker", "date", "close", "volume"],
    )


def _store(spark, d, name: str) -> store.BarStore:
    """An empty store of that name under the session's warehouse, one for each folder of tables."""
    made = store.BarStore(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/{name}_{zlib.crc32(d.encode())}")
    made.clear()
    return made


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("date"))


@query
def store_range_scan(spark, d):
    made = _store(spark, d, "range_scan")
    made.insert_absent(D.raw_bars(spark, d))
    return _dated(made.load(start="1996-01-01", end="1998-12-31", columns=["ticker", "date", "close", "volume"]))


@query
def store_statistics(spark, d):
    made = _store(spark, d, "statistics")
    made.insert_absent(D.raw_bars(spark, d))
    return made.statistics().select("ticker", "interval", F.col("rows").alias("n_rows"))


@query
def bars_coverage(spark, d):
    df = D.walk_bars(spark, d).select("ticker", "date")
    return B.date_range(df).join(B.row_counts(df), "ticker")


@query
def bars_tickers(spark, d):
    return B.tickers(D.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "ticker"))


def _requests(spark, d) -> DataFrame:
    """Two per customer: some years, and one to three days that often fall between bars."""
    key = F.col("c_custkey")
    days = F.to_date(F.lit("1996-03-01"))
    spans = F.array(
        F.struct(F.date_add(F.to_date(F.lit("1994-06-01")), (key % 5 * 200).cast("int")).alias("start"),
                 F.date_add(F.to_date(F.lit("1998-01-01")), (key % 7 * 500).cast("int")).alias("end")),
        F.struct(days.alias("start"), F.date_add(days, (key % 3).cast("int")).alias("end")),
    )
    return D.table(spark, d, "customer").select(key.cast("string").alias("ticker"), F.inline(spans))


@query
def bars_gaps(spark, d):
    bars = D.daily_moves(spark, d).select(F.col("ticker").cast("string").alias("ticker"), "date")
    return store.missing_ranges(bars, _requests(spark, d))


@query
def bars_interior_gaps(spark, d):
    return store.interior_gaps(D.daily_moves(spark, d).select("ticker", "date"))


def _ingested(spark, d, name: str) -> tuple[store.BarStore, DataFrame]:
    """A store with every other ticker up to the middle of 1996, after all requests were ingested; and what they got."""
    made, bars = _store(spark, d, name), D.raw_bars(spark, d)
    made.insert_absent(bars.where("ticker % 2 = 0 AND date < DATE'1996-07-01'"))
    return made, made.ingest(bars, _requests(spark, d))


@query
def store_ingest_rows(spark, d):
    return _dated(_ingested(spark, d, "ingest_rows")[1]).select("ticker", "date", "open", "high", "low", "close", "volume")


@query
def store_ingest_gaps(spark, d):
    made, _ = _ingested(spark, d, "ingest_gaps")
    return store.missing_ranges(made.load(), _requests(spark, d))


@query
def ingest_failed_tickers(spark, d):
    bars = D.daily_moves(spark, d).select(F.col("ticker").cast("string").alias("ticker"))
    return store.failed_tickers(_requests(spark, d), bars)


def _line_bars(spark, d) -> DataFrame:
    """Every line as a bar, several per ticker and date, numbered in order of arrival."""
    arrival = Window.partitionBy("l_suppkey", "l_shipdate").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    price = F.col("l_extendedprice")
    rows = D.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").alias("date"),
        price.alias("open"), (price * 2).alias("high"), (price / 2).alias("low"),
        price.alias("close"), F.col("l_quantity").alias("volume"),
        F.row_number().over(arrival).cast("bigint").alias("seq"), "l_returnflag",
    )
    return rows


def _stored_and_new(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = _line_bars(spark, d)
    old = store.prepare(rows.where("l_returnflag = 'A'"))
    new = store.prepare(rows.where("l_returnflag <> 'A'"))
    return store.last_per_date(old), new


@query
def bars_insert_first(spark, d):
    old, new = _stored_and_new(spark, d)
    return store.absent_rows(old, new)


@query
def bars_upsert_last(spark, d):
    return store.merged_rows(*_stored_and_new(spark, d))


@query
def store_upsert(spark, d):
    rows, made = _line_bars(spark, d), _store(spark, d, "upsert")
    made.insert_absent(rows.where("l_returnflag = 'A'"))
    made.upsert(rows.where("l_returnflag <> 'A'"))
    return _dated(made.read())


@query
def benchmark_returns(spark, d):
    return rounded(B.returns(D.walk_bars(spark, d), TICKER), ret=8)


@query
def benchmark_equity(spark, d):
    return rounded(B.benchmark_equity(D.walk_bars(spark, d), TICKER), benchmark_equity=4)


@query
def market_benchmark(spark, d):
    return rounded(D.market_returns(spark, d), bench_ret=8)


# -- cleaning -----------------------------------------------------------------------------------------
@query
def clean_bars(spark, d):
    df = clean.clean(D.dirty_bars(spark, d), TICKER)
    return rounded(df, open=6, high=6, low=6, close=6, adj_close=6)


@query
def quality_report(spark, d):
    return clean.quality_report(D.dirty_bars(spark, d), TICKER)


@query
def short_histories(spark, d):
    orders = D.table(spark, d, "orders").select(
        F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date")
    )
    return clean.too_short(orders.distinct(), TICKER).select(
        "ticker", "available", F.col("required").cast("bigint").alias("required")
    )


# -- scalar expressions ---------------------------------------------------------------------------------
@query
def execution_costs(spark, d):
    action = F.when(F.col("l_returnflag") == "A", "BUY").when(
        F.col("l_returnflag") == "R", "SELL"
    ).otherwise("HOLD")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    df = D.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
        action.alias("action"), price.alias("price"),
    )
    executed = X.execution_price("price", "action", 0.0005)
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "action",
        executed.alias("executed"),
        X.commission("l_extendedprice", 0.001).alias("commission"),
        X.slippage_cost(executed, "price", "l_quantity").alias("slippage"),
    )


@query
def position_sizes(spark, d):
    df = D.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_quantity") * 700.0 * F.col("l_linenumber") - 2000.0).alias("cash"),
    )
    size = X.position_size
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        size("price", "cash", "fixed_capital", allocation=0.95).alias("capital95"),
        size("price", "cash").alias("capital10"),
        size("price", "cash", "fixed_shares", shares=20).alias("shares20"),
        size("price", "cash", "kelly", win_rate=0.6, avg_win=3.0, avg_loss=2.0).alias("kelly"),
        size("price", "cash", "kelly", win_rate=0.6, avg_win=0.0).alias("kelly_undefined"),
        size("price", "cash", "no such method", allocation=0.5).alias("unknown"),
    )


@query
def business_days(spark, d):
    end = F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int") - 3)
    return D.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        X.business_days(F.to_date("l_shipdate"), end).alias("days"),
    )


@query
def annualised_returns(spark, d):
    df = D.daily_moves(spark, d).groupBy("ticker").agg(
        X.annualised_return("move").alias("annualised"),
        F.sum("gap").alias("gap"), F.count_if(F.col("gap") > 0.0035).alias("n"),
    )
    df = df.withColumn("gap_per_high", X.safe_division("gap", "n", -1.0)).drop("gap", "n")
    return rounded(df, annualised=8, gap_per_high=8)


@query
def formatted_values(spark, d):
    name = STRATEGIES["SMA Crossover"].name(short_window=20, long_window=50)
    return D.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        X.percent_text("l_discount").alias("discount"),
        X.currency_text("l_extendedprice").alias("price"),
        F.lit(name).alias("strategy"),
    )


# -- indicators -----------------------------------------------------------------------------------------
@query
def moving_averages(spark, d):
    df = D.walk_bars(spark, d).select(
        "ticker", "date",
        TICKER.mean("close", 20).alias("sma20"), TICKER.mean("close", 200).alias("sma200"),
        TICKER.std("close", 20).alias("std20"), TICKER.mean("volume", 20).alias("volume20"),
        TICKER.rolling_max("close", 14).alias("max14"),
        TICKER.pct_change("close").alias("ret"), TICKER.pct_change("close", 252).alias("momentum"),
        TICKER.diff("close").alias("move"), TICKER.cumprod(F.col("volume") * 0.0 + 1.0001).alias("grown"),
    )
    return rounded(
        df, sma20=6, sma200=6, std20=6, volume20=6, max14=6, ret=8, momentum=8, move=6, grown=8
    )


@query
def rsi(spark, d):
    df = drop_helpers(indicators.with_rsi(D.walk_bars(spark, d), TICKER))
    return rounded(df.select("ticker", "date", "rsi"), rsi=6)


@query
def macd(spark, d):
    df = indicators.with_macd(D.walk_bars(spark, d), TICKER)
    df = df.select("ticker", "date", "macd", "macd_signal", "macd_histogram")
    return rounded(df, macd=6, macd_signal=6, macd_histogram=6)


@query
def atr(spark, d):
    df = indicators.with_true_range(D.walk_bars(spark, d), TICKER)
    df = indicators.with_atr(df, TICKER).select("ticker", "date", "true_range", "atr")
    return rounded(df, true_range=6, atr=6)


@query
def adx(spark, d):
    df = indicators.with_adx(D.walk_bars(spark, d), TICKER)
    return rounded(df.select("ticker", "date", "plus_di", "minus_di", "adx"), plus_di=6, minus_di=6, adx=6)


@query
def regimes(spark, d):
    df = views.regime_series(D.walk_bars(spark, d), TICKER)
    return rounded(df, close=6, adx=6, volatility_ann=6, price_slope=6)


@query
def regime_counts(spark, d):
    return indicators.regime_counts(indicators.with_regime(D.walk_bars(spark, d), TICKER))


@query
def regime_strategies(spark, d):
    counts = indicators.regime_counts(indicators.with_regime(D.walk_bars(spark, d), TICKER))
    return counts.join(indicators.compatible_strategies(spark), "regime")


# -- signals ----------------------------------------------------------------------------------------------
@query
def buy_hold_signal(spark, d):
    df = signals.buy_and_hold(D.walk_bars(spark, d), TICKER)
    return df.select("ticker", "date", F.col("signal").cast("bigint").alias("signal"))


@query
def sma_signal(spark, d):
    df = sma(spark, d, short_window=50, long_window=200)
    df = df.select("ticker", "date", "short_ma", "long_ma", F.col("signal").cast("bigint").alias("signal"))
    return rounded(df, short_ma=6, long_ma=6)


@query
def rsi_signal(spark, d):
    df = signals.rsi_reversion(D.walk_bars(spark, d), TICKER)
    return df.select("ticker", "date", F.col("signal").cast("bigint").alias("signal"))


@query
def bollinger_signal(spark, d):
    df = signals.bollinger(D.walk_bars(spark, d), TICKER)
    df = df.select(
        "ticker", "date", "upper_band", "lower_band", F.col("signal").cast("bigint").alias("signal")
    )
    return rounded(df, upper_band=6, lower_band=6)


@query
def macd_signal(spark, d):
    df = signals.macd_cross(D.walk_bars(spark, d), TICKER)
    return df.select("ticker", "date", F.col("signal").cast("bigint").alias("signal"))


@query
def multi_factor_signal(spark, d):
    df = signals.multi_factor(D.walk_bars(spark, d), TICKER, min_score=3)
    return df.select(
        "ticker", "date", F.col("mf_score").cast("bigint").alias("mf_score"),
        F.col("signal").cast("bigint").alias("signal"),
    )


@query
def momentum_mr_signal(spark, d):
    df = signals.momentum_pullback(D.walk_bars(spark, d), TICKER, **FAST_MOMENTUM)
    return df.select("ticker", "date", F.col("signal").cast("bigint").alias("signal"))


# -- ledgers -----------------------------------------------------------------------------------------------
def _trades(df: DataFrame) -> DataFrame:
    df = df.select(
        "ticker", "date", F.col("seq").cast("bigint").alias("seq"), "action", "quantity", "price",
        "commission", "slippage", "cash", "shares",
    )
    return rounded(df, price=4, commission=4, slippage=4, cash=2)


@query
def ledger_long(spark, d):
    return _trades(ledger.trades(sma(spark, d), TICKER))


@query
def ledger_short(spark, d):
    return _trades(ledger.trades(sma(spark, d), TICKER, Rules(allow_short=True)))


@query
def ledger_cost_inclusive(spark, d):
    rules = Rules(allow_short=True, cost_inclusive=True)
    return _trades(ledger.trades(sma(spark, d), TICKER, rules))


@query
def ledger_fixed_shares(spark, d):
    return _trades(ledger.trades(sma(spark, d), TICKER, Rules(method="fixed_shares", shares=50)))


@query
def ledger_kelly(spark, d):
    rules = Rules(method="kelly", win_rate=0.55, avg_win=3.0, avg_loss=2.5, allow_short=True)
    return _trades(ledger.trades(sma(spark, d), TICKER, rules))


@query
def ledger_small_capital(spark, d):
    """Capital near the price of one share: fills fail, wait for a lower price, or take one."""
    rules = Rules(initial_capital=105.0, allow_short=True)
    return _trades(ledger.trades(sma(spark, d), TICKER, rules))


@query
def ledger_stops(spark, d):
    rules = Rules(allow_short=True)
    return _trades(stops.trades_with_stops(sma(spark, d), TICKER, rules))


@query
def ledger_fixed_stop(spark, d):
    rules = StopRules(trailing=False, atr_multiplier=1.5)
    return _trades(stops.trades_with_stops(sma(spark, d), TICKER, Rules(), rules))


@query
def ledger_breaker(spark, d):
    rules = StopRules(circuit_breaker=True, circuit_breaker_pct=-0.003)
    return _trades(stops.trades_with_stops(sma(spark, d), TICKER, Rules(allow_short=True), rules))


@query
def equity_curve(spark, d):
    _, curve = long_run(spark, d)
    return rounded(curve, close=4, cash=2, positions_value=2, total_equity=2)


@query
def run_summary(spark, d):
    trades, curve = long_run(spark, d)
    df = ledger.run_summary(curve, trades, TICKER)
    return rounded(df, start_equity=2, end_equity=2, total_return=6)


@query
def zero_trade_runs(spark, d):
    trades, curve = long_run(spark, d, Rules(initial_capital=80.0))
    df = views.without_trades(ledger.run_summary(curve, trades, TICKER))
    return rounded(df, start_equity=2, end_equity=2, total_return=6)


# -- metrics -------------------------------------------------------------------------------------------------
RATIOS = {
    "total_return": 6, "cagr": 6, "sharpe_ratio": 6, "sortino_ratio": 6, "calmar_ratio": 6,
    "max_drawdown": 6, "volatility": 6, "ulcer_index": 6, "omega_ratio": 6, "tail_ratio": 6,
    "win_rate": 6, "profit_factor": 6,
}


def _metrics(df: DataFrame) -> DataFrame:
    return rounded(df, **RATIOS).withColumns(
        {c: F.col(c).cast("bigint") for c in ("max_dd_duration", "total_trades")}
    )


@query
def perf_metrics(spark, d):
    trades, curve = long_run(spark, d, Rules(allow_short=True))
    return _metrics(metrics.all_metrics(curve, trades, TICKER))


@query
def drawdown_series(spark, d):
    _, curve = long_run(spark, d)
    return rounded(views.drawdown_series(curve, TICKER), drawdown_pct=6)


@query
def rolling_metrics(spark, d):
    _, curve = long_run(spark, d)
    df = views.rolling_metrics(curve, TICKER).select(
        "ticker", "date", "rolling_sharpe", "rolling_volatility_pct", "cum_return_pct"
    )
    return rounded(df, rolling_sharpe=4, rolling_volatility_pct=6, cum_return_pct=6)


@query
def round_trips(spark, d):
    trades, _ = long_run(spark, d, Rules(allow_short=True))
    return rounded(metrics.round_trips(trades, TICKER), pnl=2).withColumn(
        "place", F.col("place").cast("bigint")
    )


@query
def round_trips_surplus(spark, d):
    df = metrics.round_trips(D.synthetic_trades(spark, d), TICKER, bin="day")
    return rounded(df, pnl=2).withColumn("place", F.col("place").cast("bigint"))


@query
def var_cvar(spark, d):
    _, curve = long_run(spark, d)
    return rounded(metrics.tail_risk(curve, TICKER), var_95=8, cvar_95=8)


@query
def alpha_beta_ir(spark, d):
    _, curve = long_run(spark, d)
    df = metrics.all_risk(curve, TICKER, D.market_returns(spark, d))
    return rounded(df, var_95=8, cvar_95=8, alpha=6, beta=6, information_ratio=6)


@query
def returns_histogram(spark, d):
    _, curve = long_run(spark, d)
    df = metrics.returns_histogram(curve, TICKER)
    return rounded(df, bin_start_pct=6, mean_pct=8).withColumn("bin", F.col("bin").cast("bigint"))


# -- experiments ----------------------------------------------------------------------------------------------
def _grid(spark, d) -> DataFrame:
    return experiments.grid_search(
        D.walk_bars(spark, d), TICKER, STRATEGIES["SMA Crossover"], GRID
    )


def _runs(df: DataFrame) -> DataFrame:
    whole = [c for c in ("run_id", "short_window", "long_window") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("bigint") for c in whole})


@query
def grid_search(spark, d):
    return _runs(_metrics(_grid(spark, d).drop("error"))).withColumn("value", F.round("value", 6))


def _rsi_grid(spark, d) -> DataFrame:
    return experiments.grid_search(D.walk_bars(spark, d), TICKER, STRATEGIES["RSI Reversion"], RSI_GRID)


@query
def grid_rsi(spark, d):
    df = _metrics(_rsi_grid(spark, d).drop("error")).withColumn("value", F.round("value", 6))
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("run_id", *RSI_GRID)})


@query
def grid_errors(spark, d):
    """Sets that cannot run and one window beyond all data among those that can."""
    df = experiments.grid_search(D.walk_bars(spark, d), TICKER, STRATEGIES["SMA Crossover"], BAD_GRID)
    df = df.select("ticker", *(F.col(c).cast("bigint") for c in ("run_id", *BAD_GRID)), F.round("value", 6).alias("value"), F.coalesce("total_trades", F.lit(0)).cast("bigint").alias("total_trades"), "error")
    return df.join(experiments.best_run(df, TICKER, []).select("ticker", F.col("run_id").alias("best")), "ticker")


@query
def grid_best(spark, d):
    return rounded(_runs(experiments.best_run(_grid(spark, d), TICKER, list(GRID))), value=6)


@query
def grid_top(spark, d):
    df = experiments.top_runs(_grid(spark, d).select("ticker", "run_id", "value"), TICKER)
    return rounded(_runs(df), value=6)


@query
def grid_heatmap(spark, d):
    df = experiments.heatmap(_grid(spark, d), TICKER, "short_window", "long_window", GRID["long_window"])
    df = _runs(df.withColumnsRenamed({str(v): f"long_{v}" for v in GRID["long_window"]}))
    return rounded(df, **{f"long_{v}": 6 for v in GRID["long_window"]})


@query
def train_test_split(spark, d):
    return experiments.train_test(D.daily_moves(spark, d).select("ticker", "date"), TICKER)


@query
def walk_forward(spark, d):
    df = experiments.walk_forward(
        D.walk_bars(spark, d), TICKER, STRATEGIES["SMA Crossover"], **SHORT_SMA
    )
    df = rounded(df, test_return=6)
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("window", "train_size", "test_size")})


@query
def compare_strategies(spark, d):
    found = experiments.compare_strategies(
        D.walk_bars(spark, d), TICKER,
        **{"SMA Crossover": SHORT_SMA, "Momentum + MR": FAST_MOMENTUM, "Multi-Factor": {"min_score": 3}},
    )
    return _metrics(found["results"])


# -- bootstrap --------------------------------------------------------------------------------------------------
def _paths(spark, d, simulate=bootstrap.simulate, **options) -> DataFrame:
    return simulate(D.daily_moves(spark, d).select("ticker", "date", F.col("move").alias("ret")), TICKER, SIMS, HORIZON, seed=SEED, **options)


@query
def bootstrap_fan(spark, d):
    df = bootstrap.fan(_paths(spark, d, bootstrap.simulated_days, of_days=bootstrap.FAN_OF_DAYS), "ticker").withColumn("day", F.col("day").cast("bigint"))
    return rounded(df, **{p: 9 for p in bootstrap.FAN})


SUMMARY = {
    "mean_final": 9, "median_final": 9, "std_final": 9, "worst_case_5pct": 9,
    "best_case_95pct": 9, "prob_profit": 6, "prob_loss_20pct": 6,
}


@query
def bootstrap_summary(spark, d):
    return rounded(bootstrap.terminal_summary(_paths(spark, d, only_day=HORIZON), HORIZON, "ticker"), **SUMMARY)


@query
def bootstrap_parametric(spark, d):
    paths = _paths(spark, d, method="parametric", initial=100.0, only_day=HORIZON)
    df = bootstrap.terminal_summary(paths, HORIZON, "ticker", initial=100.0)
    return rounded(df, **{**SUMMARY, "prob_profit": 6})


@query
def stress_injection(spark, d):
    """Stressed simulations and the mean of all paths, per day."""
    df = _paths(spark, d, bootstrap.simulated_days, stress_probability=0.4, of_days=bootstrap.STRESS_OF_DAYS)
    return rounded(df.select("ticker", F.col("day").cast("bigint").alias("day"), "stressed_sims", "mean_value"), mean_value=6)


@query
def scenario_summary(spark, d):
    accounts = D.table(spark, d, "customer").select(
        "c_custkey", (F.abs("c_acctbal") + 1.0).alias("initial")
    )
    df = bootstrap.scenario_summary(accounts)
    return df.withColumn("duration_days", F.col("duration_days").cast("bigint"))


# -- report views ------------------------------------------------------------------------------------------------
@query
def kpi_report(spark, d):
    trades, curve = long_run(spark, d)
    df = views.kpis(curve, trades, TICKER, D.market_returns(spark, d))
    return _metrics(df).select(
        "ticker", "cagr", "sharpe_ratio", "max_drawdown", "win_rate", "sharpe_grade",
        "ulcer_rating", "omega_rating", "tail_rating",
        F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"),
    )


@query
def equity_vs_benchmark(spark, d):
    _, curve = long_run(spark, d)
    market = Series("market")
    moves = D.market_returns(spark, d).withColumn("market", F.lit("all"))
    grown = moves.withColumn("close", market.cumprod(1 + F.col("bench_ret")))
    df = views.equity_vs_benchmark(curve, B.benchmark_equity(grown, market), TICKER)
    return rounded(df, total_equity=2, benchmark_equity=2)


@query
def trade_log(spark, d):
    trades, _ = long_run(spark, d)
    df = views.trade_log(trades, TICKER).drop("price_text")
    df = df.withColumn("seq", F.col("seq").cast("bigint"))
    return rounded(df, price=4, commission=4, slippage=4, notional=2)


@query
def daily_returns(spark, d):
    _, curve = long_run(spark, d)
    return rounded(views.daily_returns(curve, TICKER), ret=8)


@query
def strategy_ranking(spark, d):
    found = experiments.compare_strategies(
        D.walk_bars(spark, d), TICKER,
        **{"SMA Crossover": SHORT_SMA, "Momentum + MR": FAST_MOMENTUM, "Multi-Factor": {"min_score": 3}},
    )
    df = views.ranked_strategies(found["results"], "ticker")
    return df.withColumn("total_trades", F.col("total_trades").cast("bigint"))


# -- intraday bars, in blocks -------------------------------------------------------------------------------------
@query
def intraday_indicators(spark, d):
    """Hourly bars cut in blocks of about 600 rows, each with the run-up the averages need."""

    def add(df: DataFrame, series: Series) -> DataFrame:
        df = df.withColumns({"sma20": series.mean("close", 20), "std20": series.std("close", 20)})
        df = indicators.with_atr(df, series)
        return drop_helpers(indicators.with_rsi(df, series))

    df = blocks.in_blocks(D.hourly_bars(spark, d), TICKER, add, lookback=600, bin="day", rows=600)
    df = df.select("ticker", "date", "close", "sma20", "std20", "atr", "rsi")
    return rounded(df, close=6, sma20=6, std20=6, atr=6, rsi=6)


@query
def intraday_drawdown(spark, d):
    df = blocks.running_in_bins(
        D.hourly_bars(spark, d), TICKER, "day",
        peak=("max", "close"), traded=("sum", "volume"), last_close=("last", "close"),
    )
    fall = F.try_divide(F.col("close") - F.col("peak"), F.col("peak"))
    df = df.select("ticker", "date", "peak", fall.alias("drawdown"), "traded", "last_close")
    return rounded(df, peak=6, drawdown=8, last_close=6)


@query
def intraday_underwater(spark, d):
    return rounded(blocks.underwater(D.hourly_bars(spark, d), TICKER), max_drawdown=8)
