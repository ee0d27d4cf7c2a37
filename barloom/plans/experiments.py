"""Experiments over many parameter sets, windows or strategies: each is a key column of one job."""

from __future__ import annotations

import itertools
import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.series import Series, helper_columns, with_ewm_of, with_position
from barloom.operators import ledger, metrics
from barloom.operators.indicators import with_regime
from barloom.operators.ledger import Rules
from barloom.operators.signals import STRATEGIES, TIE, Strategy
from barloom.operators.stops import StopRules, trades_with_stops

TOP_RESULTS = 100
CHAIN = 8


def backtest(
    signals: DataFrame, series: Series, rules: Rules = Rules(), stops: StopRules | None = None,
    marks: DataFrame | None = None, keep: bool = False, rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trades, equity) of every series in the frame. `marks` holds the bars to value positions
    at, where they can be had without computing the signals again, and `rows` is their number, where it is
    known. With `keep` the trades are persisted for the results made from them; unpersist them when done."""
    if stops is None:
        trade_list = ledger.trades(signals, series, rules)
    else:
        trade_list = trades_with_stops(signals, series, rules, stops)
    if keep:
        trade_list = trade_list.persist()
    bars = signals if marks is None else marks
    return trade_list, ledger.equity(bars, trade_list, series, rules.initial_capital, rows)


def fan_out(bars: DataFrame, series: Series, label: str, values: list) -> DataFrame:
    """The closes once per value of `label`."""
    each = F.explode(F.array(*(F.lit(v) for v in values))).alias(label)
    return bars.select(*series.keys, series.order, "close", each)


# -- parameter grids -------------------------------------------------------------------------------
def parameter_sets(grid: dict[str, list]) -> list[dict]:
    """Every combination of the listed values, in the order of the lists."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def runs_table(spark: SparkSession, sets: list[dict]) -> DataFrame:
    """run_id with one column per parameter."""
    rows = [(i, *params.values()) for i, params in enumerate(sets)]
    return spark.createDataFrame(rows, ["run_id", *sets[0]])


def sma_grid_signals(bars: DataFrame, series: Series, sets: list[dict]) -> DataFrame:
    """Signals of many SMA crossovers. Each distinct window is averaged once per bar; a bar then
    yields one narrow row per run, without a join."""
    windows = sorted({w for s in sets for w in (s["short_window"], s["long_window"])})
    averages = F.array(*(F.coalesce(F.col(f"_ma{n}"), F.lit(float("nan"))) for n in windows))
    df = bars.withColumns({f"_ma{n}": series.mean("close", n) for n in windows}).select(
        *series.keys, series.order, "open", "close", averages.alias("_ma")
    )
    # Per run only its number and the places of its two averages are multiplied out; the signal
    # is worked out on the narrow row afterwards.
    at = {n: i for i, n in enumerate(windows)}
    runs = F.array(
        *(
            F.struct(
                F.lit(i).alias("run_id"),
                F.lit(at[s["short_window"]]).alias("_short"),
                F.lit(at[s["long_window"]]).alias("_long"),
            )
            for i, s in enumerate(sets)
        )
    )
    df = df.select("*", F.inline(runs))
    long_ma = F.col("_ma")[F.col("_long")]
    lead = F.col("_ma")[F.col("_short")] - long_ma
    # NaN marks the warm-up inside the array; it never reaches a result.
    signal = F.when(F.isnan(lead), 0).when(lead > F.abs(long_ma) * TIE, 1).otherwise(-1)
    return df.select(
        "run_id", *series.keys, series.order, "open", "close", signal.alias("signal")
    )


def stacked_signals(
    bars: DataFrame, series: Series, label: str, jobs: list[tuple[object, Strategy, dict]]
) -> DataFrame:
    """Signals of several (label value, strategy, parameters), one row per bar and job.

    The strategies are chained on the same bars and share indicators, so the bars are read and
    shuffled once, and a bar fans out only when all its signals are known. Long lists are cut in chains, since
    the plan grows with every strategy in a chain.
    """
    base, parts = bars.columns, []
    keep = [c for c in ("open", "high", "low", "close") if c in base]
    for at in range(0, len(jobs), CHAIN):
        df, done = bars, []
        for value, strategy, params in jobs[at : at + CHAIN]:
            name = f"_s{len(done)}"
            df = strategy.make(df, series, **{**strategy.params, **params})
            done.append((value, name))
            df = df.withColumn(name, F.col("signal")).select(
                *base, *(n for _, n in done), *helper_columns(df)
            )
        df = df.select(
            *series.keys, series.order, *keep,
            F.posexplode(F.array(*(n for _, n in done))).alias("_at", "signal"),
        )
        labels = F.array(*(F.lit(v) for v, _ in done))
        parts.append(df.withColumn(label, labels[F.col("_at")]).drop("_at"))
    return reduce(DataFrame.unionByName, parts)


def _each(bars: DataFrame, name: str, values: list, kind: str) -> DataFrame:
    """The bars once per value, which stands in column `name`."""
    return bars.withColumn(name, F.explode(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")))


def _runs_of(groups: list[list[dict]], kind: str) -> Column:
    """For column _group, the runs (structs) of that group, as one constant."""
    return F.get(F.from_json(F.lit(json.dumps(groups)), f"array<array<struct<{kind}>>>"), F.col("_group"))


def _grouped(sets: list[dict], *names: str) -> tuple[list[tuple], list[list[dict]]]:
    """The distinct values of the named parameters, and the sets that have each, numbered as given."""
    groups: dict[tuple, list[dict]] = {}
    for i, s in enumerate(sets):
        groups.setdefault(tuple(s[n] for n in names), []).append({"run_id": i, **{k: v for k, v in s.items() if k not in names}})
    return list(groups), list(groups.values())


def rsi_grid_signals(bars: DataFrame, series: Series, sets: list[dict]) -> DataFrame:
    """Signals of many RSI strategies. Windows and thresholds are columns, so the plan does not grow with the sets.

    The RSI of each distinct window is worked out once per bar, on a row of its own; the row then yields one narrow row per run.
    """
    windows, runs = _grouped(sets, "window")
    moves = with_position(bars.select(*series.keys, series.order, "open", "close", F.coalesce(series.diff("close"), F.lit(0.0)).alias("_move")), series)
    df = _each(moves, "_spec", [{"_group": g, "n": n} for g, (n,) in enumerate(windows)], "struct<_group: int, n: int>").select("*", "_spec.*").drop("_spec")
    df = df.withColumns({"_rate": 1.0 / F.col("n"), "_gain": F.greatest("_move", F.lit(0.0)), "_loss": F.greatest(-F.col("_move"), F.lit(0.0))})
    df = with_ewm_of(df, series.within("_group"), "_rate", _ag="_gain", _al="_loss")
    rsi = F.when(F.col("_al") == 0, F.lit(100.0)).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide("_ag", "_al")))
    df = df.select(*series.keys, series.order, "open", "close", F.when(F.col("_pos") + 1 >= F.col("n"), rsi).alias("_rsi"), "_group")
    df = df.select("*", F.inline(_runs_of(runs, "run_id: int, overbought: double, oversold: double")))
    signal = F.when(F.col("_rsi") < F.col("oversold"), 1).when(F.col("_rsi") > F.col("overbought"), -1).otherwise(0)
    return df.select("run_id", *series.keys, series.order, "open", "close", signal.alias("signal"))


def macd_grid_signals(bars: DataFrame, series: Series, sets: list[dict]) -> DataFrame:
    """Signals of many MACD crossings; spans are columns, so the plan does not grow with the sets."""
    spans, runs = _grouped(sets, "fast", "slow", "signal")
    df = with_position(bars.select(*series.keys, series.order, "open", "close"), series)
    specs = [{"_group": g, "f": f, "s": s, "n": n} for g, (f, s, n) in enumerate(spans)]
    df = _each(df, "_spec", specs, "struct<_group: int, f: int, s: int, n: int>").select("*", "_spec.*").drop("_spec")
    df = df.withColumns({f"_a{c}": 2.0 / (F.col(c) + 1) for c in "fsn"})
    by_set = series.within("_group")
    df = with_ewm_of(with_ewm_of(df, by_set, "_af", _fast="close"), by_set, "_as", _slow="close")
    df = with_ewm_of(df.withColumn("_line", F.col("_fast") - F.col("_slow")), by_set, "_an", _smooth="_line")
    lead, tie = F.col("_line") - F.col("_smooth"), F.abs("close") * TIE
    signal = F.when(lead > tie, 1).when(lead < -tie, -1).otherwise(0)
    df = df.select(*series.keys, series.order, "open", "close", signal.alias("signal"), "_group")
    return df.select("*", F.inline(_runs_of(runs, "run_id: int"))).drop("_group")


GRIDS = {"SMA Crossover": sma_grid_signals, "RSI Reversion": rsi_grid_signals, "MACD": macd_grid_signals}


def grid_signals(bars: DataFrame, series: Series, strategy: Strategy, sets: list[dict]) -> DataFrame:
    """Signals of any strategy for many parameter sets, keyed by run_id."""
    for name, signals in GRIDS.items():
        if strategy is STRATEGIES[name]:
            return signals(bars, series, [{**strategy.params, **s} for s in sets])
    return stacked_signals(bars, series, "run_id", [(i, strategy, s) for i, s in enumerate(sets)])


# Parameters that count bars.
COUNTS = ("window", "short_window", "long_window", "fast", "slow", "signal", "rsi_window", "bb_window", "macd_fast", "macd_slow", "macd_signal",
          "trend_window", "vol_window", "momentum_window", "trend_ma")


def set_error(strategy: Strategy, params: dict) -> str | None:
    """What is wrong with a parameter set; None if it can run. A window longer than the data is none: it gives no signal."""
    for name, value in params.items():
        if name not in strategy.params:
            return f"{name} is no parameter"
        number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
        if name in COUNTS and not (number and value >= 1 and value == int(value)):
            return f"{name} must be a whole number from 1 on, not {value!r}"
        if not number:
            return f"{name} must be a number, not {value!r}"
    return None


def grid_search(
    bars: DataFrame, series: Series, strategy: Strategy, grid: dict[str, list],
    rules: Rules = Rules(), metric: str = "sharpe_ratio",
) -> DataFrame:
    """Metrics of every run: run_id, keys, parameters, `value` (the metric, infinity as 0), the
    fourteen metrics and `error`.

    A set that cannot run has one row per series all the same, with value 0, no other metric, and what is wrong with it.
    Parameters of both numbers and texts come out as texts. The bars are counted once, so that a task's share of the
    runs does not grow with them or with the grid.
    """
    sets = parameter_sets(grid)
    errors = {i: e for i, s in enumerate(sets) if (e := set_error(strategy, s))}
    good = [i for i in range(len(sets)) if i not in errors]
    # The parameter sets come from the caller's code, so their table is small by construction.
    mixed = {k for k, values in grid.items() if len({isinstance(v, str) for v in values}) > 1}
    lookup = F.array(*(F.struct(*(F.lit(str(v) if k in mixed else v).alias(k) for k, v in s.items())) for s in sets))
    params = F.element_at(lookup, F.col("run_id") + 1)
    parts = []
    if good:
        signals = grid_signals(bars, series, strategy, [sets[i] for i in good])
        marks = fan_out(bars, series, "run_id", list(range(len(good))))
        by_run = series.within("run_id")
        trade_list, curve = backtest(signals, by_run, rules, marks=marks, rows=bars.count() * len(good))
        result = metrics.all_metrics(curve, trade_list, by_run)
        value = F.when(F.abs(metric) == float("inf"), 0.0).otherwise(F.col(metric))
        if errors:
            result = result.withColumn("run_id", F.element_at(F.from_json(F.lit(json.dumps(good)), "array<int>"), F.col("run_id") + 1))
        parts.append(result.withColumn("value", value).withColumn("error", F.lit(None).cast("string")))
    if errors:
        wrong = F.inline(F.from_json(F.lit(json.dumps([{"run_id": i, "error": e} for i, e in errors.items()])), "array<struct<run_id: int, error: string>>"))
        parts.append(bars.select(*series.keys).distinct().select("*", wrong).withColumn("value", F.lit(0.0)))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.withColumns({k: params[k] for k in grid})


def best_run(results: DataFrame, series: Series, params: list[str]) -> DataFrame:
    """Highest value per series, the earlier run on ties; undefined values and sets with an error never win."""
    order = F.struct("value", (-F.col("run_id")).alias("first"))
    fine = "value IS NOT NULL AND NOT isnan(value)" + (" AND error IS NULL" if "error" in results.columns else "")
    defined = results.where(fine)
    best = F.max_by(F.struct("run_id", *params, "value"), order)
    return defined.groupBy(*series.keys).agg(best.alias("b")).select(*series.keys, "b.*")


def top_runs(results: DataFrame, series: Series, n: int = TOP_RESULTS) -> DataFrame:
    """The `n` best runs of each series, the earlier run on ties; undefined values come last."""
    place = F.row_number().over(Window.partitionBy(*series.keys).orderBy(F.desc_nulls_last("value"), "run_id"))
    return results.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def heatmap(results: DataFrame, series: Series, rows: str, columns: str, values: list) -> DataFrame:
    """Two parameters as a table: one row per value of `rows`, one column per value of
    `columns`. The column values come from the grid, so no extra pass looks for them."""
    wide = results.groupBy(*series.keys, rows).pivot(columns, values)
    return wide.agg(F.first("value", ignorenulls=True))


# -- walk-forward -----------------------------------------------------------------------------------
def train_test(bars: DataFrame, series: Series, ratio: float = 0.7) -> DataFrame:
    """`part`: the first floor(rows * ratio) bars of a series are 'train', the rest 'test'."""
    rows = F.count("*").over(series.whole)
    cut = F.floor(rows * F.lit(float(ratio)))
    return bars.withColumn(
        "part", F.when(series.position() < cut, "train").otherwise("test")
    )


def walk_forward_windows(
    bars: DataFrame, series: Series, splits: int = 5, ratio: float = 0.7
) -> DataFrame:
    """Consecutive windows of equal length (the last takes the rest), each split in train and
    test. Windows with an empty half are left out; `window` numbers the others from 1."""
    keys = list(series.keys)
    df = bars.withColumns({"_pos": series.position(), "_rows": F.count("*").over(series.whole)})
    size = F.floor(F.col("_rows") / splits)
    nth = F.when(size == 0, splits - 1).otherwise(
        F.least(F.floor(F.try_divide("_pos", size)), F.lit(splits - 1))
    )
    df = df.withColumns({"_size": size, "_nth": nth.cast("int")})
    length = F.when(
        F.col("_nth") == splits - 1, F.col("_rows") - F.col("_size") * (splits - 1)
    ).otherwise(F.col("_size"))
    df = df.withColumn("_len", length)
    train = F.floor(F.col("_len") * F.lit(float(ratio)))
    place = F.col("_pos") - F.col("_nth") * F.col("_size")
    df = df.withColumns({"train_size": train, "part": F.when(place < train, "train").otherwise("test")})
    df = df.withColumn("test_size", F.col("_len") - F.col("train_size"))
    kept = df.where("train_size > 0 AND test_size > 0")
    # All windows but the last have one length, so they are kept or left out together.
    first = F.min("_nth").over(Window.partitionBy(*keys))
    return kept.withColumn("window", F.col("_nth") - first + 1).drop(
        "_pos", "_rows", "_size", "_nth", "_len"
    )


def walk_forward(
    bars: DataFrame, series: Series, strategy: Strategy, splits=5, ratio=0.7,
    rules: Rules = Rules(), **params,
) -> DataFrame:
    """Each window's test bars traded on their own: return and number of trades."""
    by_window = series.within("window")
    keys = list(by_window.keys)
    test = walk_forward_windows(bars, series, splits, ratio).where("part = 'test'")
    signals = strategy.signals(test, by_window, **params)
    trade_list, curve = backtest(signals, by_window, rules, marks=test)
    sizes = test.groupBy(*keys).agg(
        F.first("train_size").alias("train_size"), F.first("test_size").alias("test_size")
    )
    summary = ledger.run_summary(curve, trade_list, by_window)
    result = F.when(F.col("start_equity") > 0, F.col("total_return")).otherwise(0.0)
    return sizes.join(summary, keys).select(
        *keys, "train_size", "test_size", result.alias("test_return"), "num_trades"
    )


# -- strategy comparison -----------------------------------------------------------------------------
# Weights of the composite score.
WEIGHTS = {
    "sharpe_ratio": 0.35,
    "sortino_ratio": 0.25,
    "max_drawdown": 0.20,
    "cagr": 0.15,
    "win_rate": 0.05,
}


def strategy_signals(bars: DataFrame, series: Series, names=tuple(STRATEGIES), **params) -> DataFrame:
    """Signals of several strategies on the same bars, keyed by `strategy`. `params` maps a
    strategy to the parameters that differ from its defaults."""
    jobs = [(n, STRATEGIES[n], params.get(n, {})) for n in names]
    return stacked_signals(bars, series, "strategy", jobs)


def composite(results: DataFrame, *keys: str) -> DataFrame:
    """Weighted rank of the strategies of each key: every metric scaled to [0, 1] over the
    strategies (0.5 where all agree), drawdown reversed. An infinite or missing ratio scores
    0.5, where plain arithmetic would give no number."""
    peers = Window.partitionBy(*(keys or ("ticker",)))
    raw = {
        f"_{m}": F.when(F.abs(m) == float("inf"), None).otherwise(
            F.abs(m) if m == "max_drawdown" else F.col(m)
        )
        for m in WEIGHTS
    }
    df = results.withColumns(raw)
    score = F.lit(0.0)
    for m, weight in WEIGHTS.items():
        low, high = F.min(f"_{m}").over(peers), F.max(f"_{m}").over(peers)
        scaled = F.when(high > low, F.try_divide(F.col(f"_{m}") - low, high - low)).otherwise(0.5)
        scaled = F.coalesce(scaled, F.lit(0.5))
        score = score + weight * (1 - scaled if m == "max_drawdown" else scaled)
    return df.withColumn("composite", F.round(score, 3)).drop(*raw)


def compare_strategies(
    bars: DataFrame, series: Series, rules: Rules = Rules(), stops: StopRules | None = None,
    names=tuple(STRATEGIES), **params,
) -> dict[str, DataFrame]:
    """`results` (metrics and composite score), `equity` and `regimes` for every series. The bars are counted
    once, for the number of tasks."""
    by_strategy = series.within("strategy")
    signals = strategy_signals(bars, series, names, **params)
    marks = fan_out(bars, series, "strategy", list(names))
    trade_list, curve = backtest(signals, by_strategy, rules, stops, marks, rows=bars.count() * len(names))
    results = metrics.all_metrics(curve, trade_list, by_strategy)
    return {
        "results": composite(results, *series.keys),
        "equity": curve,
        "regimes": with_regime(bars, series),
    }
