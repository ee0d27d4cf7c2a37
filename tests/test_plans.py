import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from conftest import ordered, prices
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom import Series
from barloom.functions import scalars as X
from barloom.functions import draws, series
from barloom.operators import ledger, metrics
from barloom.operators.ledger import Rules
from barloom.operators.signals import STRATEGIES, multi_factor
from barloom.operators.stops import StopRules
from barloom.plans import bootstrap, experiments, views
from barloom.sources import sample_bars

S = Series("ticker")
SMA = STRATEGIES["SMA Crossover"]


# -- grids ---------------------------------------------------------------------------------------
def test_grid_gives_each_run_what_it_gives_alone(bars):
    grid = {"short_window": [5, 10], "long_window": [20, 30]}
    results = experiments.grid_search(bars, S, SMA, grid)
    got = ordered(results, "run_id", "ticker")
    assert len(got) == 4 * 3
    for i, params in enumerate(experiments.parameter_sets(grid)):
        trades, curve = experiments.backtest(SMA.signals(bars, S, **params), S)
        alone = ordered(metrics.all_metrics(curve, trades, S), "ticker")
        mine = got[got["run_id"] == i].reset_index(drop=True)
        assert (mine["short_window"] == params["short_window"]).all()
        for c in ("total_return", "sharpe_ratio", "win_rate", "total_trades"):
            np.testing.assert_allclose(mine[c].astype(float), alone[c].astype(float), rtol=1e-9)


def test_generic_grid_over_more_sets_than_one_chain(bars):
    rsi = STRATEGIES["RSI Reversion"]
    sets = [{"window": w} for w in range(5, 5 + experiments.CHAIN + 2)]
    signals = experiments.grid_signals(bars, S, rsi, sets)
    assert signals.select("run_id").distinct().count() == len(sets)
    last = ordered(signals.where(F.col("run_id") == len(sets) - 1))
    alone = ordered(rsi.signals(bars, S, **sets[-1]))
    assert last["signal"].tolist() == alone["signal"].tolist()


def test_best_run(spark):
    rows = [("A", 0, 1.0), ("A", 1, 2.0), ("A", 2, 2.0), ("A", 3, float("nan")), ("A", 4, None)]
    df = spark.createDataFrame(rows, "ticker string, run_id int, value double").withColumn("p", F.col("run_id") * 10)
    row = experiments.best_run(df, S, ["p"]).first()
    assert (row.run_id, row.p, row.value) == (1, 10, 2.0)
    assert [r.run_id for r in experiments.top_runs(df.where("run_id < 3"), S, 2).orderBy("run_id").collect()] == [1, 2]
    both = df.where("run_id < 3").unionByName(df.where("run_id < 3").withColumn("ticker", F.lit("other")))
    assert experiments.top_runs(both, S, 2).groupBy("ticker").count().collect() and experiments.top_runs(both, S, 2).count() == 4


def test_heatmap(spark):
    df = spark.createDataFrame([("A", 1, 5, 0.1), ("A", 1, 6, 0.2), ("A", 2, 5, 0.3)], "ticker string, a int, b int, value double")
    got = ordered(experiments.heatmap(df, S, "a", "b", [5, 6]), "a")
    assert got["5"].tolist() == [0.1, 0.3] and got["6"][0] == 0.2 and math.isnan(got["6"][1])


# -- walk-forward -----------------------------------------------------------------------------------
def windows(spark, n, splits, ratio=0.7):
    df = experiments.walk_forward_windows(prices(spark, np.arange(1, n + 1)), S, splits, ratio)
    got = ordered(df.groupBy("window", "part").count(), "window", "part")
    return {(r.window, r.part): r["count"] for _, r in got.iterrows()}


def test_windows_are_consecutive(spark):
    assert windows(spark, 103, 5) == {
        **{(w, "train"): 14 for w in range(1, 5)}, **{(w, "test"): 6 for w in range(1, 5)},
        (5, "train"): 16, (5, "test"): 7,
    }


def test_windows_of_short_series(spark):
    assert windows(spark, 3, 5) == {(1, "train"): 2, (1, "test"): 1}
    assert windows(spark, 7, 5) == {(1, "train"): 2, (1, "test"): 1}
    assert windows(spark, 1, 2) == {}


def test_walk_forward_matches_single_windows(bars):
    got = ordered(experiments.walk_forward(bars, S, SMA, 3, short_window=5, long_window=20), "ticker", "window")
    cut = experiments.walk_forward_windows(bars, S, 3).where("part = 'test' AND window = 2 AND ticker = 'B'")
    trades, curve = experiments.backtest(SMA.signals(cut, S, short_window=5, long_window=20), S)
    row = got[(got["ticker"] == "B") & (got["window"] == 2)].iloc[0]
    equity = ordered(curve)["total_equity"]
    assert row["test_return"] == pytest.approx(equity.iloc[-1] / equity.iloc[0] - 1)
    assert row["num_trades"] == trades.count() and row["test_size"] == len(equity)


# -- comparison ----------------------------------------------------------------------------------------
def test_comparison_matches_single_strategies(bars):
    found = experiments.compare_strategies(bars, S, Rules(allow_short=True))
    got = ordered(found["results"], "strategy", "ticker")
    assert len(got) == 7 * 3
    for name in ("MACD", "Multi-Factor", "Momentum + MR"):
        trades, curve = experiments.backtest(STRATEGIES[name].signals(bars, S), S, Rules(allow_short=True))
        alone = ordered(metrics.performance(curve, S), "ticker")
        mine = got[got["strategy"] == name]
        np.testing.assert_allclose(mine["total_return"], alone["total_return"], rtol=1e-9, atol=1e-12)
    ranked = views.ranked_strategies(found["results"], "ticker").where("ticker = 'A'").toPandas()
    assert ranked["composite"].is_monotonic_decreasing


def test_comparison_with_stops(bars):
    found = experiments.compare_strategies(
        bars, S, stops=StopRules(), names=("Buy & Hold", "SMA Crossover"),
    )
    assert found["results"].count() == 6


def test_composite(spark):
    rows = [
        ("A", "x", 1.0, 2.0, -0.1, 0.2, 0.5), ("A", "y", 0.0, 1.0, -0.3, 0.1, 0.5),
        ("A", "z", 0.5, math.inf, -0.2, 0.15, 0.5),
    ]
    df = spark.createDataFrame(
        rows, "ticker string, strategy string, sharpe_ratio double, sortino_ratio double, max_drawdown double, cagr double, win_rate double"
    )
    got = {r.strategy: r.composite for r in experiments.composite(df).collect()}
    assert got == {"x": 0.975, "y": 0.025, "z": 0.5}


# -- bootstrap ------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def rets(spark):
    rng = np.random.default_rng(5)
    df = prices(spark, 100 * np.cumprod(1 + rng.normal(0.001, 0.01, 300)))
    return df.select("ticker", "date", S.pct_change("close").alias("ret")).where("ret IS NOT NULL").cache()


@pytest.mark.parametrize("method", ["bootstrap", "parametric"])
def test_paths_do_not_depend_on_partitioning(spark, rets, method):
    def paths(df):
        return ordered(bootstrap.simulate(df, S, 20, 10, method, seed=3), "sim", "day")

    a, b = paths(rets.repartition(7)), paths(rets.coalesce(1))
    assert len(a) == 200
    np.testing.assert_allclose(a["value"], b["value"], rtol=1e-12)
    assert a["value"].std() > 0
    other = ordered(bootstrap.simulate(rets, S, 20, 10, method, seed=4), "sim", "day")
    assert not np.allclose(a["value"], other["value"])


def test_draws_follow_the_returns(rets):
    known = {round(r.ret, 12) for r in rets.collect()}
    drawn = bootstrap.sampled_returns(rets, S, 200, 20).toPandas()["ret"]
    assert {round(x, 12) for x in drawn} <= known
    normal = bootstrap.sampled_returns(rets, S, 400, 20, "parametric").toPandas()["ret"]
    base = np.array(sorted(known))
    assert normal.mean() == pytest.approx(base.mean(), abs=4e-4)
    assert normal.std() == pytest.approx(base.std(), rel=0.05)


def test_stress(rets):
    drawn = bootstrap.sampled_returns(rets, S, 50, 30)
    none = bootstrap.inject_stress(drawn, S, 30, 0.0)
    assert none.where("stressed").count() == 0
    every = ordered(bootstrap.inject_stress(drawn, S, 30, 1.0), "sim", "day")
    starts = {tuple(p[3][: min(len(p[3]), 30)]) for p in bootstrap.SCENARIOS.values()}
    for _, g in every.groupby("sim"):
        path = tuple(g["ret"])
        assert any(path[k : k + len(s)] == s for s in starts for k in range(30 - len(s) + 1))


def test_fan_and_summary(rets):
    paths = bootstrap.simulate(rets, S, 100, 10, initial=50.0)
    fan = ordered(bootstrap.fan(paths, "ticker"), "day")
    assert len(fan) == 10
    assert (fan["p5"] <= fan["p25"]).all() and (fan["p75"] <= fan["p95"]).all()
    final = paths.where("day = 10").toPandas()["value"]
    row = bootstrap.terminal_summary(paths, 10, "ticker", initial=50.0).first()
    assert row.median_final == pytest.approx(final.median())
    assert row.std_final == pytest.approx(final.std())
    assert row.worst_case_5pct == pytest.approx(final.quantile(0.05))
    assert row.prob_profit == pytest.approx((final > 50).mean())


@pytest.mark.parametrize("method", ["bootstrap", "parametric"])
def test_paths_grow_by_the_same_draws_for_any_keys_and_shares(spark, monkeypatch, method):
    keyed = Series("a", "b")
    names = [("x", "y"), ("", None), (None, None), ("Zürich " * 12, "z")]
    rows = [(a, b, dt.date(2022, 1, 1) + dt.timedelta(days=i), (i * 7 % 11 - 5) / 100) for a, b in names for i in range(15)]
    df = spark.createDataFrame(rows, "a string, b string, date date, ret double")
    draws = bootstrap.sampled_returns(df, keyed, 12, 120, method, seed=5)
    draws = ordered(bootstrap.inject_stress(draws, keyed, 120, 0.5, seed=5).na.fill("-"), "a", "b", "sim", "day")
    draws["value"] = (1 + draws["ret"]).groupby([draws["a"], draws["b"], draws["sim"]]).cumprod() * 3
    assert len(draws) == 4 * 12 * 120 and draws["stressed"].nunique() == 2
    for at_once in (10_000, 5):
        monkeypatch.setattr(bootstrap, "SIMS_AT_ONCE", at_once)
        args = dict(method=method, initial=3.0, stress_probability=0.5, seed=5)
        got = ordered(bootstrap.simulate(df, keyed, 12, 120, **args).na.fill("-"), "a", "b", "sim", "day")
        assert got[["a", "b", "sim", "day", "stressed"]].equals(draws[["a", "b", "sim", "day", "stressed"]])
        assert np.allclose(got["value"], draws["value"], rtol=1e-12, atol=0)
        days = ordered(bootstrap.fan(bootstrap.simulated_days(df, keyed, 12, 120, **args), "a", "b").na.fill("-"), "a", "b", "day")
        wide = got.groupby(["a", "b", "day"])["value"]
        for name, share in bootstrap.FAN.items():
            assert np.allclose(days[name], wide.quantile(share).to_numpy(), rtol=1e-12, atol=0)


def test_values_of_a_day_stay_in_a_row(rets):
    """No value of a path is shuffled for the fan, and the summary takes only the last day apart."""
    fan = bootstrap.fan(bootstrap.simulated_days(rets, S, 50, 10), "ticker")._jdf.queryExecution()
    plan = fan.executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0]
    last = bootstrap.terminal_summary(bootstrap.simulate(rets, S, 50, 10), 10, "ticker")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in last and last.index("Generate") < last.index("Filter") < last.index("MapInArrow")


def test_what_is_made_of_days_where_they_are_simulated(rets, monkeypatch):
    """Percentiles and means of days, and one day alone, are those of the rows of all values, whole keys or shares of them."""
    for at_once in (10_000, 7):
        monkeypatch.setattr(bootstrap, "SIMS_AT_ONCE", at_once)
        args = (rets, S, 20, 30)
        stress = dict(initial=3.0, stress_probability=0.5, seed=5)
        paths = bootstrap.simulate(*args, **stress).toPandas()
        fan = bootstrap.fan(bootstrap.simulated_days(*args, **stress, of_days=bootstrap.FAN_OF_DAYS), "ticker")
        assert fan.columns == ["ticker", "day", *bootstrap.FAN]
        assert "sort_array" not in fan._jdf.queryExecution().optimizedPlan().toString()
        got, wide = ordered(fan, "day"), paths.groupby("day")
        for name, share in bootstrap.FAN.items():
            assert np.allclose(got[name], wide["value"].quantile(share), rtol=1e-12, atol=0)
        days = ordered(bootstrap.simulated_days(*args, **stress, of_days=bootstrap.STRESS_OF_DAYS), "day")
        assert list(days.columns) == ["ticker", "day", "stressed_sims", "mean_value"] and len(days) == 30
        assert days["stressed_sims"].tolist() == wide["stressed"].sum().tolist()
        assert np.allclose(days["mean_value"], wide["value"].mean(), rtol=1e-12, atol=0)
        in_order = paths.sort_values("sim").groupby("day")["value"].apply(lambda v: float(np.cumsum(v.to_numpy())[-1] / len(v)))
        assert days["mean_value"].tolist() == in_order.tolist()
        last = ordered(bootstrap.simulate(*args, **stress, only_day=30), "sim")
        pd.testing.assert_frame_equal(last, paths[paths["day"] == 30].sort_values("sim", ignore_index=True))


def test_draws_are_md5_of_their_texts():
    """Fronts that end in any byte of a block, one and two blocks, numbers of one to five digits."""
    for front in ("", *("x" * n + "|" for n in range(36, 61)), "7|draw|12|", "é" * 22 + "|"):
        for sims, days in ((np.arange(95, 105), np.arange(8, 12)), (np.arange(9_998, 10_002), np.arange(99, 101)), (np.arange(12), None)):
            got = draws.hashed(front, sims, days)
            texts = [[f"{front}{s}" for s in sims]] if days is None else [[f"{front}{s}|{d}" for s in sims] for d in days]
            want = [[int(hashlib.md5(t.encode()).hexdigest()[:12], 16) for t in row] for row in texts]
            assert got.tolist() == (want[0] if days is None else want)
    numbers = np.array([0, 1, 554, 555, 556, 2**48 - 1])
    assert all((draws.remainder(numbers, n) == numbers % n).all() for n in (1, 2, 555, 2**31))


def test_scenarios(spark):
    assert [len(p[3]) for p in bootstrap.SCENARIOS.values()] == [60, 23, 40]
    assert bootstrap.scenario_days(spark).count() == 123
    got = ordered(bootstrap.scenario_summary(spark.createDataFrame([(1, 10.0)], "k int, initial double")), "scenario")
    for (title, _, days, path), row in zip(sorted(bootstrap.SCENARIOS.values()), got.itertuples()):
        e = np.cumprod(1 + np.array(path))
        peak = np.maximum.accumulate(e)
        assert (row.scenario, row.duration_days) == (title, days)
        assert row.max_drawdown_pct == round(((e - peak) / peak).min() * 100, 2)
        assert row.final_value == pytest.approx(10 * e[-1], abs=1e-4)


# -- scalars -----------------------------------------------------------------------------------------------
def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_costs_and_sizes(spark):
    price, cash = F.lit(100.0), F.lit(10_000.0)
    assert one(spark, X.execution_price(price, F.lit("BUY"), 0.005))[0] == pytest.approx(100.5)
    assert one(spark, X.execution_price(price, F.lit("SELL"), 0.005))[0] == pytest.approx(99.5)
    assert one(spark, X.commission(cash, 0.001))[0] == pytest.approx(10)
    sizes = one(
        spark,
        X.position_size(price, cash, "fixed_capital", allocation=0.10),
        X.position_size(price, F.lit(100_000.0), "fixed_shares", shares=50),
        X.position_size(price, F.lit(500.0), "fixed_shares", shares=100),
        X.position_size(price, cash, "kelly", win_rate=0.6, avg_win=0.03, avg_loss=0.02),
        X.position_size(F.lit(0.0), cash), X.position_size(F.lit(-10.0), cash),
    )
    assert list(sizes) == [10, 50, 5, 25, 0, 0]


def test_small_helpers(spark):
    day = lambda s: F.to_date(F.lit(s))
    got = one(
        spark,
        X.business_days(day("2024-01-05"), day("2024-01-08")),
        X.business_days(day("2024-01-06"), day("2024-01-07")),
        X.business_days(day("2024-01-08"), day("2024-01-05")),
        X.percent_text(F.lit(0.1523)), X.currency_text(F.lit(10543.7)),
        X.safe_division(F.lit(1.0), F.lit(0.0), 7.0), X.safe_division(F.lit(1.0), F.lit(4.0)),
        X.rate_ulcer(F.lit(5.0)), X.rate_omega(F.lit(2.0)), X.rate_tail(F.lit(1.0)),
        X.rate_stress_drawdown(F.lit(-15.0)),
    )
    assert list(got) == [2, 0, 0, "15.23%", "$10,543.70", 7.0, 0.25, "moderate", "good", "left-skewed", "yellow"]


# -- the catalogue ------------------------------------------------------------------------------------------
def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_price_text_in_the_trade_log(bars):
    trades, _ = experiments.backtest(SMA.signals(bars, S, short_window=5, long_window=20), S)
    assert views.trade_log(trades, S).first().price_text.startswith("$")


def plan_size(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_grids_have_one_plan_size(bars):
    """Fifty sets are no larger a plan than five, and give what each set gives alone."""
    for name, few, many in (
        ("RSI Reversion", {"window": [5, 9, 14, 20, 30]}, {"window": [3, 5, 9, 14, 20, 21, 25, 28, 29, 30], "overbought": [60, 65, 70, 75, 80]}),
        ("MACD", {"fast": [5, 8, 10, 12, 13]}, {"fast": [3, 5, 8, 10, 12], "slow": [20, 26, 30, 35, 40], "signal": [5, 9]}),
    ):
        strategy = STRATEGIES[name]
        plans = [experiments.grid_signals(bars, S, strategy, experiments.parameter_sets(g)) for g in (few, many)]
        assert plan_size(plans[0]) == plan_size(plans[1])
        sets = experiments.parameter_sets(many)
        assert len(sets) == 50
        found = plans[1].toPandas()
        for i in (0, 17, 49):
            alone = ordered(strategy.signals(bars, S, **sets[i]).select("ticker", "date", "signal"))
            mine = found[found.run_id == i].sort_values(["ticker", "date"], ignore_index=True)
            assert len(mine) == len(alone) and (mine.signal.to_numpy() != alone.signal.to_numpy()).mean() < 1e-3


def test_bad_sets_are_kept_but_never_best(bars):
    grid = {"window": [0, -1, 2.5, "x", None, 14, 10_000], "oversold": [30]}
    got = experiments.grid_search(bars, S, STRATEGIES["RSI Reversion"], grid)
    rows = {(r.ticker, r.run_id): r for r in got.collect()}
    assert len(rows) == 3 * 7
    for (_, i), r in rows.items():
        assert (r.error is not None) == (i < 5)
        if r.error:
            assert r.value == 0 and r.sharpe_ratio is None and "window" in r.error
    assert rows["A", 6].total_trades == 0 and rows["A", 6].value == 0
    assert all(r.run_id >= 5 for r in experiments.best_run(got, S, ["window"]).collect())
    worst = experiments.grid_search(bars, S, STRATEGIES["MACD"], {"speed": [1]})
    assert {r.error for r in worst.collect()} == {"speed is no parameter"} and experiments.best_run(worst, S, []).count() == 0


# -- tasks --------------------------------------------------------------------------------------------
def most_rows(df) -> int:
    """Rows of the largest partition."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_a_task_gets_a_bounded_number_of_bars(spark, tmp_path, monkeypatch):
    """Left to adaptive execution, small rows of any number share a task up to 64 MB."""
    lines = spark.range(20_000).select(
        (F.col("id") % 200).alias("l_suppkey"), F.expr("timestamp_seconds(id div 200 * 86400)").alias("l_shipdate"),
        F.lit(0.05).alias("l_discount"), F.lit(0.04).alias("l_tax"), F.lit(1.0).alias("l_quantity"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = sample_bars.walk_bars(spark, str(tmp_path)).orderBy("ticker", "date").collect()
    monkeypatch.setattr(series, "ROWS_PER_TASK", 500)
    bars = sample_bars.walk_bars(spark, str(tmp_path))
    assert bars.orderBy("ticker", "date").collect() == whole and len(whole) == 20_000
    assert most_rows(bars) < 2_500 and most_rows(multi_factor(bars, S)) < 2_500


def test_a_task_gets_a_bounded_number_of_rows_of_the_curves(spark, monkeypatch):
    bars = spark.range(4_000).select(
        (F.col("id") % 80).alias("ticker"), F.expr("date_from_unix_date(int(id div 80))").alias("date"),
        *((100.0 + F.sin("id")).alias(c) for c in ("open", "high", "low", "close")), F.lit(1.0).alias("volume"),
    )
    grid = {"short_window": [2, 3], "long_window": [5, 7]}
    runs, names = S.within("run_id"), ("SMA Crossover", "RSI Reversion", "Buy & Hold")
    whole = experiments.grid_search(bars, S, SMA, grid).orderBy("ticker", "run_id").collect()
    seen, equity = [], ledger.equity

    def kept(*args, **kwargs):
        seen.append(equity(*args, **kwargs))
        return seen[-1]

    monkeypatch.setattr(ledger, "equity", kept)
    monkeypatch.setattr(ledger, "CURVE_ROWS", 400)
    got = experiments.grid_search(bars, S, SMA, grid).orderBy("ticker", "run_id").collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in whole] and len(got) == 4 * 80
    curve = experiments.compare_strategies(bars, S, names=names)["equity"]
    assert curve.count() == 3 * 4_000 and set(runs.keys) <= set(seen[0].columns)
    assert len(seen) == 2 and all(most_rows(df) < 2_000 for df in seen)
