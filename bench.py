"""Headline workloads on local[$BENCH_CPUS] over $BENCH_SF_DIR; one JSON line on stdout.

Every workload writes its full result to a sink that discards it. All workloads run once untimed on the
bars of a smaller scale next to it, where there is one, so that classes are loaded and expressions
compiled; then each is timed once at full scale.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import build_session
from barloom.operators import clean, indicators, ledger, metrics, signals
from barloom.operators.ledger import Rules
from barloom.operators.signals import STRATEGIES
from barloom.operators.stops import StopRules, trades_with_stops
from barloom.plans import bootstrap, experiments
from barloom.sources import sample_bars as D
from barloom.sources.sample_bars import TICKER

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SMA = {"short_window": 5, "long_window": 20}
# 50 pairs of windows.
GRID = {"short_window": [3, 5, 8, 10, 12, 15, 18, 20, 25, 30], "long_window": [40, 50, 60, 100, 150]}


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def workloads(spark, sf_dir: str) -> dict:
    bars = D.walk_bars(spark, sf_dir)
    sma = STRATEGIES["SMA Crossover"]

    def all_indicators():
        df = indicators.with_bands(bars, TICKER)
        df = indicators.with_rsi(df, TICKER)
        df = indicators.with_macd(df, TICKER)
        df = indicators.with_atr(df, TICKER)
        return indicators.with_regime(df, TICKER)

    def backtest(rules=Rules()):
        return experiments.backtest(sma.signals(bars, TICKER, **SMA), TICKER, rules, marks=bars)

    def perf():
        trades, curve = backtest(Rules(allow_short=True))
        return metrics.all_metrics(curve, trades, TICKER)

    def risk():
        _, curve = backtest()
        return metrics.all_risk(curve, TICKER, D.market_returns(spark, sf_dir))

    def stop_ledger():
        found = sma.signals(bars, TICKER, **SMA)
        rules = StopRules(circuit_breaker=True)
        return trades_with_stops(found, TICKER, Rules(allow_short=True), rules)

    def projection():
        market = D.market_returns(spark, sf_dir).selectExpr("'market' AS ticker", "date", "bench_ret AS ret")
        return bootstrap.fan(bootstrap.simulate(market, TICKER, 1000, 252), "ticker")

    def cleaned():
        damaged = bars.withColumn("close", F.when(F.dayofmonth("date") % 7 == 0, None).otherwise(F.col("close")))
        return clean.clean(damaged, TICKER)

    return {
        "bars": lambda: bars,
        "clean": cleaned,
        "indicators": all_indicators,
        "multi_factor": lambda: signals.multi_factor(bars, TICKER),
        "ledger": lambda: ledger.trades(sma.signals(bars, TICKER, **SMA), TICKER),
        "equity": lambda: backtest()[1],
        "ledger_stops": stop_ledger,
        "metrics": perf,
        "risk": risk,
        "walk_forward": lambda: experiments.walk_forward(bars, TICKER, sma, **SMA),
        "grid_50": lambda: experiments.grid_search(bars, TICKER, sma, GRID),
        "compare_7": lambda: experiments.compare_strategies(bars, TICKER)["results"],
        "bootstrap_1000x252": projection,
    }


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        # Local data is small: keep every core busy instead of filling partitions.
        spark__sql__adaptive__coalescePartitions__minPartitionSize="64k",
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = workloads(spark, SF_DIR)
    wanted = sys.argv[1:] or list(jobs)
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.01")
    for name, job in workloads(spark, small if os.path.isdir(small) else SF_DIR).items():
        if name in wanted:
            run(job())
    times = {}
    for name in wanted:
        start = time.perf_counter()
        run(jobs[name]())
        times[name] = round(time.perf_counter() - start, 3)

    if "scan" in wanted or not sys.argv[1:]:
        # A year of a table of bars sorted by date: row groups are pruned.
        path = os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), f"bench-bars-{os.getpid()}")
        D.walk_bars(spark, SF_DIR).sort("date").write.mode("overwrite").parquet(path)
        start = time.perf_counter()
        run(spark.read.parquet(path).where("date BETWEEN '1996-01-01' AND '1996-12-31'").select("ticker", "date", "close"))
        times["scan"] = round(time.perf_counter() - start, 3)
        shutil.rmtree(path)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
