import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from conftest import ordered, prices
from pyspark.sql import functions as F

from barloom import Series
from barloom.operators import clean
from barloom.sources import bars as B
from barloom.sources.store import BarStore, absent_rows, bars_asked_for, failed_tickers, first_per_date, interior_gaps, merged_requests, missing_ranges, prepare

S = Series("ticker")


@pytest.fixture
def dirty(spark, bars_pdf):
    pdf = bars_pdf[bars_pdf["ticker"] == "C"].copy().reset_index(drop=True)
    pdf.loc[5:9, "close"] = None
    pdf.loc[0:1, "open"] = None
    pdf.loc[10, ["high", "low"]] = pdf.loc[10, ["low", "high"]].to_numpy()
    pdf.loc[20, "close"] = pdf.loc[20, "high"] + 50
    pdf.loc[15, "volume"] = -100
    rows = pdf.astype(object).where(pdf.notna(), None)
    ddl = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double"
    return spark.createDataFrame([tuple(r) for r in rows.itertuples(index=False)], ddl), pdf


def test_clean(dirty):
    df, pdf = dirty
    got = ordered(clean.clean(df, S))
    assert not got[["open", "high", "low", "close", "volume"]].isna().any().any()
    assert (got["high"] >= got["low"]).all() and (got["volume"] >= 0).all()
    assert ((got["close"] <= got["high"]) & (got["close"] >= got["low"])).all()
    assert got["open"].iloc[0] == pytest.approx(pdf["open"].iloc[2])
    # The carried close is clamped to the bars it is carried into.
    want = np.clip(pdf["close"].iloc[4], pdf["low"].iloc[6], pdf["high"].iloc[6])
    assert got["close"].iloc[6] == pytest.approx(want)


def test_quality_report(dirty):
    row = clean.quality_report(dirty[0], S).first()
    assert (row.null_close, row.null_open, row.inverted, row.negative_volume) == (5, 2, 1, 1)
    assert row.volume_suspect is False


def test_history_gate(spark, bars):
    assert clean.clean(bars.limit(5), S).count() == 0
    assert {r.ticker for r in clean.too_short(bars, S, 100).collect()} == {"C"}
    assert clean.require_history(bars, S).count() == bars.count()
    with pytest.raises(Exception, match="need 100"):
        clean.require_history(bars, S, 100).collect()


def test_missing_columns(bars):
    assert clean.missing_columns(bars.drop("volume")) == ["volume"]


def test_normalise(spark):
    raw = spark.createDataFrame(
        [("2022-01-03", 1.0, 2.0, 0.5, float("nan"), 7)], ["Date", "Open", "High|X", "Low", "Close", "Volume"]
    )
    row = B.normalise(raw).first()
    assert (row.date, row.high, row.close, row.adj_close, row.volume) == (dt.date(2022, 1, 3), 2.0, None, None, 7.0)


def test_read_landed_csv(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2022-01-03,1,2,0.5,1.5,1.4,10\n")
    row = B.read_landed(spark, str(path), "csv", header="true").first()
    assert (row.close, row.adj_close, row.volume) == (1.5, 1.4, 10.0)


def test_scan_is_inclusive_and_pushed_down(spark, bars, tmp_path):
    path = str(tmp_path / "bars")
    bars.write.parquet(path)
    df = B.scan(spark.read.parquet(path), "A", "2015-02-02", "2015-02-10", ["date", "close"])
    got = ordered(df, "date")["date"]
    assert (got.min(), got.max()) == (dt.date(2015, 2, 2), dt.date(2015, 2, 10))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "EqualTo(ticker" in plan
    assert "volume" not in plan.split("ReadSchema")[1]


def test_benchmark(spark):
    df = prices(spark, [100, 110, 121])
    assert [round(r.ret, 9) for r in B.returns(df, S).collect()] == [0.1, 0.1]
    got = ordered(B.benchmark_equity(df, S))
    assert got["benchmark_equity"].round(6).tolist() == [11000, 12100]


def store_of(spark, tmp_path):
    return BarStore(spark, str(tmp_path / "store"))


def day(i):
    return dt.date(2022, 1, 3) + dt.timedelta(days=i)


def small(spark, rows):
    return spark.createDataFrame(
        [(t, day(i), c, c, c, c, 1.0, n) for n, (t, i, c) in enumerate(rows)],
        "ticker string, date date, open double, high double, low double, close double, volume double, seq bigint",
    )


def closes(store, **k):
    return {(r.ticker, r.date.date()): r.close for r in store.load(**k).collect()}


def test_insert_keeps_the_first_write(spark, tmp_path):
    store = store_of(spark, tmp_path)
    assert store.read().count() == 0
    assert store.insert_absent(small(spark, [("aa", 0, 1.0), ("aa", 0, 2.0), ("aa", 1, 3.0)])) == 2
    assert store.insert_absent(small(spark, [("AA", 1, 9.0), ("AA", 2, 4.0), ("bb", 0, 5.0)])) == 2
    assert closes(store) == {("AA", day(0)): 1.0, ("AA", day(1)): 3.0, ("AA", day(2)): 4.0, ("BB", day(0)): 5.0}
    assert store.load().first().adj_close is not None


def test_upsert_keeps_the_last_write_and_other_tickers(spark, tmp_path):
    store = store_of(spark, tmp_path)
    store.insert_absent(small(spark, [("A", 0, 1.0), ("A", 1, 2.0), ("B", 0, 7.0)]))
    store.insert_absent(small(spark, [("A", 0, 50.0)]), interval="1h")
    assert store.upsert(small(spark, [("a", 1, 8.0), ("a", 1, 9.0), ("a", 2, 3.0)])) == 3
    assert closes(store, interval="1d") == {
        ("A", day(0)): 1.0, ("A", day(1)): 9.0, ("A", day(2)): 3.0, ("B", day(0)): 7.0,
    }
    assert closes(store, interval="1h") == {("A", day(0)): 50.0}
    assert store.upsert(small(spark, [])) == 0


def test_store_reads(spark, tmp_path):
    store = store_of(spark, tmp_path)
    store.insert_absent(small(spark, [("A", i, float(i)) for i in range(10)] + [("B", 3, 1.0)]))
    assert store.row_count("a") == 10 and store.row_count("none") == 0
    assert [r.ticker for r in store.tickers().collect()] == ["A", "B"]
    assert len(closes(store, ticker="A", start=str(day(2)), end=str(day(4)))) == 3
    assert store.load("A", columns=["close"]).columns == ["close"]
    a = {r.ticker: r for r in store.date_range().collect()}["A"]
    assert (a.first_date.date(), a.last_date.date()) == (day(0), day(9))
    stats = {(r.ticker, r.interval): r for r in store.statistics().collect()}
    assert stats["A", "1d"].rows == 10 and stats[None, None].rows == 11
    assert stats[None, None].files == stats["A", "1d"].files + stats["B", "1d"].files
    plan = store.load("A", start=str(day(2)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(interval" in plan and "GreaterThanOrEqual(date" in plan


def requests(spark, *rows):
    return spark.createDataFrame([(t, day(a), day(b)) for t, a, b in rows], "ticker string, start date, end date")


def test_missing_ranges(spark):
    stored = small(spark, [("A", i, 1.0) for i in range(10, 30)])
    asked = requests(spark, ("A", 12, 32), ("A", 12, 33), ("A", 5, 20), ("A", 5, 40), ("A", 28, 29), ("N", 1, 2))
    got = {(r.ticker, r.gap_start, r.gap_end, r.whole_request) for r in missing_ranges(stored, asked).collect()}
    assert got == {
        ("A", day(30), day(33), False),
        ("A", day(5), day(9), False),
        ("A", day(30), day(40), False),
        ("N", day(1), day(2), True),
    }


def test_ingest_fills_gaps_once(spark, tmp_path):
    store = store_of(spark, tmp_path)
    source = small(spark, [(t, i, float(i + 1)) for t in ("A", "B") for i in range(60)])
    store.insert_absent(source.where(F.col("ticker") == "A").where(F.col("date") < F.lit(day(30))))
    asked = requests(spark, ("A", 0, 49), ("B", 10, 59), ("C", 0, 9))
    got = store.ingest(source, asked)
    counts = {r.ticker: r["count"] for r in got.groupBy("ticker").count().collect()}
    assert counts == {"A": 50, "B": 50}
    assert store.read().count() == 100
    store.ingest(source, asked)
    assert store.read().count() == 100
    assert [r.ticker for r in failed_tickers(asked, store.read()).collect()] == ["C"]


def test_gaps_of_requests_inside_a_hole_and_several_per_ticker(spark):
    dates = [f"2020-01-{d:02d}" for d in range(1, 21)] + [f"2020-06-{d:02d}" for d in range(1, 21)]
    bars = spark.createDataFrame([("A", d) for d in dates], "ticker string, date string").withColumn("date", F.to_date("date"))
    asked = [("A", "2020-03-01", "2020-03-10"), ("A", "2020-01-02", "2020-01-18"), ("A", "2019-12-01", "2020-01-05"), ("A", "2020-06-15", "2020-07-30"), ("B", "2020-01-01", "2020-01-02")]
    requests = spark.createDataFrame(asked, "ticker string, start string, end string").selectExpr("ticker", "CAST(start AS date) AS start", "CAST(end AS date) AS end")
    got = sorted((r.ticker, str(r.gap_start), str(r.gap_end), r.whole_request) for r in missing_ranges(bars, requests).collect())
    assert got == [
        ("A", "2019-12-01", "2019-12-31", False), ("A", "2020-03-01", "2020-03-10", False), ("A", "2020-06-21", "2020-07-30", False), ("B", "2020-01-01", "2020-01-02", True)]


def test_filling_long_series_takes_linear_time(spark):
    bars = spark.range(100_000).selectExpr(
        "'A' AS ticker", "CAST(id AS int) AS date", "IF(id < 10 OR id % 7 = 0, NULL, CAST(id AS double)) AS close", "1.0D AS open", "1.0D AS high", "1.0D AS low", "1.0D AS volume")
    began = time.perf_counter()
    got = clean.fill_gaps(bars, Series("ticker")).orderBy("date").select("close").limit(20).collect()
    assert [r.close for r in got[:15]] == [10.0] * 11 + [11.0, 12.0, 13.0, 13.0]
    assert time.perf_counter() - began < 60


def test_upsert_rewrites_only_the_pieces_it_touches(spark, tmp_path):
    rows = [("A", i, float(i)) for i in range(0, 3650, 5)] + [("B", 0, 1.0)]
    for pieces in ("month", "year"):
        path = tmp_path / pieces
        store = BarStore(spark, str(path), daily_pieces=pieces)
        store.insert_absent(small(spark, rows))
        before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
        assert store.upsert(small(spark, [("A", 1000, -1.0), ("A", 1001, -2.0)])) == 731
        after = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
        changed = {f.parent.name for f in before.items() ^ after.items() for f in [f[0]]}
        assert changed == {f"piece={day(1000).strftime('%Y-%m-01' if pieces == 'month' else '%Y-01-01')}"}
        got = closes(store, ticker="A")
        assert got == {**{("A", day(i)): c for t, i, c in rows if t == "A"}, ("A", day(1000)): -1.0, ("A", day(1001)): -2.0}
        some = closes(store, ticker="A", start=str(day(700)), end=str(day(1200)))
        assert some == {k: c for k, c in got.items() if day(700) <= k[1] <= day(1200)}
        plan = store.load("A", start=str(day(700)), end=str(day(1200)))._jdf.queryExecution().executedPlan().toString()
        assert "piece" in plan.split("PartitionFilters")[1].split("]")[0]


def test_bars_asked_for_are_given_once(spark):
    import random

    rng = random.Random(5)
    bars = small(spark, [(t, i, float(i)) for t in "AB" for i in range(0, 400, 3)]).drop("seq").withColumn("extra", F.lit("x"))
    asked = [(rng.choice("ABC"), a, a + rng.randrange(-5, 60)) for a in (rng.randrange(-30, 420) for _ in range(25))]
    asked += asked[:3]
    given = requests(spark, *asked).unionByName(spark.createDataFrame([("A", None, day(9)), (None, day(0), day(9))], "ticker string, start date, end date"))
    want = sorted((t, day(i)) for t in "AB" for i in range(0, 400, 3) if any(u == t and a <= i <= b for u, a, b in asked))
    got = bars_asked_for(bars, given)
    assert got.columns == bars.columns
    assert sorted((r.ticker, r.date) for r in got.collect()) == want
    merged = sorted((r.ticker, r.start, r.end) for r in merged_requests(given).collect())
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(merged, merged[1:]))
    assert bars_asked_for(bars.limit(0), given).count() == 0 and bars_asked_for(bars, given.limit(0)).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Join Inner" not in plan


def test_hour_bars_are_asked_for_to_the_minute(spark):
    bars = spark.range(24 * 70).selectExpr("'A' AS ticker", "TIMESTAMP_NTZ'2022-01-30 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS int)) AS date")
    asked = spark.sql("SELECT 'A' AS ticker, TIMESTAMP_NTZ'2022-01-31 22:00:00' AS start, TIMESTAMP_NTZ'2022-03-01 01:30:00' AS end")
    got = [r.date for r in bars_asked_for(bars, asked).orderBy("date").collect()]
    assert (got[0], got[-1], len(got)) == (dt.datetime(2022, 1, 31, 22), dt.datetime(2022, 3, 1, 1), 28 * 24 + 4)


def test_interior_gaps(spark):
    dates = ["2022-01-03", "2022-01-04", "2022-01-07", "2022-01-10", "2022-01-14", "2022-01-18", "2022-01-22", "2022-01-31"]
    bars = spark.createDataFrame([("A", d) for d in [*dates, dates[0]]] + [("B", "2022-01-03"), ("B", None)], "ticker string, date string")
    got = sorted((str(r.gap_start), str(r.gap_end), r.days) for r in interior_gaps(bars).collect())
    assert got == [("2022-01-05", "2022-01-06", 2), ("2022-01-11", "2022-01-13", 3), ("2022-01-17", "2022-01-17", 1),
                   ("2022-01-19", "2022-01-21", 3), ("2022-01-24", "2022-01-28", 5)]


def test_files_do_not_grow_with_tickers(spark, tmp_path):
    store = store_of(spark, tmp_path)
    names = [f"T{i}" for i in range(300)]
    assert store.insert_absent(small(spark, [(t, i, 1.0 + i) for t in names for i in (0, 1)] + [(None, 0, 5.0)])) == 601
    assert len(list(tmp_path.rglob("*.parquet"))) <= 64
    assert closes(store, ticker=["t7", "none"]) == {("T7", day(0)): 1.0, ("T7", day(1)): 2.0}
    stats = {r.ticker: r for r in store.statistics().where("interval IS NOT NULL").collect()}
    assert {stats[t].rows for t in names} == {2} and stats[None].rows == 1
    total = store.statistics().where("interval IS NULL").first()
    assert total.rows == 601 and total.files == len(list(tmp_path.rglob("*.parquet")))
    # Tickers of one bucket keep their rows when another's are replaced, and are not counted.
    assert store.upsert(small(spark, [("T7", 1, 9.0), ("NEW", 0, 4.0)])) == 3
    got = closes(store, ticker=[*names, "NEW"])
    assert len(got) == 601 and got["T7", day(1)] == 9.0 and got["T8", day(1)] == 2.0
    assert store.read().count() == 602 and not list(tmp_path.rglob("_staging/*"))


def test_keys_and_months_are_not_sent_through_the_driver(spark):
    bars = small(spark, [("A", i, 1.0) for i in range(40)])
    rows = absent_rows(first_per_date(prepare(bars.where("date < '2022-01-20'"))), prepare(bars))
    assert rows.count() == 40 - 17
    assert "SortMergeJoin" in rows._jdf.queryExecution().executedPlan().toString()
    asked = spark.sql("SELECT 'A' AS ticker, DATE'1950-01-01' AS start, DATE'2022-01-10' AS end")
    got = bars_asked_for(bars, asked)
    assert got.count() == 8
    semi = got._jdf.queryExecution().optimizedPlan().toString().split("Join LeftSemi")[1].split("Generate")[0]
    assert "_month" not in semi.split("\n")[0] and "min(start" in semi


def test_upsert_replaces_the_nameless_rows_of_a_piece_together(spark, tmp_path):
    store = store_of(spark, tmp_path)
    store.insert_absent(small(spark, [(None, 0, 1.0), (None, 400, 2.0), ("A", 0, 3.0)]))
    store.upsert(small(spark, [(None, 1, 4.0), ("A", 1, 5.0)]))
    assert sorted(r.close for r in store.load().collect()) == [2.0, 3.0, 4.0, 5.0]
