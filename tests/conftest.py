import numpy as np
import pandas as pd
import pytest

from barloom import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def walk(ticker: str, n: int, seed: int, step: float = 0.02) -> pd.DataFrame:
    """Daily bars cut from eight ticks a day of a logarithmic walk that is pulled back to its start."""
    rng = np.random.default_rng(seed)
    level, ticks = 0.0, []
    for shock in rng.standard_t(5, 8 * n) * step / 4:
        level += shock - 0.002 * level
        ticks.append(level)
    day = 80 * np.exp(np.array(ticks).reshape(n, 8))
    return pd.DataFrame(
        {
            "ticker": ticker,
            "date": pd.bdate_range("2015-01-01", periods=n).date,
            "open": day[:, 0], "high": day.max(1), "low": day.min(1), "close": day[:, -1], "adj_close": day[:, -1],
            "volume": np.round(1e6 * np.exp(rng.normal(0, 0.7, n))),
        }
    )


@pytest.fixture(scope="session")
def bars_pdf():
    return pd.concat([walk("A", 700, 1), walk("B", 1300, 2), walk("C", 60, 3)], ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    df = spark.createDataFrame(bars_pdf).repartition(3, "close").persist()
    yield df
    df.unpersist()


def prices(spark, values, ticker="X", **columns):
    """Bars with the given closes; the other prices follow them unless given."""
    close = np.asarray(values, dtype=float)
    pdf = pd.DataFrame(
        {
            "ticker": ticker,
            "date": pd.bdate_range("2022-01-03", periods=len(close)).date,
            "open": close, "high": close * 1.01, "low": close * 0.99, "close": close,
            "adj_close": close, "volume": 1e6, **columns,
        }
    )
    return spark.createDataFrame(pdf)


def ordered(df, *by):
    return df.toPandas().sort_values(list(by) or ["ticker", "date"], ignore_index=True)
