"""The same results in plain SQL: averages and ledgers by recursion over the bar number, where the
Spark side uses windows and folds."""

from __future__ import annotations

from barloom.operators.clean import MIN_ROWS
from barloom.plans.bootstrap import SCENARIOS
from verification.queries import FAST_MOMENTUM, GRID, HORIZON, RSI_GRID, SEED, SHORT_SMA, SIMS

ORACLES: dict[str, str] = {}


def r(x: str, n: int) -> str:
    """Round; adding zero turns -0.0 into 0.0."""
    return f"(round({x}, {n}) + 0.0::double)"


def rs(names: str, n: int) -> str:
    return ", ".join(f"{r(c, n)} AS {c}" for c in names.split())


def sql(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


W = "PARTITION BY ticker ORDER BY date"
UPTO = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def last(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def mean(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {last(n)} = {n} THEN avg({c}) OVER {last(n)} END"


def std(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {last(n)} = {n} THEN stddev_samp({c}) OVER {last(n)} END"


MOVES = """moves AS MATERIALIZED (
  SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date,
         (sum(floor(l_discount * 100 + 0.5::double)) / (count(*) * 100.0::double) - 0.05::double) * 0.4::double AS move,
         (sum(floor(l_tax * 100 + 0.5::double)) / (count(*) * 100.0::double) - 0.04::double) * 0.1::double AS gap,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""
BARS = f"""walk AS MATERIALIZED (
  SELECT ticker, date, volume,
         100.0::double * exp(sum(ln(1 + move)) OVER {UPTO}) AS close,
         100.0::double * exp(coalesce(sum(ln(1 + move)) OVER
           ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * (1 + gap) AS open
  FROM moves),
bars AS MATERIALIZED (
  SELECT ticker, date, open, greatest(open, close) * 1.005::double AS high,
         least(open, close) * 0.995::double AS low, close, close AS adj_close, volume,
         row_number() OVER ({W}) AS rn
  FROM walk)"""
RAW = """raw AS MATERIALIZED (
  SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date,
         arg_min(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""

# -- bars and storage ----------------------------------------------------------------------------
ORACLES["bars_resample"] = sql(
    RAW, select="SELECT ticker, date, open, high, low, close, close AS adj_close, volume FROM raw"
)
ORACLES["bars_walk"] = sql(
    MOVES, BARS, select=f"SELECT ticker, date, {rs('open high low close adj_close', 6)}, volume FROM bars"
)
ORACLES["bars_normalise"] = """
SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS open,
       l_extendedprice * 2 AS high, l_quantity AS low,
       CASE WHEN l_linenumber <> 1 THEN l_extendedprice END AS close,
       l_linenumber::double AS volume,
       CASE WHEN l_linenumber <> 1 THEN l_extendedprice END AS adj_close
FROM lineitem"""
ORACLES["bars_range_scan"] = sql(
    RAW,
    select="SELECT ticker, date, close, volume FROM raw "
    "WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'",
)
ORACLES["store_range_scan"] = sql(
    RAW,
    select="SELECT ticker::varchar AS ticker, date, close, volume::double AS volume FROM raw "
    "WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'",
)
ORACLES["store_statistics"] = sql(
    RAW,
    select="SELECT ticker::varchar AS ticker, '1d' AS interval, count(*) AS n_rows FROM raw GROUP BY 1 "
    "UNION ALL SELECT NULL, NULL, count(*) FROM raw",
)
ORACLES["bars_coverage"] = """
SELECT l_suppkey AS ticker, min(CAST(l_shipdate AS DATE)) AS first_date,
       max(CAST(l_shipdate AS DATE)) AS last_date, count(DISTINCT CAST(l_shipdate AS DATE)) AS bars
FROM lineitem GROUP BY 1"""
ORACLES["bars_tickers"] = "SELECT DISTINCT l_suppkey AS ticker FROM lineitem"

REQUESTS = """requests AS (
  SELECT c_custkey::varchar AS ticker, CAST(DATE '1994-06-01' + (c_custkey % 5 * 200)::int AS DATE) AS s,
         CAST(DATE '1998-01-01' + (c_custkey % 7 * 500)::int AS DATE) AS e FROM customer
  UNION ALL SELECT c_custkey::varchar, DATE '1996-03-01', CAST(DATE '1996-03-01' + (c_custkey % 3)::int AS DATE) FROM customer)"""
DAYS = """days AS (SELECT DISTINCT l_suppkey::varchar AS ticker, CAST(l_shipdate AS DATE) AS date FROM lineitem)"""


def todo(days: str, name: str) -> str:
    """What is stored of each request, by a table of ticker and date."""
    return f"""{name} AS MATERIALIZED (SELECT *, a <= s AND b >= e - 3 AND hits > 10 AS served FROM (
  SELECT q.ticker, q.s, q.e, a, b, count(d.date) AS hits
  FROM requests q LEFT JOIN (SELECT ticker, min(date) AS a, max(date) AS b FROM {days} GROUP BY 1) USING (ticker)
  LEFT JOIN {days} d ON d.ticker = q.ticker AND d.date BETWEEN q.s AND q.e
  GROUP BY ALL))"""


def missing(name: str) -> str:
    return f"""SELECT ticker, s AS gap_start, e AS gap_end, true AS whole_request FROM {name} WHERE a IS NULL
UNION ALL SELECT ticker, s, e, false FROM {name} WHERE a IS NOT NULL AND hits = 0
UNION ALL SELECT ticker, s, CAST(a - 1 AS DATE), false FROM {name} WHERE NOT served AND hits > 0 AND s < a
UNION ALL SELECT ticker, CAST(b + 1 AS DATE), e, false FROM {name} WHERE NOT served AND hits > 0 AND e > b"""


ORACLES["bars_gaps"] = sql(REQUESTS, DAYS, todo("days", "todo"), select=missing("todo"))
# The bars need no cleaning but for the least number of rows.
INGEST = (
    RAW, REQUESTS,
    "source AS MATERIALIZED (SELECT * REPLACE (ticker::varchar AS ticker) FROM raw)",
    "before AS MATERIALIZED (SELECT * FROM source WHERE ticker::int % 2 = 0 AND date < DATE '1996-07-01')",
    todo("before", "todo"),
    f"gaps AS ({missing('todo')})",
    "found AS (SELECT DISTINCT r.*, whole_request FROM source r JOIN gaps g ON r.ticker = g.ticker AND r.date BETWEEN gap_start AND gap_end)",
    f"""after AS MATERIALIZED (
  SELECT * FROM before UNION SELECT * EXCLUDE whole_request FROM found
  WHERE NOT whole_request OR ticker IN (SELECT ticker FROM found GROUP BY 1 HAVING count(*) >= {MIN_ROWS}))""",
)
ORACLES["store_ingest_rows"] = sql(
    *INGEST,
    select=f"""SELECT ticker, date, open, high, low, close, volume::double AS volume FROM after f
WHERE EXISTS (SELECT 1 FROM requests q WHERE q.ticker = f.ticker AND f.date BETWEEN s AND e)
QUALIFY count(*) OVER (PARTITION BY ticker) >= {MIN_ROWS}""",
)
ORACLES["store_ingest_gaps"] = sql(*INGEST, todo("after", "still"), select=missing("still"))
ORACLES["bars_interior_gaps"] = """
WITH days AS (SELECT DISTINCT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date FROM lineitem),
pairs AS (SELECT ticker, date, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS next FROM days)
SELECT ticker, CAST(min(day) AS DATE) AS gap_start, CAST(max(day) AS DATE) AS gap_end, count(*) AS days
FROM (SELECT ticker, date, unnest(generate_series(date + 1, next - 1, INTERVAL 1 DAY)) AS day FROM pairs)
WHERE isodow(day) < 6 GROUP BY ticker, date"""
ORACLES["ingest_failed_tickers"] = """
SELECT c_custkey::varchar AS ticker FROM customer
WHERE c_custkey NOT IN (SELECT l_suppkey FROM lineitem)"""

ARRIVALS = """arrivals AS (
  SELECT '1d' AS interval, l_suppkey::varchar AS ticker, l_shipdate::timestamp AS date,
         l_extendedprice AS open, l_extendedprice * 2 AS high, l_extendedprice / 2 AS low,
         l_extendedprice AS close, l_extendedprice AS adj_close, l_quantity AS volume, l_returnflag,
         row_number() OVER (PARTITION BY l_suppkey, l_shipdate
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq
  FROM lineitem)"""
COLS = "interval, ticker, date, open, high, low, close, adj_close, volume"
ORACLES["bars_insert_first"] = sql(
    ARRIVALS,
    select=f"""SELECT {COLS} FROM arrivals n WHERE l_returnflag <> 'A'
  AND NOT EXISTS (SELECT 1 FROM arrivals o WHERE o.l_returnflag = 'A' AND o.ticker = n.ticker AND o.date = n.date)
QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY seq) = 1""",
)
ORACLES["bars_upsert_last"] = sql(
    ARRIVALS,
    select=f"""SELECT {COLS} FROM arrivals
WHERE ticker IN (SELECT ticker FROM arrivals WHERE l_returnflag <> 'A')
QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY l_returnflag = 'A', seq DESC) = 1""",
)
ORACLES["store_upsert"] = sql(
    ARRIVALS,
    select=f"""SELECT {COLS} FROM arrivals
QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY l_returnflag = 'A',
  CASE WHEN l_returnflag = 'A' THEN seq ELSE -seq END) = 1""",
)
ORACLES["benchmark_returns"] = sql(
    MOVES, BARS,
    select=f"SELECT ticker, date, {r(f'close / lag(close) OVER ({W}) - 1', 8)} AS ret FROM bars QUALIFY row_number() OVER ({W}) > 1",
)
ORACLES["benchmark_equity"] = sql(
    MOVES, BARS,
    select=f"""SELECT ticker, date, {r('product(1 + ret) OVER ' + UPTO + ' * 10000', 4)} AS benchmark_equity
FROM (SELECT ticker, date, close / lag(close) OVER ({W}) - 1 AS ret FROM bars) WHERE ret IS NOT NULL""",
)
MARKET = "market AS (SELECT date, avg(move) AS bench_ret FROM moves GROUP BY 1)"
ORACLES["market_benchmark"] = sql(MOVES, MARKET, select=f"SELECT date, {rs('bench_ret', 8)} FROM market")

# -- cleaning ----------------------------------------------------------------------------------------
DIRTY = """dirty AS MATERIALIZED (
  SELECT ticker, date, rn, CASE WHEN rn > 2 THEN open END AS open,
         CASE WHEN rn % 41 = 0 THEN low ELSE high END AS high,
         CASE WHEN rn % 41 = 0 THEN high ELSE low END AS low,
         CASE WHEN rn % 37 = 0 THEN NULL WHEN rn % 43 = 0 THEN high + 50 ELSE close END AS close, adj_close,
         CASE WHEN rn % 47 = 0 THEN -volume WHEN rn % 53 = 0 THEN 0.0 ELSE volume END AS volume
  FROM bars)"""


def fill(c: str) -> str:
    back = f"first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"coalesce(last_value({c} IGNORE NULLS) OVER {UPTO}, {back}) AS {c}"


ORACLES["clean_bars"] = sql(
    MOVES, BARS, DIRTY,
    f"""filled AS (SELECT ticker, date, adj_close, {', '.join(fill(c) for c in ('open', 'high', 'low', 'close', 'volume'))} FROM dirty),
sane AS (SELECT ticker, date, open, greatest(high, low) AS h, least(high, low) AS l, close, adj_close, volume FROM filled)""",
    select=f"""SELECT ticker, date, {r('open', 6)} AS open, {r('h', 6)} AS high, {r('l', 6)} AS low,
  {r('least(greatest(close, l), h)', 6)} AS close, {r('adj_close', 6)} AS adj_close, greatest(volume, 0.0::double) AS volume
FROM sane QUALIFY count(*) OVER (PARTITION BY ticker) >= 30""",
)
ORACLES["quality_report"] = sql(
    MOVES, BARS, DIRTY,
    select="""SELECT ticker, count(*) AS bars, count(*) - count(open) AS null_open, count(*) - count(high) AS null_high,
  count(*) - count(low) AS null_low, count(*) - count(close) AS null_close, count(*) - count(volume) AS null_volume,
  count(*) FILTER (high < low) AS inverted, count(*) FILTER (volume < 0) AS negative_volume,
  count(*) FILTER (volume <= 0) AS zero_volume,
  count(*) FILTER (volume <= 0) > count(*) * 0.1::double AS volume_suspect FROM dirty GROUP BY 1""",
)
ORACLES["short_histories"] = """
SELECT o_custkey AS ticker, count(DISTINCT CAST(o_orderdate AS DATE)) AS available, 30::bigint AS required
FROM orders GROUP BY 1 HAVING count(DISTINCT CAST(o_orderdate AS DATE)) < 30"""

# -- scalar expressions ---------------------------------------------------------------------------------
LINE = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"
ORACLES["execution_costs"] = f"""
SELECT {LINE}, action, executed, l_extendedprice * 0.001::double AS commission,
       abs(executed - price) * l_quantity AS slippage
FROM (SELECT *, l_extendedprice / l_quantity AS price,
        CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'R' THEN 'SELL' ELSE 'HOLD' END AS action,
        l_extendedprice / l_quantity * CASE l_returnflag WHEN 'A' THEN 1 + 0.0005::double
          WHEN 'R' THEN 1 - 0.0005::double ELSE 1 END AS executed FROM lineitem)"""


def sized(qty: str) -> str:
    return (
        f"CASE WHEN price <= 0 OR cash <= 0 THEN 0.0::double WHEN ({qty}) = 0 AND price <= cash "
        f"THEN 1.0::double ELSE ({qty}) END"
    )


ORACLES["position_sizes"] = f"""
SELECT {LINE}, {sized('floor(cash * 0.95::double / price)')} AS capital95,
  {sized('floor(cash * 0.1::double / price)')} AS capital10,
  {sized('CASE WHEN price * 20 > cash THEN floor(cash / price) ELSE 20.0::double END')} AS shares20,
  {sized('floor(cash * ((0.6::double / 2 - 0.4::double / 3) / 2) / price)')} AS kelly,
  {sized('floor(cash * 0.025::double / price)')} AS kelly_undefined,
  {sized('floor(cash * 0.5::double / price)')} AS unknown
FROM (SELECT *, l_extendedprice / l_quantity AS price,
             l_quantity * 700.0::double * l_linenumber - 2000.0::double AS cash FROM lineitem)"""
ORACLES["business_days"] = f"""
SELECT {LINE}, len(list_filter(generate_series(CAST(l_shipdate AS DATE), CAST(l_shipdate AS DATE) + (l_quantity::int - 3), INTERVAL 1 DAY),
  lambda d: isodow(d) < 6)) AS days FROM lineitem"""
ORACLES["annualised_returns"] = sql(
    MOVES,
    select=f"""SELECT ticker, {r('pow(product(1 + move), 252.0::double / count(*)) - 1', 8)} AS annualised,
  {r('CASE WHEN count(*) FILTER (gap > 0.0035::double) = 0 THEN -1 ELSE sum(gap) / count(*) FILTER (gap > 0.0035::double) END', 8)} AS gap_per_high
FROM moves GROUP BY 1""",
)
ORACLES["formatted_values"] = f"""
SELECT {LINE}, printf('%.2f%%', l_discount * 100) AS discount,
       '$' || format('{{:,.2f}}', l_extendedprice) AS price, 'SMA Crossover (20/50)' AS strategy FROM lineitem"""

# -- indicators ---------------------------------------------------------------------------------------------
ORACLES["moving_averages"] = sql(
    MOVES, BARS,
    select=f"""SELECT ticker, date, {r(mean('close', 20), 6)} AS sma20, {r(mean('close', 200), 6)} AS sma200,
  {r(std('close', 20), 6)} AS std20, {r(mean('volume', 20), 6)} AS volume20,
  {r(f'max(close) OVER {last(14)}', 6)} AS max14, {r(f'close / lag(close) OVER ({W}) - 1', 8)} AS ret,
  {r(f'close / lag(close, 252) OVER ({W}) - 1', 8)} AS momentum, {r(f'close - lag(close) OVER ({W})', 6)} AS move,
  {r('pow(1.0001::double, rn)', 8)} AS grown FROM bars""",
)
# Every exponential average of the default parameters, one row per bar.
EWM = f"""prep AS MATERIALIZED (
  SELECT *, coalesce(greatest(move, 0), 0) AS gain, coalesce(greatest(-move, 0), 0) AS loss,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm,
    CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm
  FROM (SELECT *, close - lag(close) OVER ({W}) AS move, lag(close) OVER ({W}) AS pc,
          high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS down FROM bars)),
ewm AS (
  SELECT ticker, rn, close AS fast, close AS slow, 0.0::double AS sig, gain AS ag, loss AS al, tr AS atr,
         pdm::double AS p, mdm::double AS m, 0.0::double AS adx
  FROM prep WHERE rn = 1
  UNION ALL
  SELECT ticker, rn, fast, slow, (fast - slow) * (2.0::double / 10) + sig * (8.0::double / 10), ag, al, atr, p, m,
         (100 * abs(100 * p / atr - 100 * m / atr) / (100 * p / atr + 100 * m / atr + 1e-10::double) + 13 * adx) / 14
  FROM (SELECT b.ticker, b.rn, (2 * b.close + 11 * e.fast) / 13 AS fast, (2 * b.close + 25 * e.slow) / 27 AS slow,
          e.sig, (b.gain + 13 * e.ag) / 14 AS ag, (b.loss + 13 * e.al) / 14 AS al, (b.tr + 13 * e.atr) / 14 AS atr,
          (b.pdm + 13 * e.p) / 14 AS p, (b.mdm + 13 * e.m) / 14 AS m, e.adx
        FROM ewm e JOIN prep b ON b.ticker = e.ticker AND b.rn = e.rn + 1)),
ind AS MATERIALIZED (
  SELECT b.*, e.fast - e.slow AS macd, e.sig AS macd_signal, e.fast - e.slow - e.sig AS macd_histogram,
         CASE WHEN b.rn >= 14 THEN CASE WHEN e.al = 0 THEN 100 ELSE 100 - 100 / (1 + e.ag / e.al) END END AS rsi,
         CASE WHEN b.rn >= 14 THEN e.atr END AS atr, 100 * e.p / e.atr AS plus_di, 100 * e.m / e.atr AS minus_di, e.adx
  FROM prep b JOIN ewm e USING (ticker, rn))"""
IND = (MOVES, BARS, EWM)
ORACLES["rsi"] = sql(*IND, select=f"SELECT ticker, date, {rs('rsi', 6)} FROM ind")
ORACLES["macd"] = sql(*IND, select=f"SELECT ticker, date, {rs('macd macd_signal macd_histogram', 6)} FROM ind")
ORACLES["atr"] = sql(*IND, select=f"SELECT ticker, date, {r('tr', 6)} AS true_range, {rs('atr', 6)} FROM ind")
ORACLES["adx"] = sql(*IND, select=f"SELECT ticker, date, {rs('plus_di minus_di adx', 6)} FROM ind")
REGIME = f"""rets AS (SELECT *, close / pc - 1 AS ret FROM ind),
vols AS (SELECT *, {std('ret', 20)} * sqrt(252) AS volatility_ann,
  CASE WHEN rn >= 20 THEN regr_slope(close, rn) OVER {last(20)} / avg(close) OVER {last(20)} * 100 END AS price_slope FROM rets),
regime AS MATERIALIZED (SELECT *, CASE WHEN volatility_ann > 0.4::double THEN 'crisis' WHEN adx > 25 THEN 'trending' ELSE 'ranging' END AS regime FROM vols)"""
ORACLES["regimes"] = sql(
    *IND, REGIME,
    select=f"SELECT ticker, date, {rs('close adx volatility_ann price_slope', 6)}, regime FROM regime",
)
ORACLES["regime_counts"] = sql(*IND, REGIME, select="SELECT ticker, regime, count(*) AS days FROM regime GROUP BY 1, 2")
ORACLES["regime_strategies"] = sql(
    *IND, REGIME,
    """fits(regime, strategy) AS (VALUES ('trending', 'SMA Crossover'), ('trending', 'MACD'), ('trending', 'Momentum + MR'),
  ('trending', 'Buy & Hold'), ('ranging', 'RSI Reversion'), ('ranging', 'Bollinger Bands'), ('ranging', 'Multi-Factor'),
  ('crisis', 'Buy & Hold'))""",
    select="SELECT regime, ticker, count(*) AS days, strategy FROM regime JOIN fits USING (regime) GROUP BY ALL",
)


# -- signals --------------------------------------------------------------------------------------------------
def sma_cte(short: int, long: int, source: str = "bars", name: str = "sig", keys: str = "ticker") -> str:
    w = f"PARTITION BY {keys} ORDER BY date ROWS BETWEEN"

    def ma(n: int) -> str:
        frame = f"({w} {n - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN count(*) OVER {frame} = {n} THEN avg(close) OVER {frame} END"

    return f"""{name} AS MATERIALIZED (
  SELECT *, CASE WHEN short_ma - long_ma > 1e-12::double * abs(long_ma) THEN 1 WHEN short_ma - long_ma <= 1e-12::double * abs(long_ma) THEN -1 ELSE 0 END AS signal
  FROM (SELECT *, {ma(short)} AS short_ma, {ma(long)} AS long_ma FROM {source}))"""


SMA = sma_cte(SHORT_SMA["short_window"], SHORT_SMA["long_window"])
BB = f"""bands AS MATERIALIZED (SELECT *, sma + 2 * sd AS upper_band, sma - 2 * sd AS lower_band FROM
  (SELECT *, {mean('close', 20)} AS sma, {std('close', 20)} AS sd FROM bars))"""
SIGNALS = {
    "buy_hold": ((MOVES, BARS), "SELECT *, 1 AS signal FROM bars"),
    "rsi": (IND, "SELECT *, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END AS signal FROM ind"),
    "macd": (
        IND,
        "SELECT *, CASE WHEN macd_histogram > 1e-12::double * abs(close) THEN 1 WHEN macd_histogram < -1e-12::double * abs(close) THEN -1 ELSE 0 END AS signal FROM ind",
    ),
    "bollinger": (
        (MOVES, BARS, BB),
        "SELECT *, CASE WHEN close < lower_band THEN 1 WHEN close > upper_band THEN -1 ELSE 0 END AS signal FROM bands",
    ),
}
MULTI = f"""factors AS (SELECT *, {mean('close', 20)} AS sma, {std('close', 20)} AS sd, {mean('volume', 20)} AS av,
  {mean('close', 200)} AS ma200, macd_histogram - lag(macd_histogram) OVER ({W}) AS rise FROM ind),
scored AS (SELECT *,
  CASE WHEN rsi < 35 THEN 2 WHEN rsi > 65 THEN -2 ELSE 0 END
  + CASE WHEN close < sma - 2 * sd THEN 2 WHEN close > sma + 2 * sd THEN -2 ELSE 0 END
  + CASE WHEN volume > av * 1.5::double THEN 1 ELSE 0 END
  + CASE WHEN rise > 1e-12::double * abs(close) THEN 1 WHEN rise < -1e-12::double * abs(close) THEN -1 ELSE 0 END
  + CASE WHEN close > ma200 THEN 1 WHEN close < ma200 THEN -1 ELSE 0 END AS mf_score FROM factors)"""
SIGNALS["multi_factor"] = (
    (*IND, MULTI),
    "SELECT *, CASE WHEN mf_score >= 3 THEN 1 WHEN mf_score <= -3 THEN -1 ELSE 0 END AS signal FROM scored",
)
# The state machine of the pullback strategy, bar by bar.
_fm = FAST_MOMENTUM
PULLBACK = f"""cond AS MATERIALIZED (
  SELECT *, coalesce(rn > {_fm['momentum_window']} AND close / lag(close, {_fm['momentum_window']}) OVER ({W}) - 1 > 0
    AND close > {mean('close', _fm['trend_ma'])} AND rsi < {_fm['entry_rsi']}, false) AS enter,
    coalesce(rsi > 55, false) AS leave FROM ind),
machine AS (
  SELECT ticker, rn, CASE WHEN enter THEN 1 ELSE 0 END AS signal FROM cond WHERE rn = 1
  UNION ALL
  SELECT c.ticker, c.rn, CASE WHEN m.signal = 1 THEN CASE WHEN c.leave THEN -1 ELSE 1 END
                              WHEN c.enter THEN 1 ELSE 0 END
  FROM machine m JOIN cond c ON c.ticker = m.ticker AND c.rn = m.rn + 1)"""
SIGNALS["momentum_mr"] = ((*IND, PULLBACK), "SELECT c.*, m.signal FROM cond c JOIN machine m USING (ticker, rn)")

for _name, (_ctes, _body) in SIGNALS.items():
    _extra = {"bollinger": f"{rs('upper_band lower_band', 6)}, ", "multi_factor": "mf_score::bigint AS mf_score, "}.get(_name, "")
    ORACLES[f"{_name}_signal"] = sql(
        *_ctes, select=f"SELECT ticker, date, {_extra}signal::bigint AS signal FROM ({_body})"
    )
ORACLES["sma_signal"] = sql(
    MOVES, BARS, sma_cte(50, 200),
    select=f"SELECT ticker, date, {rs('short_ma long_ma', 6)}, signal::bigint AS signal FROM sig",
)


# -- ledgers -----------------------------------------------------------------------------------------------------
def led(
    source: str = "sig", keys: str = "ticker", name: str = "led", capital: float = 10_000.0, allow_short=False,
    inclusive=False, size: str = "floor(cash1 * 0.95::double / open)", stops=False, trailing=True,
    mult: float = 2.0, breaker: float | None = None,
) -> str:
    """Cash, shares and fills of every bar, from the bar before it. `name` has one row per bar."""
    join = " AND ".join(f"x.{k} = l.{k}" for k in keys.split(", "))
    xkeys = ", ".join(f"x.{k}" for k in keys.split(", "))
    short = "true" if allow_short else "false"
    trip = "false"
    if breaker is not None:
        trip = f"(prev > 0 AND (cash + sh * open - prev) / prev <= {breaker}::double)"
    trail = "true" if trailing else "false"
    atr = "coalesce(atr, 0)" if stops else "0"
    per = "* (1 + 0.001::double)"
    if inclusive:
        wanted = f"floor(cash1 * 0.95::double / (po {per}))"
        cap_close, cap_open = "q0", "q0"
    else:
        wanted = sized(size).replace("price", "open").replace("cash", "cash1").replace("cash11", "cash1")
        cap_close = f"CASE WHEN cs = 1 AND q0 * pc {per} > cash THEN floor(cash / (pc {per})) ELSE q0 END"
        cap_open = (
            f"CASE WHEN (os = 1 AND q0 * po {per} > cash1) OR (os = -1 AND q0 * po > cash1) "
            f"THEN floor(cash1 / (po {per})) ELSE q0 END"
        )
    atr_col = "atr" if stops else "NULL::double AS atr"
    return f"""{name}_in AS MATERIALIZED (
  SELECT {keys}, date, open, close, {atr_col}, row_number() OVER o AS rn, coalesce(lag(signal) OVER o, 0) AS s
  FROM {source} WINDOW o AS (PARTITION BY {keys} ORDER BY date)),
{name} AS (
  SELECT DISTINCT {keys}, 0::bigint AS rn, NULL::date AS date, NULL::double AS close, {capital}::double AS cash,
    0.0::double AS sh, NULL::double AS stop, NULL::double AS ext, 0 AS sside, {capital}::double AS prev,
    0 AS cs, 0.0::double AS cq, NULL::double AS pc, NULL::double AS copen, 0 AS os, 0.0::double AS oq, NULL::double AS po,
    NULL::double AS cash1, NULL::double AS sh1
  FROM {name}_in
  UNION ALL
  SELECT {keys}, rn, date, close, cash1 - os * oq * po - oq * po * 0.001::double, sh1 + os * oq,
    CASE WHEN os <> 0 AND q0 > 0 AND {atr} > 0 THEN open - os * {mult}::double * {atr} ELSE stop2 END,
    CASE WHEN os <> 0 AND q0 > 0 AND {atr} > 0 THEN open ELSE ext1 END,
    CASE WHEN os <> 0 AND q0 > 0 AND {atr} > 0 THEN os ELSE sside END,
    CASE WHEN halt THEN prev ELSE cash1 - os * oq * po - oq * po * 0.001::double + (sh1 + os * oq) * close END,
    cs, cq, pc, open, os, oq, po, cash1, sh1
  FROM (SELECT *, CASE WHEN os <> 0 AND q0 > 0 THEN {cap_open} ELSE 0 END AS oq FROM (
    SELECT *, CASE WHEN os <> 0 THEN {wanted} ELSE 0 END AS q0 FROM (
    SELECT *, open * (1 + os * 0.0005::double) AS po FROM (
    SELECT *, CASE WHEN halt OR stopped OR sh1 <> 0 THEN 0 WHEN s = 1 AND sh <= 0 THEN 1
                   WHEN s = -1 AND sh >= 0 AND {short} THEN -1 ELSE 0 END AS os FROM (
    SELECT *, cash - cs * cq * pc - cq * pc * 0.001::double AS cash1, sh + cs * cq AS sh1,
      CASE WHEN cs = 0 THEN stop1 END AS stop2 FROM (
    SELECT * EXCLUDE (q0), CASE WHEN cs = 0 THEN 0 ELSE {cap_close} END AS cq FROM (
    SELECT *, open * (1 + cs * 0.0005::double) AS pc, abs(sh) AS q0 FROM (
    SELECT *, CASE WHEN halt THEN 0 WHEN stopped THEN -sign(sh)::int WHEN s = 1 AND sh < 0 THEN 1
                   WHEN s = -1 AND sh > 0 THEN -1 ELSE 0 END AS cs FROM (
    SELECT *, coalesce(NOT halt AND sh <> 0 AND (open - stop1) * sside <= 0, false) AS stopped FROM (
    SELECT *, CASE WHEN better THEN open ELSE ext END AS ext1,
      CASE WHEN better AND sside > 0 THEN greatest(stop, open - {mult}::double * {atr})
           WHEN better THEN least(stop, open + {mult}::double * {atr}) ELSE stop END AS stop1 FROM (
    SELECT *, coalesce(NOT halt AND sh <> 0 AND stop IS NOT NULL AND {trail} AND (open - ext) * sside > 0, false) AS better FROM (
    SELECT {xkeys}, x.rn, x.date, x.open, x.close, x.atr, x.s, cash, sh, stop, ext, sside, prev, {trip} AS halt
    FROM {name} l JOIN {name}_in x ON {join} AND x.rn = l.rn + 1)))))))))))))"""


def fills(keys: str = "ticker", name: str = "led") -> str:
    return f"""trades AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rn, leg) - 1 AS seq FROM (
    SELECT {keys}, rn, date, 0 AS leg, CASE WHEN cs = 1 THEN 'COVER' ELSE 'SELL' END AS action, cq AS quantity, pc AS price,
      cq * pc * 0.001::double AS commission, abs(pc - copen) * cq AS slippage, cash1 AS cash, sh1 AS shares
    FROM {name} WHERE cs <> 0 AND cq > 0
    UNION ALL
    SELECT {keys}, rn, date, 1, CASE WHEN os = 1 THEN 'BUY' ELSE 'SHORT' END, oq, po,
      oq * po * 0.001::double, abs(po - copen) * oq, cash, sh FROM {name} WHERE os <> 0 AND oq > 0))"""


TRADE_COLS = f"ticker, date, seq, action, quantity, {rs('price commission slippage', 4)}, {rs('cash', 2)}, shares"
LEDGERS = {
    "ledger_long": {},
    "ledger_short": {"allow_short": True},
    "ledger_cost_inclusive": {"allow_short": True, "inclusive": True},
    "ledger_fixed_shares": {"size": "CASE WHEN open * 50 > cash1 THEN floor(cash1 / open) ELSE 50.0::double END"},
    "ledger_kelly": {
        "allow_short": True,
        "size": "floor(cash1 * ((0.55::double / 2.5::double - (1 - 0.55::double) / 3) / 2) / open)",
    },
    "ledger_small_capital": {"capital": 105.0, "allow_short": True},
}
for _name, _options in LEDGERS.items():
    ORACLES[_name] = sql(MOVES, BARS, SMA, led(**_options), fills(), select=f"SELECT {TRADE_COLS} FROM trades")
STOPPED = {
    "ledger_stops": {"allow_short": True},
    "ledger_fixed_stop": {"trailing": False, "mult": 1.5},
    "ledger_breaker": {"allow_short": True, "breaker": -0.003},
}
SMA_IND = sma_cte(SHORT_SMA["short_window"], SHORT_SMA["long_window"], source="ind")
for _name, _options in STOPPED.items():
    ORACLES[_name] = sql(*IND, SMA_IND, led(stops=True, **_options), fills(), select=f"SELECT {TRADE_COLS} FROM trades")


def run(**options) -> tuple[str, ...]:
    curve = "curve AS MATERIALIZED (SELECT ticker, rn, date, close, cash, sh AS shares, sh * close AS positions_value, cash + sh * close AS total_equity FROM led WHERE rn > 0)"
    return (MOVES, BARS, SMA, led(**options), fills(), curve)


RUN = run()
ORACLES["equity_curve"] = sql(
    *RUN, select=f"SELECT ticker, date, {rs('close', 4)}, shares, {rs('cash positions_value total_equity', 2)} FROM curve"
)
SUMMARY = """summary AS (
  SELECT c.ticker, arg_min(total_equity, date) AS start_equity, arg_max(total_equity, date) AS end_equity,
         (SELECT count(*) FROM trades t WHERE t.ticker = c.ticker) AS num_trades FROM curve c GROUP BY 1)"""
SUMMARY_COLS = f"ticker, {rs('start_equity end_equity', 2)}, {r('end_equity / start_equity - 1', 6)} AS total_return, num_trades"
ORACLES["run_summary"] = sql(*RUN, SUMMARY, select=f"SELECT {SUMMARY_COLS} FROM summary")
ORACLES["zero_trade_runs"] = sql(
    *run(capital=80.0), SUMMARY, select=f"SELECT {SUMMARY_COLS} FROM summary WHERE num_trades = 0"
)


# -- metrics -------------------------------------------------------------------------------------------------------
def metric_ctes(keys: str = "ticker") -> str:
    w = f"PARTITION BY {keys} ORDER BY date"
    up = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    using = f"USING ({keys})"
    return f"""eq1 AS (SELECT {keys}, date, total_equity AS e, total_equity / lag(total_equity) OVER ({w}) - 1 AS ret,
    max(total_equity) OVER {up} AS peak,
    max(total_equity) OVER ({w} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS peak14 FROM curve),
eq2 AS (SELECT *, sum(CASE WHEN e < peak * (1 - 1e-12::double) THEN 0 ELSE 1 END) OVER {up} AS island FROM eq1),
under AS (SELECT {keys}, max(n) AS max_dd_duration FROM (
    SELECT {keys}, island, count(*) FILTER (e < peak * (1 - 1e-12::double)) AS n FROM eq2 GROUP BY ALL) GROUP BY ALL),
stats AS (SELECT {keys}, arg_min(e, date) AS e0, arg_max(e, date) AS e1, date_diff('day', min(date), max(date)) AS days,
    stddev_samp(ret) AS sd, avg(ret) AS mu, stddev_samp(ret) FILTER (ret < -1e-12) AS dsd, count(*) FILTER (ret < -1e-12) AS nd, count(ret) AS n,
    min((e - peak) / peak) AS mdd, sqrt(avg(pow((e - peak14) / peak14 * 100, 2))) AS ulcer,
    coalesce(sum(ret) FILTER (ret > 0), 0) AS up, coalesce(-sum(ret) FILTER (ret <= 0), 0) AS down,
    quantile_cont(ret, 0.95) AS p95, quantile_cont(ret, 0.05) AS p5 FROM eq2 GROUP BY ALL),
sided AS (SELECT *, CASE WHEN action IN ('BUY', 'SELL') THEN 'LONG' ELSE 'SHORT' END AS side, action IN ('BUY', 'SHORT') AS opens FROM trades),
queue AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER q AS bal, count(*) FILTER (opens) OVER q AS n_open,
    count(*) FILTER (NOT opens) OVER q AS n_close FROM sided
    WINDOW q AS (PARTITION BY {keys}, side ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lows AS (SELECT *, least(0, min(bal) OVER (PARTITION BY {keys}, side ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS low,
    least(0, coalesce(min(bal) OVER (PARTITION BY {keys}, side ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low0 FROM queue),
pairs AS (SELECT {', '.join('o.' + k for k in keys.split(', '))}, o.side, o.n_open AS place, o.date AS entry_date, c.date AS exit_date, least(o.quantity, c.quantity) AS quantity,
    CASE WHEN o.side = 'LONG' THEN 1 ELSE -1 END * least(o.quantity, c.quantity) * (c.price - o.price) - o.commission - c.commission AS pnl
    FROM lows o JOIN lows c ON o.opens AND NOT c.opens AND c.low = c.low0 AND o.side = c.side AND o.n_open = c.n_close + c.low
      AND {' AND '.join(f'o.{k} = c.{k}' for k in keys.split(', '))}),
closed AS (SELECT {keys}, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(pnl) FILTER (pnl > 0) AS won, -sum(pnl) FILTER (pnl < 0) AS lost FROM pairs GROUP BY ALL),
counts AS (SELECT {keys}, count(*) // 2 AS total_trades FROM trades GROUP BY ALL),
perf AS MATERIALIZED (SELECT {keys}, e1 / e0 - 1 AS total_return, pow(e1 / e0, 365.0::double / days) - 1 AS cagr,
    CASE WHEN sd < 1e-15 THEN 0 ELSE mu / sd * sqrt(252) END AS sharpe_ratio,
    CASE WHEN nd = 0 OR dsd < 1e-15 THEN CASE WHEN mu <= 0 THEN 0 ELSE 'inf'::double END ELSE mu / dsd * sqrt(252) END AS sortino_ratio,
    CASE WHEN mdd = 0 THEN 0 ELSE (pow(e1 / e0, 365.0::double / days) - 1) / abs(mdd) END AS calmar_ratio,
    mdd AS max_drawdown, max_dd_duration::bigint AS max_dd_duration, sd * sqrt(252) AS volatility, ulcer AS ulcer_index,
    CASE WHEN down = 0 THEN CASE WHEN up > 0 THEN 'inf'::double ELSE 0 END ELSE up / down END AS omega_ratio,
    CASE WHEN n < 20 THEN 0 WHEN p5 = 0 THEN CASE WHEN p95 > 0 THEN 'inf'::double ELSE 0 END ELSE p95 / abs(p5) END AS tail_ratio,
    coalesce(win_rate, 0) AS win_rate,
    coalesce(CASE WHEN coalesce(lost, 0) = 0 THEN CASE WHEN won > 0 THEN 'inf'::double ELSE 0 END ELSE coalesce(won, 0) / lost END, 0) AS profit_factor,
    coalesce(total_trades, 0)::bigint AS total_trades
  FROM stats JOIN under {using} LEFT JOIN closed {using} LEFT JOIN counts {using})"""


RATIOS = "total_return cagr sharpe_ratio sortino_ratio calmar_ratio max_drawdown volatility ulcer_index omega_ratio tail_ratio win_rate profit_factor"
PERF_COLS = f"{rs(RATIOS, 6)}, max_dd_duration, total_trades"
SHORT_RUN = (*run(allow_short=True), metric_ctes())
ORACLES["perf_metrics"] = sql(*SHORT_RUN, select=f"SELECT ticker, {PERF_COLS} FROM perf")
PAIR_COLS = f"ticker, side, place, entry_date, exit_date, quantity, {rs('pnl', 2)}"
ORACLES["round_trips"] = sql(*SHORT_RUN, select=f"SELECT {PAIR_COLS} FROM pairs")
ORACLES["round_trips_surplus"] = sql(
    """sided AS MATERIALIZED (
  SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_quantity AS quantity, l_extendedprice / l_quantity AS price,
    l_extendedprice * 0.001::double AS commission, l_returnflag IN ('A', 'R') AS long,
    CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag = 'A' ELSE l_linenumber % 2 = 0 END AS opens,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq
  FROM lineitem)""",
    """queue AS MATERIALIZED (
  SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER q AS BIGINT) AS bal, count(*) FILTER (opens) OVER q AS n_open
  FROM sided WINDOW q AS (PARTITION BY ticker, long ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    # A close that takes the balance to a new low below 0 finds nothing open; the others close the opens in order.
    """surplus AS MATERIALIZED (
  SELECT *, least(0, min(bal) OVER (PARTITION BY ticker, long ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS low FROM queue)""",
    """closes AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY ticker, long ORDER BY date, seq) AS place
  FROM (SELECT *, low < coalesce(lag(low) OVER (PARTITION BY ticker, long ORDER BY date, seq), 0) AS extra FROM surplus)
  WHERE NOT opens AND NOT extra)""",
    "entries AS MATERIALIZED (SELECT *, n_open AS place FROM queue WHERE opens)",
    """pairs AS (
  SELECT ticker, CASE WHEN long THEN 'LONG' ELSE 'SHORT' END AS side, place, o.date AS entry_date, c.date AS exit_date,
    least(o.quantity, c.quantity) AS quantity,
    CASE WHEN long THEN 1 ELSE -1 END * least(o.quantity, c.quantity) * (c.price - o.price) - o.commission - c.commission AS pnl
  FROM entries o JOIN closes c USING (ticker, long, place))""",
    select=f"SELECT {PAIR_COLS} FROM pairs",
)
ORACLES["drawdown_series"] = sql(
    *RUN,
    select=f"""SELECT ticker, date, {r('(e - peak) / peak * 100', 6)} AS drawdown_pct
FROM (SELECT ticker, date, total_equity AS e, max(total_equity) OVER {UPTO} AS peak FROM curve)""",
)
RET = f"rets AS (SELECT *, total_equity / lag(total_equity) OVER ({W}) - 1 AS ret FROM curve)"
ORACLES["rolling_metrics"] = sql(
    *RUN, RET,
    f"roll AS (SELECT *, {mean('ret', 60)} AS m, {std('ret', 60)} AS s, product(1 + ret) OVER {UPTO} AS grown, count(*) OVER (PARTITION BY ticker) AS n FROM rets)",
    select=f"""SELECT ticker, date, {r('CASE WHEN s <> 0 THEN m / s * sqrt(252) END', 4)} AS rolling_sharpe,
  {r('s * sqrt(252) * 100', 6)} AS rolling_volatility_pct, {r('(grown - 1) * 100', 6)} AS cum_return_pct
FROM roll WHERE ret IS NOT NULL AND n >= 70""",
)
RISK = """var AS (SELECT ticker, quantile_cont(ret, 0.05) AS var_95 FROM rets GROUP BY 1),
tail AS (SELECT ticker, any_value(var_95) AS var_95, avg(ret) FILTER (ret <= var_95) AS cvar_95 FROM rets JOIN var USING (ticker) GROUP BY 1)"""
ORACLES["var_cvar"] = sql(*RUN, RET, RISK, select=f"SELECT ticker, {rs('var_95 cvar_95', 8)} FROM tail")
AGAINST = """against AS (SELECT ticker, covar_samp(ret, bench_ret) / var_samp(bench_ret) AS beta, avg(ret) AS m, avg(bench_ret) AS mb,
  avg(ret - bench_ret) / stddev_samp(ret - bench_ret) * sqrt(252) AS information_ratio
  FROM rets JOIN market USING (date) WHERE ret IS NOT NULL GROUP BY 1)"""
ORACLES["alpha_beta_ir"] = sql(
    *RUN, RET, RISK, MARKET, AGAINST,
    select=f"SELECT ticker, {rs('var_95 cvar_95', 8)}, {r('(m - beta * mb) * 252', 6)} AS alpha, {rs('beta information_ratio', 6)} FROM tail JOIN against USING (ticker)",
)
ORACLES["returns_histogram"] = sql(
    *RUN,
    f"pct AS (SELECT ticker, (total_equity / lag(total_equity) OVER ({W}) - 1) * 100 AS pct FROM curve)",
    "lim AS (SELECT ticker, min(pct) AS lo, (max(pct) - min(pct)) / 50 AS w, avg(pct) AS mean_pct FROM pct GROUP BY 1)",
    select=f"""SELECT ticker, bin::bigint AS bin, count(*) AS days, {r('any_value(lo + (bin - 1) * w)', 6)} AS bin_start_pct,
  {r('any_value(mean_pct)', 8)} AS mean_pct
FROM (SELECT *, least(floor((pct - lo) / w), 49) + 1 AS bin FROM pct JOIN lim USING (ticker) WHERE pct IS NOT NULL) GROUP BY ticker, bin""",
)

# -- experiments -----------------------------------------------------------------------------------------------------
SETS = [(s, l) for s in GRID["short_window"] for l in GRID["long_window"]]
CURVE2 = "curve AS MATERIALIZED (SELECT {keys}, date, close, cash + sh * close AS total_equity FROM led WHERE rn > 0)"
_runs = " UNION ALL ".join(
    f"SELECT {i}::bigint AS run_id, {s}::bigint AS short_window, {l}::bigint AS long_window, ticker, date, open, close, signal FROM g{i}"
    for i, (s, l) in enumerate(SETS)
)
GRID_CTES = (
    MOVES, BARS, *(sma_cte(s, l, name=f"g{i}") for i, (s, l) in enumerate(SETS)),
    f"sig AS MATERIALIZED ({_runs})", led(keys="run_id, ticker"), fills("run_id, ticker"),
    CURVE2.format(keys="run_id, ticker"), metric_ctes("run_id, ticker"),
    "sets AS (SELECT DISTINCT run_id, short_window, long_window FROM sig)",
    "runs AS MATERIALIZED (SELECT *, CASE WHEN isinf(sharpe_ratio) THEN 0 ELSE sharpe_ratio END AS value FROM perf JOIN sets USING (run_id))",
)
ORACLES["grid_search"] = sql(
    *GRID_CTES, select=f"SELECT run_id, ticker, short_window, long_window, {PERF_COLS}, {rs('value', 6)} FROM runs"
)
RSI_SETS = [(w, b, s) for w in RSI_GRID["window"] for b in RSI_GRID["overbought"] for s in RSI_GRID["oversold"]]
ORACLES["grid_rsi"] = sql(
    MOVES, BARS, EWM.split(",\newm AS")[0],
    f"""rates AS (SELECT ticker, n, rn, gain AS ag, loss AS al FROM prep, (VALUES {', '.join(f'({w})' for w in RSI_GRID['window'])}) v(n) WHERE rn = 1
  UNION ALL SELECT e.ticker, e.n, b.rn, (b.gain + (e.n - 1) * e.ag) / e.n, (b.loss + (e.n - 1) * e.al) / e.n
  FROM rates e JOIN prep b ON b.ticker = e.ticker AND b.rn = e.rn + 1)""",
    f"""sets(run_id, "window", overbought, oversold) AS (VALUES {', '.join(f'({i}::bigint, {w}::bigint, {b}::bigint, {o}::bigint)' for i, (w, b, o) in enumerate(RSI_SETS))})""",
    """sig AS MATERIALIZED (SELECT run_id, ticker, date, open, close, CASE WHEN rsi < oversold THEN 1 WHEN rsi > overbought THEN -1 ELSE 0 END AS signal
  FROM (SELECT b.ticker, b.date, b.open, b.close, e.n, CASE WHEN b.rn >= e.n THEN CASE WHEN e.al = 0 THEN 100 ELSE 100 - 100 / (1 + e.ag / e.al) END END AS rsi
        FROM prep b JOIN rates e USING (ticker, rn)) JOIN sets ON n = "window")""",
    led(keys="run_id, ticker"), fills("run_id, ticker"), CURVE2.format(keys="run_id, ticker"), metric_ctes("run_id, ticker"),
    "runs AS MATERIALIZED (SELECT *, CASE WHEN isinf(sharpe_ratio) THEN 0 ELSE sharpe_ratio END AS value FROM perf JOIN sets USING (run_id))",
    select=f'SELECT run_id, ticker, "window", overbought, oversold, {PERF_COLS}, {rs("value", 6)} FROM runs',
)
ORACLES["grid_errors"] = sql(
    MOVES, BARS, sma_cte(5, 12, name="g4"), sma_cte(5, 1_000_000, name="g5"),
    "sig AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i}::bigint AS run_id, ticker, date, open, close, signal FROM g{i}" for i in (4, 5)) + ")",
    led(keys="run_id, ticker"), fills("run_id, ticker"), CURVE2.format(keys="run_id, ticker"), metric_ctes("run_id, ticker"),
    "ran AS (SELECT ticker, run_id, CASE WHEN isinf(sharpe_ratio) THEN 0 ELSE sharpe_ratio END AS value, total_trades FROM perf)",
    "best AS (SELECT ticker, run_id AS best FROM ran WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY round(value, 6) DESC, run_id) = 1)",
    """sets(run_id, short_window, long_window, error) AS (VALUES (0::bigint, 0::bigint, -3::bigint, 'short_window must be a whole number from 1 on, not 0'),
  (1, 0, 12, 'short_window must be a whole number from 1 on, not 0'), (2, 0, 1000000, 'short_window must be a whole number from 1 on, not 0'),
  (3, 5, -3, 'long_window must be a whole number from 1 on, not -3'), (4, 5, 12, NULL), (5, 5, 1000000, NULL))""",
    select=f"""SELECT b.ticker, s.run_id, s.short_window, s.long_window, {r('CASE WHEN error IS NULL THEN value ELSE 0 END', 6)} AS value, coalesce(total_trades, 0)::bigint AS total_trades, error, best
FROM (SELECT DISTINCT ticker FROM bars) b CROSS JOIN sets s LEFT JOIN ran USING (ticker, run_id) JOIN best USING (ticker)""",
)
ORACLES["grid_best"] = sql(
    *GRID_CTES,
    select=f"""SELECT ticker, run_id, short_window, long_window, {rs('value', 6)} FROM runs
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY value DESC, run_id) = 1""",
)
ORACLES["grid_top"] = sql(
    *GRID_CTES,
    select=f"SELECT ticker, run_id, {rs('value', 6)} FROM runs QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY value DESC NULLS LAST, run_id) <= 100",
)
_cells = ", ".join(
    f"{r(f'max(value) FILTER (long_window = {v})', 6)} AS long_{v}" for v in GRID["long_window"]
)
ORACLES["grid_heatmap"] = sql(
    *GRID_CTES, select=f"SELECT ticker, short_window, {_cells} FROM runs GROUP BY 1, 2"
)
ORACLES["train_test_split"] = sql(
    MOVES,
    select=f"""SELECT ticker, date, CASE WHEN row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY ticker) * 0.7::double)
  THEN 'train' ELSE 'test' END AS part FROM moves""",
)
ORACLES["walk_forward"] = sql(
    MOVES, BARS,
    """sized AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM bars),
cut AS (SELECT *, least((rn - 1) // (n // 5), 4) AS nth FROM sized),
halves AS (SELECT *, CASE WHEN nth = 4 THEN n - 4 * (n // 5) ELSE n // 5 END AS len,
  rn - 1 - nth * (n // 5) AS place FROM cut),
test AS MATERIALIZED (SELECT nth + 1 AS window, ticker, date, open, close, floor(len * 0.7::double)::bigint AS train_size,
  len - floor(len * 0.7::double)::bigint AS test_size FROM halves WHERE place >= floor(len * 0.7::double))""",
    sma_cte(SHORT_SMA["short_window"], SHORT_SMA["long_window"], source="test", keys="window, ticker"),
    led(keys="window, ticker"), fills("window, ticker"), CURVE2.format(keys="window, ticker"),
    """sums AS (SELECT "window", ticker, arg_min(total_equity, date) AS e0, arg_max(total_equity, date) AS e1 FROM curve GROUP BY ALL),
n AS (SELECT "window", ticker, count(*) AS num_trades FROM trades GROUP BY ALL),
sizes AS (SELECT "window", ticker, any_value(train_size) AS train_size, any_value(test_size) AS test_size FROM test GROUP BY ALL)""",
    select=f"""SELECT "window"::bigint AS "window", ticker, train_size, test_size, {r('e1 / e0 - 1', 6)} AS test_return, coalesce(num_trades, 0) AS num_trades
FROM sums JOIN sizes USING ("window", ticker) LEFT JOIN n USING ("window", ticker)""",
).replace("window, ticker", '"window", ticker').replace("AS window", 'AS "window"').replace("x.window = l.window", 'x."window" = l."window"').replace("x.window, x.ticker", 'x."window", x.ticker').replace('""window""', '"window"')


def compared(names: list[str]) -> tuple[str, ...]:
    parts = {
        "SMA Crossover": "SELECT * FROM sig_sma", "RSI Reversion": SIGNALS["rsi"][1],
        "Bollinger Bands": SIGNALS["bollinger"][1], "MACD": SIGNALS["macd"][1],
        "Multi-Factor": SIGNALS["multi_factor"][1], "Momentum + MR": SIGNALS["momentum_mr"][1],
        "Buy & Hold": SIGNALS["buy_hold"][1],
    }
    union = " UNION ALL ".join(
        f"SELECT '{n}' AS strategy, ticker, date, open, close, signal FROM ({parts[n]})" for n in names
    )
    keys = "strategy, ticker"
    need = (*IND, BB, MULTI, PULLBACK) if len(names) > 3 else (MOVES, BARS, BB)
    scaled = """CASE WHEN max({x}) OVER p > min({x}) OVER p THEN coalesce(({x} - min({x}) OVER p) / (max({x}) OVER p - min({x}) OVER p), 0.5) ELSE 0.5 END"""
    so = "CASE WHEN isinf(sortino_ratio) THEN NULL ELSE sortino_ratio END"
    return (
        *need, sma_cte(SHORT_SMA["short_window"], SHORT_SMA["long_window"], name="sig_sma"),
        f"sig AS MATERIALIZED ({union})", led(keys=keys), fills(keys), CURVE2.format(keys=keys), metric_ctes(keys),
        f"""tame AS (SELECT *, {so} AS so, abs(max_drawdown) AS dd FROM perf),
ranked AS MATERIALIZED (SELECT *, {r(f'''0.35::double * {scaled.format(x='sharpe_ratio')} + 0.25::double * {scaled.format(x='so')}
  + 0.2::double * (1 - {scaled.format(x='dd')}) + 0.15::double * {scaled.format(x='cagr')} + 0.05::double * {scaled.format(x='win_rate')}''', 3)} AS composite
  FROM tame WINDOW p AS (PARTITION BY ticker))""",
    )


ALL = ["SMA Crossover", "RSI Reversion", "Bollinger Bands", "MACD", "Multi-Factor", "Momentum + MR", "Buy & Hold"]
ORACLES["compare_strategies"] = sql(
    *compared(ALL), select=f"SELECT strategy, ticker, {PERF_COLS}, composite FROM ranked"
)
ORACLES["strategy_ranking"] = sql(
    *compared(ALL),
    select=f"""SELECT ticker, strategy, composite, {r('cagr * 100', 2)} AS cagr_pct, {r('sharpe_ratio', 3)} AS sharpe,
  {r('sortino_ratio', 3)} AS sortino, {r('max_drawdown * 100', 2)} AS max_dd_pct, {r('win_rate * 100', 1)} AS win_rate_pct,
  total_trades, {r('volatility * 100', 2)} AS volatility_pct,
  CASE WHEN isinf(omega_ratio) THEN 999 ELSE {r('omega_ratio', 2)} END AS omega FROM ranked""",
)


# -- bootstrap ---------------------------------------------------------------------------------------------------------
def h(*parts: str) -> str:
    text = ", '|', ".join(parts)
    return f"concat('0x', substr(md5(concat({SEED}, '|', {text})), 1, 12))::bigint"


def u(*parts: str) -> str:
    return f"(({h(*parts)} + 0.5::double) / {16 ** 12}.0::double)"


SLOTS = f"""known AS MATERIALIZED (SELECT ticker, row_number() OVER ({W}) - 1 AS pick, move FROM moves),
stats AS (SELECT ticker, count(*) AS n, avg(move) AS mu, stddev_pop(move) AS sigma FROM moves GROUP BY 1),
slots AS MATERIALIZED (SELECT ticker, n, mu, sigma, sim, day FROM stats, range({SIMS}) s(sim), range(1, {HORIZON + 1}) d(day))"""
DRAWN = f"""drawn AS MATERIALIZED (SELECT s.ticker, s.sim, s.day, k.move AS ret FROM
  (SELECT *, {h("'draw'", 'ticker', 'sim', 'day')} % n AS pick FROM slots) s JOIN known k USING (ticker, pick))"""
NORMAL = f"""drawn AS MATERIALIZED (SELECT ticker, sim, day, mu + sigma * sqrt(-2 * ln({u("'u1'", 'ticker', 'sim', 'day')}))
  * cos(2 * pi() * {u("'u2'", 'ticker', 'sim', 'day')}) AS ret FROM slots)"""


def grown(initial: float = 1.0, source: str = "drawn") -> str:
    return f"""paths AS MATERIALIZED (SELECT *, product(1 + ret) OVER
  (PARTITION BY ticker, sim ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * {initial}::double AS value FROM {source})"""


_fan = ", ".join(f"{r(f'quantile_cont(value, {p})', 9)} AS p{int(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
ORACLES["bootstrap_fan"] = sql(
    MOVES, SLOTS, DRAWN, grown(), select=f"SELECT ticker, day, {_fan} FROM paths GROUP BY 1, 2"
)


def terminal(initial: float) -> str:
    return f"""SELECT ticker, {r('avg(value)', 9)} AS mean_final, {r('quantile_cont(value, 0.5)', 9)} AS median_final,
  {r('stddev_samp(value)', 9)} AS std_final, {r('quantile_cont(value, 0.05)', 9)} AS worst_case_5pct,
  {r('quantile_cont(value, 0.95)', 9)} AS best_case_95pct,
  {r(f'avg(CASE WHEN value / {initial}::double > 1 THEN 1.0::double ELSE 0 END)', 6)} AS prob_profit,
  {r(f'avg(CASE WHEN value / {initial}::double < 0.8::double THEN 1.0::double ELSE 0 END)', 6)} AS prob_loss_20pct
FROM paths WHERE day = {HORIZON} GROUP BY 1"""


ORACLES["bootstrap_summary"] = sql(MOVES, SLOTS, DRAWN, grown(), select=terminal(1.0))
ORACLES["bootstrap_parametric"] = sql(MOVES, SLOTS, NORMAL, grown(100.0), select=terminal(100.0))
_paths = ", ".join(f"[{', '.join(f'{x}::double' for x in v[3])}]" for v in SCENARIOS.values())
STRESSED = f"""choice AS (SELECT *, {u("'hit'", 'ticker', 'sim')} < 0.4::double AS stressed,
  ([{_paths}])[({h("'which'", 'ticker', 'sim')} % 3 + 1)::int] AS path, {h("'start'", 'ticker', 'sim')} AS hs FROM drawn),
placed AS (SELECT *, least(len(path), {HORIZON}) AS length FROM choice),
spans AS (SELECT *, day - 1 - hs % greatest(1, {HORIZON} - length) AS k FROM placed),
hit AS (SELECT ticker, sim, day, stressed, CASE WHEN stressed AND k >= 0 AND k < length THEN path[(k + 1)::int] ELSE ret END AS ret FROM spans)"""
ORACLES["stress_injection"] = sql(
    MOVES, SLOTS, DRAWN, STRESSED, grown(source="hit"),
    select=f"SELECT ticker, day, count(*) FILTER (stressed) AS stressed_sims, {r('avg(value)', 6)} AS mean_value FROM paths GROUP BY 1, 2",
)
_rows = ", ".join(
    f"('{t}', '{d}', {n}::bigint, {i}, {x}::double)"
    for t, d, n, path in SCENARIOS.values()
    for i, x in enumerate(path)
)
ORACLES["scenario_summary"] = sql(
    f"""days(scenario, description, duration_days, day, ret) AS (VALUES {_rows}),
levels AS (SELECT *, product(1 + ret) OVER (PARTITION BY scenario ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM days),
peaks AS (SELECT *, max(level) OVER (PARTITION BY scenario ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM levels),
outcome AS (SELECT scenario, description, duration_days, {r('min((level - peak) / peak) * 100', 2)} AS max_drawdown_pct, arg_max(level, day) AS growth FROM peaks GROUP BY ALL)""",
    select=f"""SELECT c_custkey, scenario, description, duration_days, max_drawdown_pct,
  {r('(abs(c_acctbal) + 1) * growth', 4)} AS final_value, {r('(growth - 1) * 100', 2)} AS total_return_pct,
  CASE WHEN max_drawdown_pct > -15 THEN 'green' WHEN max_drawdown_pct > -30 THEN 'yellow' ELSE 'red' END AS rating
FROM customer, outcome""",
)

# -- report views --------------------------------------------------------------------------------------------------------
ORACLES["kpi_report"] = sql(
    *RUN, metric_ctes(), RET, MARKET, AGAINST,
    select=f"""SELECT ticker, {rs('cagr sharpe_ratio max_drawdown win_rate beta', 6)}, {r('(m - beta * mb) * 252', 6)} AS alpha,
  CASE WHEN sharpe_ratio > 1 THEN 'Good' ELSE 'Low' END AS sharpe_grade,
  CASE WHEN ulcer_index < 5 THEN 'excellent' WHEN ulcer_index < 15 THEN 'moderate' ELSE 'high stress' END AS ulcer_rating,
  CASE WHEN omega_ratio > 3 THEN 'excellent' WHEN omega_ratio > 1.5 THEN 'good' ELSE 'weak' END AS omega_rating,
  CASE WHEN tail_ratio > 1 THEN 'right-skewed' ELSE 'left-skewed' END AS tail_rating
FROM perf JOIN against USING (ticker)""",
)
ORACLES["equity_vs_benchmark"] = sql(
    *RUN, MARKET,
    """grown AS (SELECT date, product(1 + bench_ret) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  / first_value(1 + bench_ret) OVER (ORDER BY date) * 10000 AS benchmark_equity, row_number() OVER (ORDER BY date) AS k FROM market)""",
    select=f"""SELECT ticker, date, {rs('total_equity', 2)}, {r('CASE WHEN k > 1 THEN benchmark_equity END', 2)} AS benchmark_equity
FROM curve LEFT JOIN grown USING (date)""",
)
ORACLES["trade_log"] = sql(
    *RUN,
    select=f"SELECT ticker, date, seq, action, quantity, {rs('price commission slippage', 4)}, {r('quantity * price', 2)} AS notional FROM trades",
)
ORACLES["daily_returns"] = sql(
    *RUN, RET, select=f"SELECT ticker, date::timestamp AS date, {rs('ret', 8)} FROM rets WHERE ret IS NOT NULL"
)

# -- intraday bars --------------------------------------------------------------------------------------------------------
HOURS = f"""hours AS MATERIALIZED (
  SELECT event_type AS ticker, date_trunc('hour', ts)::timestamp AS date, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*)::double AS volume FROM events GROUP BY 1, 2),
bars AS MATERIALIZED (SELECT *, close AS adj_close, row_number() OVER ({W}) AS rn FROM hours)"""
ORACLES["intraday_indicators"] = sql(
    HOURS, EWM,
    select=f"SELECT ticker, date, {r('close', 6)} AS close, {r(mean('close', 20), 6)} AS sma20, {r(std('close', 20), 6)} AS std20, {rs('atr rsi', 6)} FROM ind",
)
ORACLES["intraday_drawdown"] = sql(
    HOURS,
    f"peaks AS (SELECT *, max(close) OVER {UPTO} AS peak, sum(volume) OVER {UPTO} AS traded FROM bars)",
    select=f"SELECT ticker, date, {rs('peak', 6)}, {r('CASE WHEN peak <> 0 THEN (close - peak) / peak END', 8)} AS drawdown, traded, {r('close', 6)} AS last_close FROM peaks",
)
ORACLES["intraday_underwater"] = sql(
    HOURS,
    f"peaks AS (SELECT *, max(close) OVER {UPTO} AS peak FROM bars)",
    f"runs AS (SELECT *, count(*) FILTER (close >= peak) OVER {UPTO} AS run FROM peaks)",
    "lengths AS (SELECT ticker, run, min(CASE WHEN peak <> 0 THEN (close - peak) / peak END) AS fall, count(*) - 1 AS n FROM runs GROUP BY 1, 2)",
    select=f"SELECT ticker, {r('min(fall)', 8)} AS max_drawdown, max(n) AS duration FROM lengths GROUP BY 1",
)
