"""DuckDB views of the adapter and the factor panel, as named CTEs.

They restate the definitions independently of the Spark code: the exponential
means, for one, use prefix sums scaled by powers of q instead of lag rounds.
"""

from __future__ import annotations

import re

HIST = "(PARTITION BY code ORDER BY date)"


def rows(n: int) -> str:
    return f"(PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SO_FAR = "(PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def code_of(number: str) -> str:
    return f"CASE WHEN ({number}) < 100000 THEN lpad(CAST(({number}) AS VARCHAR), 6, '0') ELSE CAST(({number}) AS VARCHAR) END"


def supplier_code(key: str) -> str:
    return code_of(f"{key} * 7919 + 1")


def ewma(source: str, span: int) -> str:
    """y_t = q^t (x_0 + sum over i in 1..t of a q^-i x_i)."""
    a = 2.0 / (span + 1)
    q = 1.0 - a
    return (
        f"pow({q!r}, p) * sum(CASE WHEN p = 0 THEN 1.0 ELSE {a!r} * pow({q!r}, -p) END * {source}) OVER {SO_FAR}"
    )


def board(code: str = "code") -> str:
    return (
        f"CASE WHEN {code} LIKE '688%' THEN '科创板' WHEN {code} LIKE '3%' THEN '创业板' "
        f"WHEN {code} LIKE '0%' THEN '深市主板' WHEN {code} LIKE '6%' THEN '沪市主板' ELSE '其他' END"
    )


def factors_from(bars: str) -> dict[str, str]:
    """The lenient panel over a bars CTE, in three layers."""
    return {
        f"{bars}_ema": f"""
            SELECT *, {ewma('close', 12)} - {ewma('close', 26)} AS macd FROM (
                SELECT *, row_number() OVER {HIST} - 1 AS p FROM {bars}) AS numbered""",
        f"{bars}_base": f"""
            SELECT *, close / lag(close) OVER {HIST} - 1 AS ret,
                close / lag(close, 5) OVER {HIST} - 1 AS ret_5d,
                close / lag(close, 10) OVER {HIST} - 1 AS ret_10d,
                close / lag(close, 20) OVER {HIST} - 1 AS momentum_20d,
                close / lag(close, 60) OVER {HIST} - 1 AS momentum_60d,
                CASE WHEN close > lag(close) OVER {HIST} THEN close - lag(close) OVER {HIST} ELSE 0.0 END AS gain,
                CASE WHEN close < lag(close) OVER {HIST} THEN lag(close) OVER {HIST} - close ELSE 0.0 END AS loss,
                avg(close) OVER {rows(5)} AS ma5, avg(close) OVER {rows(10)} AS ma10,
                avg(close) OVER {rows(20)} AS ma20, avg(close) OVER {rows(60)} AS ma60,
                {ewma('macd', 9)} AS macd_signal,
                avg(volume) OVER {rows(5)} AS volume_ma5,
                volume / (avg(volume) OVER {rows(5)} + 1) AS volume_ratio,
                volume / lag(volume) OVER {HIST} - 1 AS volume_change,
                avg(amount) OVER {rows(20)} AS amount_ma20,
                amount / (avg(amount) OVER {rows(20)} + 1) AS amount_ratio,
                stddev_samp(close) OVER {rows(20)} AS bb_std
            FROM {bars}_ema""",
        f"{bars}_panel": f"""
            SELECT code, date, open, high, low, close, volume, amount, macd, macd_signal,
                macd - macd_signal AS macd_hist, ret, ret_5d, ret_10d, ma5, ma10, ma20, ma60,
                ma5 - ma10 AS ma5_ma10_diff, ma5 - ma20 AS ma5_ma20_diff,
                stddev_samp(ret) OVER {rows(20)} AS volatility_20d,
                stddev_samp(ret) OVER {rows(60)} AS volatility_60d,
                100 - 100 / (1 + avg(gain) OVER {rows(14)} / (avg(loss) OVER {rows(14)} + 1e-10)) AS rsi,
                volume_ma5, volume_ratio, volume_change, amount_ma20, amount_ratio, momentum_20d, momentum_60d,
                -ret_5d AS reversal_5d, -avg(ret) OVER {rows(20)} AS reversal_20d,
                ma20 AS bb_mid, ma20 + 2 * bb_std AS bb_upper, ma20 - 2 * bb_std AS bb_lower,
                (ma20 + 2 * bb_std - (ma20 - 2 * bb_std)) / ma20 AS bb_width,
                (close - (ma20 - 2 * bb_std)) / (ma20 + 2 * bb_std - (ma20 - 2 * bb_std) + 1e-10) AS bb_position,
                high / (low + 1e-10) AS high_low_ratio, close / (open + 1e-10) AS close_open_ratio,
                lead(ret) OVER {HIST} AS label
            FROM {bars}_base""",
        f"{bars}_ready": f"""
            SELECT * FROM {bars}_panel WHERE close IS NOT NULL AND ma5 IS NOT NULL
                AND volatility_20d IS NOT NULL AND rsi IS NOT NULL""",
    }


VIEWS: dict[str, str] = {
    "ticks": f"""
        SELECT {supplier_code('l_suppkey')} AS code, CAST(l_shipdate AS DATE) AS date,
            l_extendedprice / nullif(l_quantity, 0) AS price, l_quantity, l_extendedprice,
            row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
                ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS i
        FROM lineitem""",
    "bars": """
        SELECT code, date, arg_min(price, i) AS open, max(price) AS high, min(price) AS low,
            arg_max(price, i) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
        FROM ticks GROUP BY code, date""",
    "ev_ticks": f"""
        SELECT {code_of('user_id')} AS code, CAST(ts AS DATE) AS date, value,
            event_type, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i
        FROM events""",
    "evbars": """
        SELECT code, date, arg_min(value, i) AS open, max(value) AS high, min(value) AS low,
            arg_max(value, i) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount
        FROM ev_ticks GROUP BY code, date""",
    "dim": f"""
        SELECT code, name, market, {board()} AS board, industry_l1, CAST(NULL AS DATE) AS list_date,
            0 AS is_demo, 'suppliers' AS source
        FROM (SELECT {supplier_code('s_suppkey')} AS code, s_name AS name, r_name AS market, n_name AS industry_l1
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) AS s""",
    "sent": """
        SELECT code, date, avg(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.5
            WHEN 'error' THEN -1.0 ELSE 0.0 END) AS sentiment, count(*) AS comment_count, 'events' AS data_source
        FROM ev_ticks GROUP BY code, date""",
    "raw": f"""
        SELECT {supplier_code('l_suppkey')} AS code,
            CASE WHEN l_linenumber = 7 AND l_discount > 0.08 THEN strftime(l_shipdate, '%Y/%m/%d')
                ELSE strftime(l_shipdate, '%Y%m%d') END AS trade_date,
            price AS open,
            price * (1 + l_tax) - CASE WHEN l_linenumber = 6 THEN price * 0.1 ELSE 0.0 END AS high,
            price * (1 - l_discount) AS low,
            CASE WHEN l_linenumber = 5 AND l_tax = 0.0 THEN NULL ELSE price END AS close,
            CASE WHEN l_returnflag = 'R' AND l_linenumber = 4 THEN -l_quantity ELSE l_quantity END AS vol,
            CASE WHEN l_suppkey % 5 = 0 AND l_discount < 0.03 THEN NULL ELSE l_extendedprice END AS amount,
            row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity,
                l_discount, l_tax, l_returnflag, l_linestatus) AS seq
        FROM (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS price FROM lineitem) AS priced""",
    "evmkt": "SELECT * REPLACE (100 + open / 10 AS open, 100 + close / 10 AS close) FROM evbars",
    "ltmkt": "SELECT * REPLACE (100 + open / 1000 AS open, 100 + close / 1000 AS close) FROM bars",
    **factors_from("bars"),
    **factors_from("evbars"),
}


def prelude(sql: str) -> str:
    """WITH clause holding only the views ``sql`` needs, in order."""
    needed: set[str] = set()
    queue = [sql]
    while queue:
        words = set(re.findall(r"[a-z_0-9]+", queue.pop()))
        for name in VIEWS:
            if name in words and name not in needed:
                needed.add(name)
                queue.append(VIEWS[name])
    body = ", ".join(f"{n} AS ({re.sub(r'[ \n]+', ' ', VIEWS[n]).strip()})" for n in VIEWS if n in needed)
    return f"WITH {body}" if body else ""
