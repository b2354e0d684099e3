"""The same views as ``fixtures.Data`` in DuckDB SQL, written independently of the Spark code."""

from __future__ import annotations

import re

from checks.fixtures import EMBARGO, FEATURES, MIN_ROWS, TRAIN_MONTHS

LABEL = "label_excess_return_20d"
KEY = "((ts_code * 100003 + datediff('day', DATE '1970-01-01', trade_date) + {seed}) * 48271) % 2147483647"

V: dict[str, str] = {}


def sql(body: str) -> str:
    """Prefix ``body`` with the views it needs, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in V and name not in order:
                visit(V[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    own = re.match(r"\s*WITH\s+", body)
    head = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({V[n]})" for n in order)
    return head + (",\n" + body[own.end():] if own else "\n" + body)


def rnd(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"ROUND({c}, {digits}) + 0.0 AS {c}" for c in cols)


V["v_daily"] = """
SELECT *, cents / 1e2 AS amount, CAST(qty AS DOUBLE) AS vol,
  CASE WHEN mx % 17 <> 0 THEN CAST(qty AS DOUBLE) / (100 + ts_code % 7) END AS turnover_rate
FROM (SELECT l_suppkey AS ts_code, CAST(l_shipdate AS DATE) AS trade_date,
        CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
        CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, MAX(l_orderkey) AS mx
      FROM lineitem GROUP BY 1, 2)"""
V["v_bars"] = """
SELECT ts_code, trade_date, amount, vol, turnover_rate,
  CAST(SUM(cents) OVER w AS DOUBLE) / 1e2 / CAST(SUM(qty) OVER w AS DOUBLE) AS close
FROM v_daily WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
V["v_industry"] = """
SELECT s_suppkey AS ts_code, CASE WHEN s_suppkey % 11 <> 0 THEN r_name END AS industry_name, s_acctbal / 100 AS pe_ttm
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
V["v_bench"] = """
SELECT trade_date, CAST(SUM(c) OVER w AS DOUBLE) / 1e2 / CAST(SUM(q) OVER w AS DOUBLE) AS close
FROM (SELECT trade_date, SUM(cents) AS c, SUM(qty) AS q FROM v_daily GROUP BY 1)
WINDOW w AS (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
V["v_fin"] = """
SELECT ts_code, MAKE_DATE(y, q * 3, 1) AS end_date,
  CASE WHEN q = 4 THEN MAKE_DATE(y + 1, 4, 30) WHEN q = 1 THEN MAKE_DATE(y, 4, 30)
       WHEN q = 2 THEN MAKE_DATE(y, 8, 31) ELSE MAKE_DATE(y, 10, 31) END AS ann_date,
  CAST(SUM(disc) AS DOUBLE) / COUNT(*) / 1e2 AS roe, CAST(SUM(tax) AS DOUBLE) / COUNT(*) / 1e2 AS netprofitmargin
FROM (SELECT l_suppkey AS ts_code, CAST(YEAR(l_shipdate) AS INT) AS y, CAST(QUARTER(l_shipdate) AS INT) AS q,
        CAST(ROUND(l_discount * 100) AS BIGINT) AS disc, CAST(ROUND(l_tax * 100) AS BIGINT) AS tax FROM lineitem)
GROUP BY ts_code, y, q"""
V["v_macro"] = """
SELECT CASE WHEN m <= 10 THEN MAKE_DATE(y, m + 2, 10) ELSE MAKE_DATE(y + 1, m - 10, 10) END AS trade_date,
  CAST(total AS DOUBLE) / LAG(total, 12) OVER (ORDER BY y, m) - 1 AS macro_yoy
FROM (SELECT CAST(YEAR(o_orderdate) AS INT) AS y, CAST(MONTH(o_orderdate) AS INT) AS m,
        CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY 1, 2)"""
V["v_member"] = """
SELECT month, ts_code FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY month ORDER BY amt DESC, ts_code) AS rk, COUNT(*) OVER (PARTITION BY month) AS n
  FROM (SELECT CAST(DATE_TRUNC('month', trade_date) AS DATE) AS month, ts_code, SUM(cents) AS amt FROM v_daily GROUP BY 1, 2))
WHERE rk <= CEIL(n * CAST(0.6 AS DOUBLE))"""
V["v_find"] = "SELECT * FROM v_fin QUALIFY ROW_NUMBER() OVER (PARTITION BY ts_code, ann_date ORDER BY end_date DESC) = 1"
V["v_asof"] = """
SELECT b.*, f.ann_date, f.end_date, f.roe, f.netprofitmargin
FROM v_bars b ASOF LEFT JOIN v_find f ON b.ts_code = f.ts_code AND b.trade_date >= f.ann_date"""
V["v_panel"] = """
SELECT a.*, i.industry_name, i.pe_ttm, m.macro_yoy
FROM (SELECT * FROM v_asof) a LEFT JOIN v_industry i ON a.ts_code = i.ts_code
ASOF LEFT JOIN v_macro m ON a.trade_date >= m.trade_date"""
V["v_factors"] = """
SELECT *, CASE WHEN COUNT(daily_return) OVER w20 = 20 THEN STDDEV_SAMP(daily_return) OVER w20 * SQRT(20.0) END AS volatility_20
FROM (SELECT *, close / LAG(close) OVER w - 1 AS daily_return, close / LAG(close, 20) OVER w - 1 AS ret_20,
        close / LAG(close, 60) OVER w - 1 AS ret_60,
        CASE WHEN COUNT(turnover_rate) OVER w20 = 20 THEN AVG(turnover_rate) OVER w20 END AS turnover_20,
        CASE WHEN pe_ttm > 0 THEN 1.0 / pe_ttm END AS ep_ttm
      FROM v_panel
      WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date),
        w20 AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
WINDOW w20 AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
V["v_bret"] = """
SELECT trade_date, close / LAG(close) OVER (ORDER BY trade_date) - 1 AS benchmark_daily_return,
  LEAD(close, 20) OVER (ORDER BY trade_date) / close - 1 AS benchmark_future_return_20d FROM v_bench"""
V["v_labeled"] = """
SELECT f.*, b.benchmark_daily_return, b.benchmark_future_return_20d,
  LEAD(close, 20) OVER w / close - 1 AS future_return_20d,
  LEAD(close, 20) OVER w / close - 1 - b.benchmark_future_return_20d AS label_excess_return_20d
FROM v_factors f LEFT JOIN v_bret b ON f.trade_date = b.trade_date WINDOW w AS (PARTITION BY ts_code ORDER BY f.trade_date)"""


def wins(src: str, cols=FEATURES, strict: bool = True, k: float = 3.0) -> str:
    med = ", ".join(f"MEDIAN({c}) OVER d AS m_{c}" for c in cols)
    mad = ", ".join(f"MEDIAN(ABS({c} - m_{c})) OVER d AS a_{c}, COUNT({c}) OVER d AS n_{c}" for c in cols)
    full = "n_{c} = rows_" if strict else "TRUE"
    clip = ", ".join(
        f"CASE WHEN {c} IS NOT NULL AND {full.format(c=c)} THEN LEAST(GREATEST({c}, m_{c} - {k} * a_{c}), m_{c} + {k} * a_{c}) ELSE {c} END AS {c}"
        for c in cols
    )
    drop = ", ".join(f"m_{c}, a_{c}, n_{c}" for c in cols)
    return f"""
SELECT * EXCLUDE ({drop}, rows_) REPLACE ({clip}) FROM (
  SELECT *, {mad}, COUNT(*) OVER d AS rows_ FROM (SELECT *, {med} FROM {src} WINDOW d AS (PARTITION BY trade_date))
  WINDOW d AS (PARTITION BY trade_date))"""


def zs(src: str, cols=FEATURES, keys: str = "trade_date, industry_name", guard: str = "industry_name IS NOT NULL") -> str:
    z = ", ".join(f"CASE WHEN {guard} THEN ({c} - AVG({c}) OVER g) / NULLIF(STDDEV_SAMP({c}) OVER g, 0) END AS {c}" for c in cols)
    return f"SELECT * REPLACE ({z}) FROM {src} WINDOW g AS (PARTITION BY {keys})"


V["v_wins"] = wins("v_labeled")
V["v_model"] = zs("v_wins")


def mean_of(cols, neg=("volatility_20",)) -> str:
    parts = [f"(-{c})" if c in neg else c for c in cols]
    total = " + ".join(f"COALESCE({p}, 0)" for p in parts)
    count = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in cols)
    return f"({total}) / NULLIF({count}, 0)"


V["v_scored"] = f"SELECT *, ROUND({mean_of(FEATURES)}, 8) + 0.0 AS score FROM v_model"
V["v_cal"] = "SELECT trade_date, ROW_NUMBER() OVER (ORDER BY trade_date) AS idx FROM (SELECT DISTINCT trade_date FROM v_bars)"
V["v_ends"] = """
SELECT trade_date, idx, ROW_NUMBER() OVER (ORDER BY trade_date) AS seq FROM v_cal
WHERE trade_date IN (SELECT MAX(trade_date) FROM v_cal GROUP BY DATE_TRUNC('month', trade_date))"""
V["v_snap"] = "SELECT trade_date AS rebalance_date, * EXCLUDE (trade_date) FROM v_scored WHERE trade_date IN (SELECT trade_date FROM v_ends) AND score IS NOT NULL"


def top_n(src: str, n, by: str = "", extra: str = "") -> str:
    part = f"{by + ', ' if by else ''}rebalance_date"
    return f"""
SELECT *, 1.0 / COUNT(*) OVER (PARTITION BY {part}) AS weight FROM (
  SELECT * FROM {src} QUALIFY ROW_NUMBER() OVER (PARTITION BY {part} ORDER BY score DESC, ts_code) <= {n})"""


def turnover(pos: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    on = f"c.{by} = p.{by} AND " if by else ""
    names = f"COALESCE(c.{by}, p.{by}) AS {by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
SELECT {b}rebalance_date, turnover FROM (
  SELECT {names}COALESCE(c.seq, p.seq + 1) AS seq, SUM(ABS(COALESCE(c.weight, 0) - COALESCE(p.weight, 0))) / 2 AS turnover
  FROM (SELECT * FROM {pos} JOIN (SELECT {b}rebalance_date, ROW_NUMBER() OVER ({part}ORDER BY rebalance_date) AS seq
          FROM (SELECT DISTINCT {b}rebalance_date FROM {pos})) USING ({b}rebalance_date)) c
  FULL JOIN (SELECT * FROM {pos} JOIN (SELECT {b}rebalance_date, ROW_NUMBER() OVER ({part}ORDER BY rebalance_date) AS seq
          FROM (SELECT DISTINCT {b}rebalance_date FROM {pos})) USING ({b}rebalance_date)) p
    ON {on}c.ts_code = p.ts_code AND c.seq = p.seq + 1
  GROUP BY ALL)
JOIN (SELECT {b}rebalance_date, ROW_NUMBER() OVER ({part}ORDER BY rebalance_date) AS seq
      FROM (SELECT DISTINCT {b}rebalance_date FROM {pos})) USING ({b}seq)"""


def nav(pos: str, turn: str, by: str = "", panel: str = "v_labeled", fee: float = 0.002) -> str:
    """Day by day: the book of the last rebalance strictly before the day."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    same = f"AND p.{by} = q.{by}" if by else ""
    days = f"(SELECT DISTINCT {by} FROM {pos}) s CROSS JOIN v_cal c" if by else "v_cal c"
    return f"""
SELECT {b}trade_date, portfolio_nav / COALESCE(LAG(portfolio_nav) OVER o, 1) - 1 AS portfolio_return, gross_portfolio_return,
  benchmark_return, portfolio_nav / COALESCE(LAG(portfolio_nav) OVER o, 1) - 1 - benchmark_return AS excess_return,
  transaction_cost, portfolio_nav, benchmark_nav, portfolio_nav / NULLIF(benchmark_nav, 0) AS excess_nav
FROM (
  SELECT *, PRODUCT((1 + gross_portfolio_return) * GREATEST(1 - transaction_cost, 0)) OVER o AS portfolio_nav,
    PRODUCT(1 + benchmark_return) OVER o AS benchmark_nav
  FROM (
    SELECT {b}c.trade_date, COALESCE(g.gross, 0) AS gross_portfolio_return, COALESCE(2 * t.turnover * {fee}, 0) AS transaction_cost,
      COALESCE(k.r, 0) AS benchmark_return
    FROM {days}
    LEFT JOIN (
      SELECT {('q.' + by + ', ') if by else ''}q.trade_date, SUM(p.weight * COALESCE(x.daily_return, 0)) AS gross
      FROM (SELECT {('s.' + by + ', ') if by else ''}c.trade_date, MAX(r.rebalance_date) AS rd FROM {days}
            JOIN (SELECT DISTINCT {b}rebalance_date FROM {pos}) r ON r.rebalance_date < c.trade_date {('AND r.' + by + ' = s.' + by) if by else ''}
            GROUP BY ALL) q
      JOIN {pos} p ON p.rebalance_date = q.rd {same}
      LEFT JOIN {panel} x ON x.ts_code = p.ts_code AND x.trade_date = q.trade_date
      GROUP BY ALL) g USING ({b}trade_date)
    LEFT JOIN {turn} t ON t.rebalance_date = c.trade_date {('AND t.' + by + ' = s.' + by) if by else ''}
    LEFT JOIN (SELECT trade_date, ARG_MIN_NULL(benchmark_daily_return, ts_code) AS r FROM {panel} GROUP BY 1) k ON k.trade_date = c.trade_date)
  WINDOW o AS ({part}ORDER BY trade_date))
WINDOW o AS ({part}ORDER BY trade_date)"""


def metrics(navv: str, diag: str, by: str = "") -> str:
    """``diag``: one row per (scenario, rebalance) with turnover, te, dev."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    join = f"USING ({by})" if by else "ON TRUE"
    return f"""
SELECT n.*, w.monthly_win_rate, d.annual_turnover, d.avg_ex_ante_tracking_error, d.max_ex_ante_tracking_error, d.avg_max_industry_deviation
FROM (
  SELECT *, annual_return - benchmark_annual_return AS annual_excess_return,
    annual_return / NULLIF(annual_volatility, 0) AS sharpe_ratio,
    (annual_return - benchmark_annual_return) / NULLIF(tracking_error, 0) AS information_ratio
  FROM (
    SELECT {b}POW(ARG_MAX(portfolio_nav, trade_date) / ARG_MIN(portfolio_nav, trade_date), 252.0 / COUNT(*)) - 1 AS annual_return,
      POW(ARG_MAX(benchmark_nav, trade_date) / ARG_MIN(benchmark_nav, trade_date), 252.0 / COUNT(*)) - 1 AS benchmark_annual_return,
      STDDEV_POP(portfolio_return) * SQRT(252) AS annual_volatility,
      STDDEV_POP(portfolio_return - benchmark_return) * SQRT(252) AS tracking_error,
      MIN(pd) AS max_drawdown, MIN(bd) AS benchmark_max_drawdown, MIN(ed) AS excess_max_drawdown,
      (PRODUCT(1 + portfolio_return) FILTER (benchmark_return > 0) - 1) / (PRODUCT(1 + benchmark_return) FILTER (benchmark_return > 0) - 1) AS upside_capture,
      (PRODUCT(1 + portfolio_return) FILTER (benchmark_return < 0) - 1) / (PRODUCT(1 + benchmark_return) FILTER (benchmark_return < 0) - 1) AS downside_capture
    FROM (SELECT *, portfolio_nav / MAX(portfolio_nav) OVER o - 1 AS pd, benchmark_nav / MAX(benchmark_nav) OVER o - 1 AS bd,
            excess_nav / MAX(excess_nav) OVER o - 1 AS ed FROM {navv} WINDOW o AS ({part}ORDER BY trade_date))
    {'GROUP BY ' + by if by else ''})) n
JOIN (SELECT {b}AVG(CAST(p > q AS INT)) AS monthly_win_rate FROM (
        SELECT {b}DATE_TRUNC('month', trade_date) AS m, PRODUCT(1 + portfolio_return) AS p, PRODUCT(1 + benchmark_return) AS q
        FROM {navv} GROUP BY ALL) {'GROUP BY ' + by if by else ''}) w {join}
LEFT JOIN (SELECT {b}AVG(COALESCE(turnover, 0)) * 12 AS annual_turnover, CAST(AVG(te) AS DOUBLE) AS avg_ex_ante_tracking_error,
        CAST(MAX(te) AS DOUBLE) AS max_ex_ante_tracking_error, CAST(AVG(dev) AS DOUBLE) AS avg_max_industry_deviation
      FROM {diag} {'GROUP BY ' + by if by else ''}) d {join}"""


METRICS = (
    "annual_return benchmark_annual_return annual_excess_return annual_volatility sharpe_ratio tracking_error information_ratio "
    "max_drawdown benchmark_max_drawdown excess_max_drawdown monthly_win_rate upside_capture downside_capture annual_turnover "
    "avg_ex_ante_tracking_error max_ex_ante_tracking_error avg_max_industry_deviation"
).split()

V["v_book"] = top_n("v_snap", 20)
V["v_turn"] = turnover("v_book")
V["v_nav"] = nav("v_book", "v_turn")
V["v_tdiag"] = "SELECT *, CAST(NULL AS DOUBLE) AS te, CAST(NULL AS DOUBLE) AS dev FROM v_turn"
V["v_metrics"] = metrics("v_nav", "v_tdiag")

# --- training windows, OLS and conformal -----------------------------------------------------
V["v_roll"] = f"""
SELECT p.trade_date AS window_id, s.trade_date AS train_start, s.idx AS first_idx, p.idx - 1 AS last_idx
FROM v_ends p JOIN v_ends s ON s.seq = p.seq - {TRAIN_MONTHS}"""
V["v_win"] = f"""
SELECT p.trade_date AS window_id, s.trade_date AS train_start, s.idx AS first_idx, p.idx - {EMBARGO} AS last_idx
FROM v_ends p JOIN v_ends s ON s.seq = p.seq - {TRAIN_MONTHS} WHERE p.idx - {EMBARGO} > 1"""


def window_rows(win: str) -> str:
    return f"""
SELECT w.window_id, m.trade_date, m.ts_code, m.industry_name, COALESCE(m.ret_20, 0) AS x, m.{LABEL} AS y
FROM v_model m JOIN v_cal c ON m.trade_date = c.trade_date JOIN {win} w ON c.idx BETWEEN w.first_idx AND w.last_idx
WHERE m.{LABEL} IS NOT NULL QUALIFY COUNT(*) OVER (PARTITION BY w.window_id) >= {MIN_ROWS}"""


V["v_wrows"] = window_rows("v_win")


def ols(rows: str, x: str = "x", y: str = "y", keys: str = "window_id", where: str = "TRUE") -> str:
    return f"""
SELECT {keys}, COUNT(*) AS n_train, COALESCE(b, 0) AS slope, my - COALESCE(b, 0) * mx AS intercept FROM (
  SELECT {keys}, {x} AS x_, {y} AS y_ FROM {rows} WHERE {where})
JOIN (SELECT {keys}, AVG({y}) AS my, AVG({x}) AS mx, CASE WHEN VAR_POP({x}) > 0 THEN COVAR_POP({y}, {x}) / VAR_POP({x}) END AS b
      FROM {rows} WHERE {where} GROUP BY {keys}) USING ({keys})
GROUP BY ALL"""


def split(rows: str, seed: int = 42, keys: str = "window_id") -> str:
    key = KEY.format(seed=seed)
    return f"""
SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {key}) <= CEIL(COUNT(*) OVER (PARTITION BY {keys}) * CAST(0.3 AS DOUBLE)) AS is_calibration
FROM {rows}"""


V["v_split"] = split("v_wrows")
V["v_coef"] = ols("v_split", where="NOT is_calibration")
V["v_resid"] = "SELECT s.*, ABS(y - (intercept + slope * x)) AS res FROM v_split s JOIN v_coef USING (window_id)"
V["v_sigma"] = ols("(SELECT *, LN(res + 1e-6) AS lr FROM v_resid)", y="lr", where="NOT is_calibration")
V["v_cscore"] = """
SELECT r.*, res / (EXP(s.intercept + s.slope * x) + 1e-6) AS score FROM v_resid r JOIN v_sigma s USING (window_id) WHERE is_calibration"""


def conf_q(src: str, alpha: float, keys: str = "window_id", score: str = "score", textbook: bool = False) -> str:
    k = f"LEAST(CEIL((n + 1) * CAST({1.0 - alpha!r} AS DOUBLE)), n)"
    k = k if textbook else f"LEAST({k} + 1, n)"
    return f"""
SELECT {keys}, q, n AS n_calib FROM (
  SELECT {keys}, {score} AS q, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {score}) AS rk, COUNT(*) OVER (PARTITION BY {keys}) AS n FROM {src})
WHERE rk = {k}"""


V["v_q10"] = conf_q("v_cscore", 0.1)


def conformal(q: str) -> str:
    return f"""
SELECT trade_date, ts_code, industry_name, {LABEL}, ml_score, ml_score - hw AS ci_lower, ml_score + hw AS ci_upper, hw AS ci_half_width,
  CASE WHEN MAX(raw) OVER d - MIN(raw) OVER d <= 1e-6 THEN 1.0 ELSE (raw - MIN(raw) OVER d) / (MAX(raw) OVER d - MIN(raw) OVER d + 1e-6) END AS confidence
FROM (SELECT *, 1 / (2 * hw + 1e-6) AS raw FROM (
  SELECT m.trade_date, m.ts_code, m.industry_name, m.{LABEL}, c.intercept + c.slope * COALESCE(m.ret_20, 0) AS ml_score,
    q.q * (EXP(s.intercept + s.slope * COALESCE(m.ret_20, 0)) + 1e-6) AS hw
  FROM v_model m JOIN v_coef c ON m.trade_date = c.window_id JOIN v_sigma s ON s.window_id = c.window_id JOIN {q} q ON q.window_id = c.window_id))
WINDOW d AS (PARTITION BY trade_date)"""


V["v_conf"] = conformal("v_q10")

# --- optimiser snapshots and risk --------------------------------------------------------------


def prep(src: str, by: str = "", wb: str = "amount", score: str = "score") -> str:
    part = f"{by + ', ' if by else ''}rebalance_date"
    return f"""
SELECT {part}, ts_code, COALESCE(industry_name, 'UNKNOWN') AS industry_name, {wb} / SUM({wb}) OVER g AS benchmark_weight, score,
  CASE WHEN STDDEV_POP({score}) OVER g > 0 THEN ({score} - AVG({score}) OVER g) / STDDEV_POP({score}) OVER g ELSE 0 END AS alpha_score
FROM {src} WINDOW g AS (PARTITION BY {part})"""


V["v_prep"] = prep("v_snap")
V["v_hist"] = """
SELECT rebalance_date, ts_code, trade_date, x, t, MAX(t) OVER (PARTITION BY rebalance_date) AS n_days FROM (
  SELECT p.rebalance_date, p.ts_code, l.trade_date, l.daily_return AS x,
    DENSE_RANK() OVER (PARTITION BY p.rebalance_date ORDER BY l.trade_date DESC) AS t
  FROM v_prep p JOIN v_labeled l ON l.ts_code = p.ts_code AND l.trade_date < p.rebalance_date AND l.daily_return IS NOT NULL)
WHERE t <= 60"""
V["v_cent"] = """
SELECT g.rebalance_date, g.ts_code, g.t, COALESCE(h.x, 0) - m.s / g.n_days AS x, g.n_days FROM (
  SELECT a.rebalance_date, a.ts_code, a.n_days, b.t FROM (SELECT DISTINCT rebalance_date, ts_code, n_days FROM v_hist) a
  JOIN (SELECT DISTINCT rebalance_date, t FROM v_hist) b USING (rebalance_date)) g
LEFT JOIN v_hist h USING (rebalance_date, ts_code, t)
JOIN (SELECT rebalance_date, ts_code, SUM(x) AS s FROM v_hist GROUP BY ALL) m USING (rebalance_date, ts_code)"""
V["v_shrink"] = """
SELECT rebalance_date, CAST(COALESCE(n, 0) AS BIGINT) AS n_days, p, CASE WHEN n >= 2 THEN mu ELSE 0 END AS mu,
  CASE WHEN n >= 2 AND p > 1 AND LEAST(b, dl) > 0 AND dl > 0 THEN LEAST(b, dl) / dl ELSE 0 END AS shrink
FROM (SELECT *, (d4 / n - norm) / (p * n) AS b, (norm - p * mu * mu) / p AS dl FROM (
  SELECT z.rebalance_date, z.p, k.n, k.tr / (k.n * z.p) AS mu, g.sq / (k.n * k.n) AS norm, k.d4
  FROM (SELECT rebalance_date, COUNT(*) AS p FROM v_prep GROUP BY 1) z
  LEFT JOIN (SELECT rebalance_date, CAST(MAX(n_days) AS DOUBLE) AS n, SUM(u) AS tr, SUM(u * u) AS d4 FROM (
      SELECT rebalance_date, t, n_days, SUM(x * x) AS u FROM v_cent GROUP BY ALL) GROUP BY 1) k USING (rebalance_date)
  LEFT JOIN (SELECT rebalance_date, SUM(v * v) AS sq FROM (
      SELECT a.rebalance_date, a.t, b.t AS t2, SUM(a.x * b.x) AS v FROM v_cent a JOIN v_cent b USING (rebalance_date, ts_code) GROUP BY ALL)
    GROUP BY 1) g USING (rebalance_date)))"""
# a plain test book over the snapshot: benchmark tilted by alpha, not scaled to any limit
V["v_wts"] = """
SELECT *, w0 / SUM(w0) OVER (PARTITION BY rebalance_date) AS weight FROM (
  SELECT *, benchmark_weight * GREATEST(1 + 0.5 * alpha_score, 0) AS w0 FROM v_prep)"""


def avar(wts: str, by: str = "", extra: str = "0", ridge: str = "1e-4") -> str:
    k = f"{by + ', ' if by else ''}rebalance_date"
    return f"""
SELECT {k}, GREATEST((1 - shrink) * CASE WHEN n_days >= 2 THEN COALESCE(s2, 0) / n_days - POW(COALESCE(s1, 0) / n_days, 2) ELSE 0 END
    + (shrink * mu + {ridge}) * aa + xa, 0) AS active_variance
FROM (SELECT {k}, SUM(POW(weight - benchmark_weight, 2)) AS aa, SUM({extra} * POW(weight - benchmark_weight, 2)) AS xa FROM {wts} GROUP BY {k})
LEFT JOIN (SELECT {k}, SUM(s) AS s1, SUM(s * s) AS s2 FROM (
    SELECT {k}, h.t, SUM((w.weight - w.benchmark_weight) * h.x) AS s FROM {wts} w JOIN v_hist h USING (rebalance_date, ts_code) GROUP BY ALL)
  GROUP BY {k}) USING ({k})
JOIN v_shrink USING (rebalance_date)"""


V["v_avar"] = avar("v_wts")
V["v_dev"] = """
SELECT rebalance_date, MAX(ABS(e - b)) AS max_industry_deviation FROM (
  SELECT rebalance_date, industry_name, SUM(weight) AS e, SUM(benchmark_weight) AS b FROM v_wts GROUP BY ALL) GROUP BY 1"""


def snap_turn(wts: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    same = f"c.{by} = p.{by} AND " if by else ""
    seq = f"(SELECT {b}rebalance_date, ROW_NUMBER() OVER ({part}ORDER BY rebalance_date) AS seq FROM (SELECT DISTINCT {b}rebalance_date FROM {wts}))"
    return f"""
SELECT {'c.' + by + ', ' if by else ''}c.rebalance_date, SUM(ABS(c.weight - COALESCE(p.weight, 0))) / 2 AS snapshot_turnover,
  SUM(COALESCE(p.weight, 0)) AS previous_held
FROM (SELECT * FROM {wts} JOIN {seq} USING ({b}rebalance_date)) c
LEFT JOIN (SELECT * FROM {wts} JOIN {seq} USING ({b}rebalance_date)) p ON {same}c.ts_code = p.ts_code AND c.seq = p.seq + 1
GROUP BY ALL"""


V["v_sturn"] = snap_turn("v_wts")
