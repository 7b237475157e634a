"""DuckDB SQL for the queries of ``tidemark.plans.queries`` that SQL expresses, written apart from them."""

from __future__ import annotations

NATION = """o AS (SELECT n_name AS symbol, r_name AS sector, date_trunc('week', o_orderdate)::TIMESTAMP AS ts, o_totalprice AS p, o_orderdate AS d, o_orderkey AS k
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
b0 AS (SELECT symbol, sector, ts, arg_min(p, (d, k)) AS open, max(p) AS high, min(p) AS low, arg_max(p, (d, k)) AS close, count(*)::DOUBLE AS volume FROM o GROUP BY symbol, sector, ts),
b AS (SELECT *, row_number() OVER s AS rn, lag(close) OVER s AS pc, lag(high) OVER s AS ph, lag(low) OVER s AS pl FROM b0 WINDOW s AS (PARTITION BY symbol ORDER BY ts))"""
EVENT = """e AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
  count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""
RESULT = """g AS (SELECT n_name AS symbol, r_name AS sector, c_mktsegment AS strategy_type, o_orderpriority AS priority, round(avg(o_totalprice) / 100000 - 2.5, 4) AS sharpe, round(min(o_totalprice) / max(o_totalprice) - 0.05, 4) AS cagr,
  round(1 - min(o_totalprice) / max(o_totalprice), 4) AS max_drawdown, round(max(o_totalprice) / 200000 - 1, 4) AS sortino, round(avg(CASE WHEN o_totalprice > 250000 THEN 1.0::DOUBLE ELSE 0 END), 4) AS win_rate, count(*) AS num_trades,
  round(sum(o_totalprice) / 1000000 - 1, 4) AS total_return
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4),
r AS (SELECT *, strategy_type || '-' || priority AS config_id, substr(priority, 1, 1)::INT * 5 AS entry_lookback, length(strategy_type)::INT AS exit_lookback, substr(priority, 1, 1)::INT AS iteration FROM g)"""
BARS = "SELECT symbol, ts, {} FROM b"
S = "PARTITION BY symbol ORDER BY ts"


def w(n: int) -> str:
    return f"({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def p(n: int) -> str:
    return f"({S} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def f(n: int, x: str, digits: int = 4, least: str = ">=") -> str:
    """``x`` rounded, once there are ``n`` bars."""
    return f"CASE WHEN rn {least} {n} THEN round({x}, {digits}) + 0.0 END"


def r4(x: str) -> str:
    return f"round({x}, 4) + 0.0"


def with_(ctes: str, rest: str) -> str:
    return f"WITH {ctes} {rest}"


SQL: dict[str, str] = {}
TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
SQL["src_bars_event"] = with_(EVENT, f"SELECT symbol, ts, {', '.join(f'{r4(c)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))}, '1h' AS timeframe FROM e")
SQL["src_bars_nation"] = with_(NATION, f"SELECT symbol, sector, ts, {', '.join(f'{r4(c)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))}, '1w' AS timeframe FROM b")
SQL["src_date_range"] = with_(NATION, "SELECT symbol, min(ts)::DATE AS first, max(ts)::DATE AS last FROM b GROUP BY 1")
SQL["src_by_year"] = with_(NATION, "SELECT symbol, year(ts)::INT AS year, count(*) AS bars FROM b GROUP BY 1, 2")
SQL["join_sector"] = with_(NATION, "SELECT coalesce(x.r_name, 'Unknown') AS sector, count(*) AS bars, count(DISTINCT symbol) AS symbols FROM b LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) x ON x.n_name = symbol GROUP BY 1")
OB = "ob AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey, o_totalprice AS open, o_totalprice + o_orderkey % 3 - 1 AS high, o_totalprice - o_orderkey % 5 + 1 AS low, o_totalprice AS close FROM orders)"
DUP = "SELECT symbol, ts, count(*) AS count FROM ob GROUP BY 1, 2 HAVING count(*) > 1"
DIS = "SELECT * FROM (SELECT symbol, o_orderkey, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY o_orderkey) AS previous_ts FROM ob) WHERE ts < previous_ts"
INV = "SELECT symbol, ts, concat_ws(', ', CASE WHEN high < open THEN 'high<open' END, CASE WHEN high < close THEN 'high<close' END, CASE WHEN high < low THEN 'high<low' END, CASE WHEN low > open THEN 'low>open' END, CASE WHEN low > close THEN 'low>close' END) AS reasons FROM ob WHERE high < open OR high < close OR high < low OR low > open OR low > close"
SQL["dq_duplicates"], SQL["dq_disorder"], SQL["dq_invalid"] = (with_(OB, x) for x in (DUP, DIS, INV))
SQL["dq_gaps"] = with_(NATION, f"SELECT * FROM (SELECT symbol, lag(ts) OVER ({S}) AS from_ts, ts AS to_ts, (date_diff('day', lag(ts) OVER ({S}), ts) // 7 - 1)::BIGINT AS expected_bars FROM b) WHERE expected_bars > 0")
SQL["dq_report"] = with_(OB, f"SELECT 'duplicate' AS \"check\", count(*) AS issues FROM ({DUP}) UNION ALL SELECT 'out_of_order', count(*) FROM ({DIS}) UNION ALL SELECT 'invalid_ohlc', count(*) FROM ({INV}) UNION ALL SELECT 'gap', count(*) FROM (SELECT date_diff('second', lag(ts) OVER ({S}), ts) // 86400 - 1 AS g FROM ob) WHERE g > 0")

# window indicators
SQL["ind_donchian"] = with_(NATION, BARS.format(f"{f(20, f'max(high) OVER {p(20)}', 4, '>')} AS upper, {f(20, f'min(low) OVER {p(20)}', 4, '>')} AS lower"))
SQL["ind_moving"] = with_(NATION, BARS.format(", ".join(f"{f(n, f'{g}({c}) OVER {w(n)}')} AS {name}" for name, n, g, c in (("sma", 20, "avg", "close"), ("sma_volume", 10, "avg", "volume"), ("max_close", 20, "max", "close"), ("max_high", 20, "max", "high"), ("min_close", 20, "min", "close"), ("min_low", 20, "min", "low"), ("std", 20, "stddev_pop", "close"))) + f", {f(50, f'close / max(close) OVER {w(50)}')} AS proximity"))
MID, DEV = f"avg(close) OVER {w(20)}", f"stddev_pop(close) OVER {w(20)}"
SQL["ind_bollinger"] = with_(NATION, BARS.format(f"{f(20, MID)} AS middle, {f(20, f'{MID} + 2 * {DEV}')} AS upper, {f(20, f'{MID} - 2 * {DEV}')} AS lower, {f(20, f'4 * {DEV} / {MID}')} AS bandwidth"))
T = f"t AS (SELECT *, {TR} AS tr FROM b)"
SQL["ind_starc"] = with_(f"{NATION}, {T}", f"SELECT symbol, ts, {r4('tr')} AS true_range, {f(10, f'avg(tr) OVER {w(10)}')} AS atr, {f(20, MID)} AS middle, {f(20, f'{MID} + 2 * avg(tr) OVER {w(10)}')} AS upper, {f(20, f'{MID} - 2 * avg(tr) OVER {w(10)}')} AS lower FROM t")
SQL["ind_aroon"] = with_(NATION, BARS.format(f"{f(25, f'100.0 * (25 - (rn - arg_max(rn, (high, rn)) OVER {w(25)})) / 25')} AS up, {f(25, f'100.0 * (25 - (rn - arg_min(rn, (low, -rn)) OVER {w(25)})) / 25')} AS down"))
SQL["ind_oscillators"] = with_(
    f"{NATION}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM b), m AS (SELECT *, avg(tp) OVER {w(20)} AS mean, list(tp) OVER {w(20)} AS tps FROM t), c AS (SELECT *, list_sum(list_transform(tps, lambda x: abs(x - mean))) / 20 AS md FROM m)",
    f"SELECT symbol, ts, {f(20, 'CASE WHEN md = 0 THEN 0 ELSE (tp - mean) / (0.015 * md) END')} AS cci, {f(14, f'CASE WHEN max(high) OVER {w(14)} = min(low) OVER {w(14)} THEN -50 ELSE -100 * (max(high) OVER {w(14)} - close) / (max(high) OVER {w(14)} - min(low) OVER {w(14)}) END')} AS williams, "
    f"{r4(f'100 * (close - lag(close, 10) OVER ({S})) / lag(close, 10) OVER ({S})')} AS roc, {r4(f'close / lag(close, 50) OVER ({S}) - 1')} AS momentum FROM c",
)
SQL["ind_stochastic"] = with_(
    f"{NATION}, k0 AS (SELECT *, CASE WHEN rn >= 10 THEN CASE WHEN max(high) OVER {w(10)} = min(low) OVER {w(10)} THEN 50.0 ELSE 100 * (close - min(low) OVER {w(10)}) / (max(high) OVER {w(10)} - min(low) OVER {w(10)}) END END AS raw FROM b), k1 AS (SELECT *, CASE WHEN rn >= 14 THEN avg(raw) OVER {w(5)} END AS k FROM k0), k2 AS (SELECT *, CASE WHEN rn >= 18 THEN avg(k) OVER {w(5)} END AS d FROM k1)",
    f"SELECT symbol, ts, CASE WHEN d IS NOT NULL THEN {r4('k')} END AS stoch_k, {r4('d')} AS stoch_d FROM k2",
)
HALF = lambda n: f"(max(high) OVER {w(n)} + min(low) OVER {w(n)}) / 2"
SQL["ind_ichimoku"] = with_(
    f"{NATION}, i AS (SELECT *, CASE WHEN rn >= 52 THEN {HALF(9)} END AS t, CASE WHEN rn >= 52 THEN {HALF(26)} END AS kj, CASE WHEN rn >= 52 THEN {HALF(52)} END AS sb FROM b), j AS (SELECT *, (t + kj) / 2 AS sa FROM i)",
    f"SELECT symbol, ts, {r4('t')} AS tenkan, {r4('kj')} AS kijun, {r4('sa')} AS senkou_a, {r4('sb')} AS senkou_b, CASE WHEN close > greatest(sa, sb) THEN 'above' WHEN close < least(sa, sb) THEN 'below' WHEN sb IS NOT NULL THEN 'inside' END AS cloud FROM j",
)
PM = "PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts"
SQL["ind_ranges"] = with_(
    f"{NATION}, q AS (SELECT *, row_number() OVER ({PM}) AS i, coalesce(ph - pl, 0) AS pr FROM b)",
    f"SELECT symbol, ts, {r4('pr')} AS prior_range, {r4('open + 0.5 * pr')} AS level_up, {r4('open - 0.5 * pr')} AS level_down, {r4('CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END')} AS plus_dm, {r4('CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END')} AS minus_dm, "
    f"{r4(f'max(CASE WHEN i <= 2 THEN high END) OVER ({PM} ROWS UNBOUNDED PRECEDING)')} AS or_high, {r4(f'min(CASE WHEN i <= 2 THEN low END) OVER ({PM} ROWS UNBOUNDED PRECEDING)')} AS or_low, i >= 2 AS or_complete FROM q",
)


# recurrences: one step of a recursive query per bar
def ema(n: int, k: str, x: str, rel: str, name: str) -> str:
    """CTE of (symbol, rn, v): seeded by the mean of the first n values of x, which begin at the first bar where it isn't null."""
    return (
        f"{name}_x AS (SELECT symbol, rn, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS j FROM {rel} WHERE {x} IS NOT NULL), {name}_s AS (SELECT symbol, avg(x) AS seed FROM {name}_x WHERE j <= {n} GROUP BY symbol HAVING count(*) = {n}), "
        f"{name} AS (SELECT e.symbol, e.rn, e.j, s.seed AS v FROM {name}_x e JOIN {name}_s s USING (symbol) WHERE e.j = {n} UNION ALL SELECT x.symbol, x.rn, x.j, x.x * ({k}) + {name}.v * (1 - ({k})) FROM {name} JOIN {name}_x x ON x.symbol = {name}.symbol AND x.j = {name}.j + 1)"
    )


def recursive(ctes: str, rest: str) -> str:
    return f"WITH RECURSIVE {ctes} {rest}"


SQL["rec_ema"] = recursive(
    f"{NATION}, {ema(20, '2.0::DOUBLE / 21', 'close', 'b', 'e1')}, {ema(14, '1.0::DOUBLE / 14', 'close', 'b', 'e2')}, ad AS (SELECT symbol, rn, close AS a, 1.0::DOUBLE AS z FROM b WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, ad.a * (1 - 2.0::DOUBLE / 21) + b.close, ad.z * (1 - 2.0::DOUBLE / 21) + 1 FROM ad JOIN b ON b.symbol = ad.symbol AND b.rn = ad.rn + 1)",
    f"SELECT b.symbol, b.ts, {r4('e1.v')} AS ema, {r4('e2.v')} AS wilder, CASE WHEN b.rn >= 20 THEN {r4('ad.a / ad.z')} END AS ema_adjusted FROM b LEFT JOIN e1 ON e1.symbol = b.symbol AND e1.rn = b.rn LEFT JOIN e2 ON e2.symbol = b.symbol AND e2.rn = b.rn JOIN ad ON ad.symbol = b.symbol AND ad.rn = b.rn",
)
RSI_MEANS = f"ch AS (SELECT symbol, rn, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS dn FROM b WHERE pc IS NOT NULL), {ema(14, '1.0::DOUBLE / 14', 'up', 'ch', 'u')}, {ema(14, '1.0::DOUBLE / 14', 'dn', 'ch', 'n')}"
RSI_VALUE = r4("CASE WHEN n.v = 0 THEN 100 ELSE 100 - 100 / (1 + u.v / n.v) END")
LINES = f"{ema(12, '2.0::DOUBLE / 13', 'close', 'b', 'f')}, {ema(26, '2.0::DOUBLE / 27', 'close', 'b', 's')}, ln AS (SELECT f.symbol, f.rn, f.v - s.v AS line FROM f JOIN s ON s.symbol = f.symbol AND s.rn = f.rn), {ema(9, '2.0::DOUBLE / 10', 'line', 'ln', 'g')}"
SQL["rec_rsi_macd"] = recursive(
    f"{NATION}, ch AS (SELECT symbol, rn, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS dn FROM b WHERE pc IS NOT NULL), {ema(14, '1.0::DOUBLE / 14', 'up', 'ch', 'u')}, {ema(14, '1.0::DOUBLE / 14', 'dn', 'ch', 'n')}, {ema(12, '2.0::DOUBLE / 13', 'close', 'b', 'f')}, {ema(26, '2.0::DOUBLE / 27', 'close', 'b', 's')}, "
    f"ln AS (SELECT f.symbol, f.rn, f.v - s.v AS line FROM f JOIN s ON s.symbol = f.symbol AND s.rn = f.rn), {ema(9, '2.0::DOUBLE / 10', 'line', 'ln', 'g')}",
    f"SELECT b.symbol, b.ts, {r4('CASE WHEN n.v = 0 THEN 100 ELSE 100 - 100 / (1 + u.v / n.v) END')} AS rsi, CASE WHEN g.v IS NOT NULL THEN {r4('ln.line')} END AS macd, {r4('g.v')} AS macd_signal, {r4('ln.line - g.v')} AS macd_hist FROM b LEFT JOIN u ON u.symbol = b.symbol AND u.rn = b.rn LEFT JOIN n ON n.symbol = b.symbol AND n.rn = b.rn LEFT JOIN ln ON ln.symbol = b.symbol AND ln.rn = b.rn LEFT JOIN g ON g.symbol = b.symbol AND g.rn = b.rn",
)
SQL["rec_dmi"] = recursive(
    f"{NATION}, m AS (SELECT symbol, rn, coalesce({TR}, high - low) AS tr, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pd, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS md FROM b), {ema(14, '1.0::DOUBLE / 14', 'tr', 'm', 'a')}, {ema(14, '1.0::DOUBLE / 14', 'pd', 'm', 'u')}, {ema(14, '1.0::DOUBLE / 14', 'md', 'm', 'n')}, "
    f"di AS (SELECT a.symbol, a.rn, CASE WHEN a.v = 0 THEN 0 ELSE 100 * u.v / a.v END AS p, CASE WHEN a.v = 0 THEN 0 ELSE 100 * n.v / a.v END AS q FROM a JOIN u USING (symbol, rn) JOIN n USING (symbol, rn)), dx AS (SELECT *, CASE WHEN p + q = 0 THEN 0 ELSE 100 * abs(p - q) / (p + q) END AS dx FROM di), {ema(14, '1.0::DOUBLE / 14', 'dx', 'dx', 'ax')}",
    f"SELECT b.symbol, b.ts, {r4('di.p')} AS plus_di, {r4('di.q')} AS minus_di, {r4('ax.v')} AS adx FROM b LEFT JOIN di ON di.symbol = b.symbol AND di.rn = b.rn LEFT JOIN ax ON ax.symbol = b.symbol AND ax.rn = b.rn",
)
SQL["rec_heikin_ashi"] = recursive(
    f"{NATION}, h AS (SELECT symbol, rn, (open + close) / 2 AS ho, (open + high + low + close) / 4 AS hc FROM b WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, (h.ho + h.hc) / 2, (b.open + b.high + b.low + b.close) / 4 FROM h JOIN b ON b.symbol = h.symbol AND b.rn = h.rn + 1)",
    f"SELECT b.symbol, b.ts, round(ho, 6) + 0.0 AS ha_open, round(greatest(high, ho, hc), 6) + 0.0 AS ha_high, round(least(low, ho, hc), 6) + 0.0 AS ha_low, round(hc, 6) + 0.0 AS ha_close FROM b JOIN h ON h.symbol = b.symbol AND h.rn = b.rn",
)


def supertrend(k: float, classic: bool, name: str) -> str:
    lo, hi = ("<", ">") if classic else (">", "<")
    return (
        f"{name} AS (SELECT symbol, rn, close, mid + {k} * atr AS u, mid - {k} * atr AS l, TRUE AS up FROM st0 WHERE rn = 10 UNION ALL SELECT symbol, rn, close, u, l, CASE WHEN up THEN close >= l ELSE close > u END FROM (SELECT x.symbol, x.rn, x.close, CASE WHEN x.mid + {k} * x.atr {lo} s.u OR s.close > s.u THEN x.mid + {k} * x.atr ELSE s.u END AS u, "
        f"CASE WHEN x.mid - {k} * x.atr {hi} s.l OR s.close < s.l THEN x.mid - {k} * x.atr ELSE s.l END AS l, s.up FROM {name} s JOIN st0 x ON x.symbol = s.symbol AND x.rn = s.rn + 1))"
    )


SQL["rec_supertrend"] = recursive(
    f"{NATION}, {T}, st0 AS (SELECT symbol, rn, close, (high + low) / 2 AS mid, avg(coalesce(tr, high - low)) OVER {w(10)} AS atr FROM t), {supertrend(0.3, False, 's1')}, {supertrend(0.3, True, 's2')}",
    f"SELECT b.symbol, b.ts, s1.up::INT AS st_up, {r4('CASE WHEN s1.up THEN s1.l ELSE s1.u END')} AS st_value, s2.up::INT AS classic_up, {r4('CASE WHEN s2.up THEN s2.l ELSE s2.u END')} AS classic_value FROM b LEFT JOIN s1 ON s1.symbol = b.symbol AND s1.rn = b.rn LEFT JOIN s2 ON s2.symbol = b.symbol AND s2.rn = b.rn",
)
SQL["rec_parabolic_sar"] = recursive(
    f"{NATION}, z AS (SELECT *, lag(high, 2) OVER ({S}) AS ph2, lag(low, 2) OVER ({S}) AS pl2, max(high) OVER {w(5)} AS h5, min(low) OVER {w(5)} AS l5, lag(close, 4) OVER ({S}) AS c5 FROM b), ps AS (SELECT symbol, rn, close >= c5 AS up, CASE WHEN close >= c5 THEN l5 ELSE h5 END AS sar, CASE WHEN close >= c5 THEN h5 ELSE l5 END AS ep, 0.02::DOUBLE AS af FROM z WHERE rn = 5 "
    "UNION ALL SELECT symbol, rn, CASE WHEN flip THEN NOT up ELSE up END, CASE WHEN flip THEN ep ELSE s END, CASE WHEN flip THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(ep, high) ELSE least(ep, low) END, CASE WHEN flip THEN 0.02 WHEN (up AND high > ep) OR (NOT up AND low < ep) THEN least(af + 0.02, 0.2) ELSE af END FROM "
    "(SELECT *, CASE WHEN up THEN close < s ELSE close > s END AS flip FROM (SELECT z.symbol, z.rn, z.high, z.low, z.close, ps.up, ps.ep, ps.af, CASE WHEN ps.up THEN least(ps.sar + ps.af * (ps.ep - ps.sar), z.pl, z.pl2) ELSE greatest(ps.sar + ps.af * (ps.ep - ps.sar), z.ph, z.ph2) END AS s FROM ps JOIN z ON z.symbol = ps.symbol AND z.rn = ps.rn + 1)))",
    f"SELECT b.symbol, b.ts, {r4('ps.sar')} AS sar, ps.up::INT AS sar_up FROM b LEFT JOIN ps ON ps.symbol = b.symbol AND ps.rn = b.rn",
)

# strategies: (further CTEs, relation, entry, exit, entry_short, exit_short); null counts as false
SIG: dict[str, tuple] = {}
DC = f"t AS (SELECT *, max(high) OVER {p(20)} AS u, min(low) OVER {p(20)} AS l, max(high) OVER {p(10)} AS u2, min(low) OVER {p(10)} AS l2 FROM b)"
SIG["donchian"] = (DC, "t", "rn > 20 AND close > u", "rn > 20 AND close < l2", "rn > 20 AND close < l", "rn > 20 AND close > u2")
MC = f"m AS (SELECT *, avg(close) OVER {w(10)} > avg(close) OVER {w(50)} AS above FROM b), t AS (SELECT *, CASE WHEN rn > 50 THEN lag(above) OVER ({S}) END AS was FROM m)"
SIG["ma_cross"] = (MC, "t", "above AND NOT was", "NOT above AND was", "NOT above AND was", "above AND NOT was")
TS = f"t AS (SELECT *, lag(close, 50) OVER ({S}) AS c0 FROM b)"
SIG["tsmom"] = (TS, "t", "close > c0", "close < c0", "close < c0", "close > c0")
SIG["hold"] = ("t AS (SELECT * FROM b)", "t", "FALSE", "FALSE")
SIG["starc"] = (f"{T.replace('t AS', 't0 AS')}, t AS (SELECT *, {MID} AS m, avg(tr) OVER {w(15)} AS a FROM t0)", "t", "rn > 20 AND close > m + 0.1 * a", "rn > 20 AND close < m - 0.1 * a", "rn > 20 AND close < m - 0.1 * a", "rn > 20 AND close > m + 0.1 * a")
SIG["high_52w"] = (f"t AS (SELECT *, close / max(close) OVER {w(52)} AS x FROM b)", "t", "rn > 52 AND x >= 0.9", "rn > 52 AND x < 0.5")
SIG["high_52w_momentum"] = (f"t AS (SELECT *, close / max(close) OVER {w(52)} AS x, 100 * (close - lag(close, 20) OVER ({S})) / lag(close, 20) OVER ({S}) AS roc FROM b)", "t", "rn > 52 AND x >= 0.9 AND roc >= 0", "rn > 52 AND x < 0.5")
BB = f"t0 AS (SELECT *, {MID} AS m, {DEV} AS s FROM b), t AS (SELECT *, coalesce(2 * 0.5 * s / m < 0.5 AND rn >= 20, FALSE) AS tight, coalesce(lag(2 * 0.5 * s / m < 0.5 AND rn >= 20) OVER ({S}), FALSE) AS tight0 FROM t0)"
SIG["bollinger_squeeze"] = (BB, "t", "rn > 20 AND (tight OR tight0) AND close > m + 0.5 * s", "rn > 20 AND close < m")
SIG["larry_williams"] = (f"{T.replace('t AS', 't0 AS')}, t AS (SELECT *, avg(tr) OVER {w(14)} AS a, max(high) OVER {w(5)} AS top FROM t0)", "t", "rn > 14 AND close > open + 0.5 * (ph - pl)", "rn > 14 AND close < top - 2 * a")
OR_ = f"t AS (SELECT *, max(high) OVER {p(5)} AS u, min(low) OVER {p(5)} AS l FROM b)"
SIG["opening_range"] = (OR_, "t", "rn > 5 AND close > u", "rn > 5 AND close < l", "rn > 5 AND close < l", "rn > 5 AND close > u")


def crossing(ctes: str, x: str, warm: int, low: float, high: float) -> tuple:
    """x goes over ``low``: entry; under ``high``: exit."""
    return (f"{ctes}, t AS (SELECT *, lag({x}) OVER ({S}) AS x0, {x} AS x1 FROM z)", "t", f"rn > {warm} AND x0 <= {low} AND x1 > {low}", f"rn > {warm} AND x0 >= {high} AND x1 < {high}")


SIG["roc"] = crossing(f"z AS (SELECT *, 100 * (close - lag(close, 12) OVER ({S})) / lag(close, 12) OVER ({S}) AS v FROM b)", "v", 13, 0, 0)
SIG["williams_r"] = crossing(f"z AS (SELECT *, CASE WHEN rn >= 14 THEN CASE WHEN max(high) OVER {w(14)} = min(low) OVER {w(14)} THEN -50 ELSE -100.0 * (max(high) OVER {w(14)} - close) / (max(high) OVER {w(14)} - min(low) OVER {w(14)}) END END AS v FROM b)", "v", 15, -80, -20)
CCI = f"z0 AS (SELECT *, (high + low + close) / 3 AS tp FROM b), z1 AS (SELECT *, avg(tp) OVER {w(20)} AS mean, list(tp) OVER {w(20)} AS tps FROM z0), z2 AS (SELECT *, list_sum(list_transform(tps, lambda x: abs(x - mean))) / 20 AS md FROM z1), z AS (SELECT *, CASE WHEN rn >= 20 THEN CASE WHEN md = 0 THEN 0 ELSE (tp - mean) / (0.015 * md) END END AS v FROM z2)"
SIG["cci"] = crossing(CCI, "v", 21, -100, 100)
AR = f"z0 AS (SELECT *, arg_max(rn, (high, rn)) OVER {w(25)} AS hi, arg_min(rn, (low, -rn)) OVER {w(25)} AS lo FROM b), z AS (SELECT *, CASE WHEN rn >= 25 THEN 100.0 * (25 - (rn - hi)) / 25 - 100.0 * (25 - (rn - lo)) / 25 END AS v FROM z0)"
_a = crossing(AR, "v", 25, 0, 0)
SIG["aroon"] = (*_a, _a[3], _a[2])
for _name, (_ctes, _rel, *_tests) in SIG.items():
    _cols = ", ".join(f"coalesce({t}, FALSE) AS {c}" for t, c in zip(_tests, ("raw_entry", "raw_exit", "raw_entry_short", "raw_exit_short"), strict=False))
    SQL[f"str_{_name}"] = with_(f"{NATION}, {_ctes}", f"SELECT symbol, ts, {_cols} FROM {_rel}")

# simulation: a state machine, one bar a step
SIM = f"""{DC}, s AS (SELECT symbol, ts, rn, open, close, coalesce(rn > 20 AND close > u, FALSE) AS e, coalesce(rn > 20 AND close < l2, FALSE) AS x FROM t),
m AS (SELECT symbol, rn, 0 AS pos, FALSE AS ef, FALSE AS xf, NULL::DOUBLE AS price, 1000000.0::DOUBLE AS cash, NULL::DOUBLE AS ep, NULL::TIMESTAMP AS et FROM s WHERE rn = 1
  UNION ALL SELECT s.symbol, s.rn, CASE WHEN m.pos = 0 AND y.e THEN 1 WHEN m.pos = 1 AND y.x THEN 0 ELSE m.pos END, m.pos = 0 AND y.e, m.pos = 1 AND y.x,
  CASE WHEN m.pos = 0 AND y.e THEN s.open * 1.0005 WHEN m.pos = 1 AND y.x THEN s.open * 0.9995 END,
  m.cash + CASE WHEN m.pos = 0 AND y.e THEN -s.open * 1.0005 * 1.001 WHEN m.pos = 1 AND y.x THEN s.open * 0.9995 * 0.999 ELSE 0 END,
  CASE WHEN m.pos = 0 AND y.e THEN s.open * 1.0005 ELSE m.ep END, CASE WHEN m.pos = 0 AND y.e THEN s.ts ELSE m.et END
  FROM m JOIN s ON s.symbol = m.symbol AND s.rn = m.rn + 1 JOIN s y ON y.symbol = m.symbol AND y.rn = m.rn),
q AS (SELECT s.symbol, s.ts, s.rn, m.pos, m.ef, m.xf, m.price, m.price * 0.001 AS fees, m.cash, m.cash + m.pos * s.close AS equity, m.ep, m.et, CASE WHEN m.xf THEN m.price - m.ep END AS gross, CASE WHEN m.xf THEN m.price - m.ep - (m.price + m.ep) * 0.001 END AS net FROM m JOIN s USING (symbol, rn))"""
SQL["bt_long_only"] = recursive(f"{NATION}, {SIM}", f"SELECT symbol, ts, pos AS position_state, ef AS entry_fill, xf AS exit_fill, {r4('price')} AS fill_price, {r4('fees')} AS fill_fees, {r4('cash')} AS cash, {r4('equity')} AS equity FROM q")
SQL["bt_trades"] = recursive(f"{NATION}, {SIM}", f"SELECT symbol, et AS entry_ts, ts AS exit_ts, {r4('ep')} AS entry_price, {r4('price')} AS exit_price, {r4('gross')} AS gross_pnl, {r4('net')} AS net_pnl FROM q WHERE xf")
SQL["bt_paired_fills"] = recursive(f"{NATION}, {SIM}", f"SELECT symbol, et AS entry_ts, ts AS exit_ts, {r4('ep')} AS entry_price, {r4('price')} AS exit_price FROM q WHERE xf")
RET = f"rt AS (SELECT *, CASE WHEN lag(equity) OVER ({S}) IS NULL THEN NULL WHEN abs(lag(equity) OVER ({S})) > 1e-10 THEN (equity - lag(equity) OVER ({S})) / lag(equity) OVER ({S}) ELSE 0 END AS ret, max(equity) OVER ({S} ROWS UNBOUNDED PRECEDING) AS peak FROM {{}}), rd AS (SELECT *, CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END AS dd FROM rt)"
SHARPE = "coalesce(CASE WHEN stddev_pop({0}) > 0 THEN avg({0}) * 252 / (stddev_pop({0}) * sqrt(252)) END, 0)"
SQL["met_metrics"] = recursive(
    f"{NATION}, {SIM}, {RET.format('q')}, a AS (SELECT symbol, arg_max(equity, ts) AS fe, date_diff('second', min(ts), max(ts)) // 86400 / 365.25::DOUBLE AS years, {SHARPE.format('ret')} AS sharpe, avg(ret) AS mr, sqrt(avg(CASE WHEN ret < 0 THEN ret * ret WHEN ret IS NOT NULL THEN 0 END)) AS bad, max(dd) AS max_drawdown, count(net) AS n, count(*) FILTER (net > 0) AS wins, coalesce(sum(net) FILTER (net > 0), 0) AS won, coalesce(-sum(net) FILTER (net < 0), 0) AS lost, coalesce(sum(abs(price)), 0) AS traded FROM rd GROUP BY symbol), c AS (SELECT *, CASE WHEN years <= 0 THEN 0 WHEN fe <= 0 THEN -1 ELSE pow(fe / 1000000, 1 / years) - 1 END AS cagr FROM a)",
    f"SELECT symbol, {r4('fe')} AS final_equity, {r4('(fe - 1000000) / 1000000')} AS total_return, {r4('cagr')} AS cagr, {r4('sharpe')} AS sharpe, {r4('CASE WHEN bad > 0 THEN mr * 252 / (bad * sqrt(252)) ELSE 0 END')} AS sortino, {r4('max_drawdown')} AS max_drawdown, {r4('CASE WHEN max_drawdown > 0 THEN cagr / max_drawdown ELSE 0 END')} AS calmar, {r4('CASE WHEN n > 0 THEN wins::DOUBLE / n ELSE 0 END')} AS win_rate, {r4('CASE WHEN lost > 0 THEN least(won / lost, 999.99) WHEN won > 0 THEN 999.99 ELSE 0 END')} AS profit_factor, n AS num_trades, {r4('CASE WHEN years > 0 AND (1000000 + fe) / 2 > 0 THEN traded / ((1000000 + fe) / 2) / years ELSE 0 END')} AS turnover FROM c",
)
SQL["met_streaks"] = recursive(
    f"{NATION}, {SIM}, tr AS (SELECT symbol, ts, net > 0 AS win FROM q WHERE xf), g AS (SELECT *, row_number() OVER ({S}) - row_number() OVER (PARTITION BY symbol, win ORDER BY ts) AS run FROM tr), h AS (SELECT symbol, win, run, count(*) AS n FROM g GROUP BY 1, 2, 3)",
    f"SELECT symbol, coalesce(max(n) FILTER (NOT win), 0) AS max_losses, coalesce(max(n) FILTER (win), 0) AS max_wins, {r4('coalesce(avg(n) FILTER (NOT win), 0)')} AS avg_losing_streak FROM h GROUP BY symbol",
)
SQL["out_drawdown_curve"] = recursive(f"{NATION}, {SIM}, {RET.format('q')}", f"SELECT symbol, ts, {r4('(equity - peak) / peak')} AS drawdown FROM rd")
SQL["ana_drawdown_regimes"] = recursive(f"{NATION}, {SIM}, {RET.format('q')}", "SELECT symbol, ts, CASE WHEN dd < 0.05 THEN 'normal' WHEN dd < 0.1 THEN 'shallow' WHEN dd < 0.2 THEN 'deep' ELSE 'recovery' END AS regime FROM rd")
SQL["ana_excursions"] = recursive(
    f"{NATION}, {SIM}, tr AS (SELECT symbol, et, ts AS xt, ep, price FROM q WHERE xf)",
    f"SELECT tr.symbol, et AS entry_ts, xt AS exit_ts, {r4('greatest(max((ep - low) / ep), 0)')} AS mae, {r4('greatest(max((high - ep) / ep), 0)')} AS mfe, count(*) AS bars_held, {r4('(any_value(price) - any_value(ep)) / any_value(ep)')} AS ret FROM tr JOIN b ON b.symbol = tr.symbol AND b.ts BETWEEN et AND xt GROUP BY tr.symbol, et, xt",
)

# tables of results
SQL["rel_query"] = with_(RESULT, "SELECT symbol, config_id, sharpe, max_drawdown FROM r WHERE sharpe >= -0.2 AND max_drawdown <= 0.9 AND num_trades >= 5 AND win_rate >= 0.3 ORDER BY sharpe DESC, symbol, config_id LIMIT 50")
SQL["rel_top_per_sector"] = with_(RESULT, "SELECT sector, symbol, config_id, sharpe, rank FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY sharpe DESC, symbol, config_id)::INT AS rank FROM r) WHERE rank <= 3")
SQL["rel_heatmap"] = with_(RESULT, "SELECT symbol, strategy_type, entry_lookback, exit_lookback, sharpe AS value FROM r")
SQL["rel_split"] = with_(NATION, "SELECT symbol, CASE WHEN ts < '1998-01-01' THEN 'train' ELSE 'test' END AS part, count(*) AS bars, min(ts) AS first, max(ts) AS last FROM b WHERE ts < '1998-01-01' OR ts >= '1998-01-31' GROUP BY 1, 2")
SQL["rel_slice"] = with_(NATION, f"SELECT symbol, ts, {r4('close')} AS close FROM b WHERE rn > 10 AND rn <= 20")
SQL["agg_summary"] = with_(RESULT, f"SELECT {r4('avg(sharpe)')} AS avg_sharpe, max(sharpe) AS max_sharpe, min(sharpe) AS min_sharpe, {r4('avg(cagr)')} AS avg_cagr, {r4('avg(max_drawdown)')} AS avg_drawdown, {r4('avg(num_trades)')} AS avg_trades FROM r")
SQL["agg_sensitivity"] = with_(RESULT, " UNION ALL ".join(f"SELECT '{c}' AS parameter, {c}::VARCHAR AS param_value, {r4('avg(sharpe)')} AS mean, {r4('var_pop(sharpe)')} AS variance, count(*) AS count FROM r GROUP BY {c}" for c in ("entry_lookback", "exit_lookback")))
SQL["agg_compare"] = with_(RESULT, f"SELECT strategy_type, count(*) AS n_configs, {r4('avg(sharpe)')} AS avg_sharpe, max(sharpe) AS best_sharpe, min(sharpe) AS worst_sharpe, {r4('avg(cagr)')} AS avg_cagr, max(cagr) AS best_cagr, {r4('avg(max_drawdown)')} AS avg_drawdown, max(max_drawdown) AS worst_drawdown, {r4('avg(num_trades)')} AS avg_trades FROM r GROUP BY 1")
SQL["agg_strategy_summary"] = with_(RESULT, "SELECT strategy_type, count(*) AS n, count(DISTINCT symbol) AS symbols, " + ", ".join(f"{r4(f'{g}({c})')} AS {n}_{c}" for c in ("sharpe", "cagr", "max_drawdown") for n, g in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"))) + " FROM r GROUP BY 1")
SQL["agg_symbol_summary"] = with_(RESULT, f"SELECT symbol, count(*) AS n, {r4('avg(sharpe)')} AS mean_sharpe, {r4('median(sharpe)')} AS median_sharpe, max(sharpe) AS max_sharpe, {r4('avg(cagr)')} AS mean_cagr, {r4('avg(max_drawdown)')} AS mean_drawdown FROM r GROUP BY 1")
SQL["agg_matrix"] = with_(RESULT, "SELECT strategy_type, " + ", ".join(f"round(avg(sharpe) FILTER (symbol = 'NATION_{i}'), 4) + 0.0 AS \"NATION_{i}\"" for i in range(25)) + " FROM r GROUP BY 1")
SQL["agg_robustness"] = with_(RESULT, f"SELECT strategy_type, config_id, count(DISTINCT symbol) AS symbols, {r4('avg(sharpe)')} AS mean_sharpe, {r4('stddev_samp(sharpe)')} AS std_sharpe, min(sharpe) AS min_sharpe, max(sharpe) AS max_sharpe, {r4('avg((sharpe > 0)::INT)')} AS win_ratio, {r4('avg(sharpe) - 0.5 * coalesce(stddev_samp(sharpe), 0)')} AS robust_score, {r4('avg(sharpe) / (1 + coalesce(stddev_samp(sharpe), 0))')} AS robustness FROM r GROUP BY 1, 2 HAVING count(DISTINCT symbol) >= 10")
SQL["agg_top_performers"] = with_(RESULT, f"SELECT strategy_type, count(*) AS total, count(*) FILTER (k <= greatest(1, floor(n * 0.1))) AS in_top, {r4('100.0 * count(*) FILTER (k <= greatest(1, floor(n * 0.1))) / count(*)')} AS pct_in_top FROM (SELECT *, rank() OVER (ORDER BY sharpe DESC) AS k, count(*) OVER () AS n FROM r) GROUP BY 1")
SQL["agg_universal_winners"] = with_(RESULT + ", p AS (SELECT *, (rank() OVER (PARTITION BY symbol ORDER BY sharpe DESC) + (count(*) OVER (PARTITION BY symbol, sharpe) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY symbol) AS q FROM r)", f"SELECT strategy_type, config_id, count(DISTINCT symbol) AS symbols, count(*) FILTER (q <= 0.5) AS top_half, count(*) FILTER (q <= 0.25) AS top_quarter, count(*) FILTER (q <= 0.1) AS top_tenth, {r4('avg(q)')} AS mean_percentile FROM p GROUP BY 1, 2 HAVING count(DISTINCT symbol) >= 10")
SQL["agg_parameters"] = with_(RESULT + ", k AS (SELECT *, row_number() OVER (PARTITION BY strategy_type ORDER BY sharpe DESC, symbol, config_id) AS i, count(*) OVER (PARTITION BY strategy_type) AS n FROM r)", f"SELECT strategy_type, {r4('avg(entry_lookback) FILTER (i <= greatest(1, floor(n * 0.25)))')} AS mean_best, (min(entry_lookback) FILTER (i <= greatest(1, floor(n * 0.25))))::DOUBLE AS min_best, (max(entry_lookback) FILTER (i <= greatest(1, floor(n * 0.25))))::DOUBLE AS max_best, {r4('corr(entry_lookback, sharpe)')} AS correlation FROM k GROUP BY 1")
for _key, _cols in (("symbol", "symbol, config_id, sharpe"), ("strategy_type", "strategy_type, symbol, config_id, sharpe")):
    SQL["agg_best_per_symbol" if _key == "symbol" else "agg_best_per_strategy"] = with_(RESULT, f"SELECT {_cols} FROM (SELECT *, row_number() OVER (PARTITION BY {_key} ORDER BY (num_trades > 0) DESC, sharpe DESC, symbol, config_id) AS i FROM r) WHERE i = 1")
SQL["agg_combos"] = with_(RESULT + ", x AS (SELECT *, unnest([strategy_type, 'p' || iteration]) AS component FROM r)", f"SELECT component, count(*) AS n, {r4('avg(sharpe)')} AS mean_sharpe, {r4('median(sharpe)')} AS median_sharpe, count(DISTINCT config_id) AS configs, {r4('100.0 * count(DISTINCT config_id) / (SELECT count(DISTINCT config_id) FROM r)')} AS pct_of_combos FROM x GROUP BY 1")
SQL["agg_synergy"] = with_(RESULT + ", a AS (SELECT strategy_type, avg(sharpe) AS own FROM r GROUP BY 1)", f"SELECT symbol, config_id || '+' || o.strategy_type AS config_id, {r4('sharpe')} AS sharpe, {r4('(a.own + o.own) / 2')} AS expected, {r4('sharpe - (a.own + o.own) / 2')} AS synergy FROM r JOIN a USING (strategy_type), a o")
SQL["agg_combo_single"] = with_(RESULT, f"SELECT iteration > 2 AS is_combo, count(*) AS n, {r4('avg(sharpe)')} AS mean_sharpe, {r4('median(sharpe)')} AS median_sharpe, max(sharpe) AS max_sharpe, {r4('100 * avg((sharpe > 0)::INT)')} AS pct_positive FROM r GROUP BY 1")
SQL["agg_entropy"] = with_(RESULT + ", m AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((max_drawdown - lo) * 20 / (hi - lo)), 19) END AS bin, count(*) AS n FROM r, (SELECT min(max_drawdown) AS lo, max(max_drawdown) AS hi FROM r) GROUP BY 1)", f"SELECT {r4('-sum(n / t * log2(n / t))')} AS entropy, count(*) AS bins_used FROM m, (SELECT sum(n)::DOUBLE AS t FROM m)")
SQL["agg_uniqueness"] = with_(RESULT + ", q AS (SELECT i.iteration, count(f.config_id) AS new_configs FROM (SELECT DISTINCT iteration FROM r) i LEFT JOIN (SELECT config_id, min(iteration) AS iteration FROM r GROUP BY 1) f ON f.iteration = i.iteration GROUP BY 1), u AS (SELECT *, (sum(new_configs) OVER (ORDER BY iteration))::BIGINT AS seen FROM q), e AS (SELECT min(iteration) AS lo, max(iteration) AS hi, arg_min(seen, iteration) AS first, max(seen) AS total FROM u)", f"SELECT iteration, new_configs, seen, (SELECT count(*) FROM r) AS total_tests, total AS unique_configs, {r4('1 - total / (SELECT count(*) FROM r)')} AS duplicate_ratio, {r4('CASE WHEN hi > lo THEN (total - first) / (hi - lo + 1) ELSE 0 END')} AS uniqueness_rate FROM u, e")
SQL["join_merge_boards"] = with_(RESULT, "SELECT symbol, config_id, sharpe FROM r WHERE sharpe > -1 OR sharpe < 0.2")
SQL["join_compare"] = "SELECT 'sharpe' AS metric, 0.001::DOUBLE AS max_diff, 0.001::DOUBLE AS mean_diff, FALSE AS within UNION ALL SELECT 'cagr', 0, 0, TRUE"
SQL["sec_performance"] = with_(RESULT, "SELECT sector, count(*) AS n, " + ", ".join(f"{r4(f'{g}({c})')} AS {n}_{c}" for c in ("sharpe", "cagr", "max_drawdown") for n, g in (("avg", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + f", {r4('avg(sortino)')} AS avg_sortino, {r4('avg(win_rate)')} AS avg_win_rate, {r4('avg(num_trades)')} AS avg_trades, sum(num_trades)::BIGINT AS total_trades FROM r GROUP BY 1")
SQL["sec_dispersion"] = with_(RESULT, "SELECT sector, count(sharpe) AS n, " + ", ".join(f"{r4(x)} AS \"{n}\"" for n, x in (("mean", "avg(sharpe)"), ("std", "stddev_pop(sharpe)"), ("min", "min(sharpe)"), ("max", "max(sharpe)"), ("median", "quantile_cont(sharpe, 0.5)"), ("q25", "quantile_cont(sharpe, 0.25)"), ("q75", "quantile_cont(sharpe, 0.75)"), ("range", "max(sharpe) - min(sharpe)"), ("cv", "stddev_pop(sharpe) / abs(avg(sharpe))"))) + " FROM r GROUP BY 1")
SQL["sec_universe"] = with_(RESULT + ", s AS (SELECT sector, " + ", ".join(f"avg({c}) - (SELECT avg({c}) FROM r) AS d_{c}" for c in ("sharpe", "cagr", "max_drawdown", "sortino")) + " FROM r GROUP BY 1)", "SELECT sector, " + ", ".join(f"{r4(f'd_{c}')} AS delta_{c}" for c in ("sharpe", "cagr", "max_drawdown", "sortino")) + f", {r4('2 * d_sharpe + d_cagr - d_max_drawdown + d_sortino')} AS relative_score FROM s")
SQL["sec_best"] = with_(RESULT + ", s AS (SELECT sector, strategy_type, count(*) AS n, avg(sharpe) AS a, max(sharpe) AS m FROM r GROUP BY 1, 2)", f"SELECT sector, strategy_type, n, {r4('a')} AS avg_metric, m AS max_metric FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY a DESC, strategy_type) AS i FROM s) WHERE i = 1")
SQL["sec_concentration"] = with_(RESULT + ", s AS (SELECT sector, sum(total_return) AS t FROM r GROUP BY 1)", f"SELECT sector, {r4('t')} AS total, {r4('100 * t / sum(t) OVER ()')} AS pct, {r4('100 * sum(t) OVER (ORDER BY t DESC, sector ROWS UNBOUNDED PRECEDING) / sum(t) OVER ()')} AS cumulative_pct FROM s")
SQL["sec_ranked"] = with_(RESULT + ", s AS (SELECT sector, avg(sharpe) AS a, avg(cagr) AS c, avg(max_drawdown) AS m FROM r GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY a DESC, sector)::INT AS i, row_number() OVER (ORDER BY c DESC, sector)::INT AS j, row_number() OVER (ORDER BY m, sector)::INT AS l FROM s)", f"SELECT sector, {r4('a')} AS avg_sharpe, {r4('c')} AS avg_cagr, {r4('m')} AS avg_drawdown, i AS sharpe_rank, j AS cagr_rank, l AS drawdown_rank, {r4('(i + j + l) / 3.0::DOUBLE')} AS composite_rank FROM k")
SQL["sec_strategies"] = with_(RESULT, f"SELECT strategy_type, sector, count(*) AS n, {r4('avg(sharpe)')} AS mean_sharpe, {r4('median(sharpe)')} AS median_sharpe FROM r GROUP BY 1, 2 HAVING count(*) >= 5")

# statistics
M3 = "(sum(pow(sharpe - m, 3)) / count(*))"
M4 = "(sum(pow(sharpe - m, 4)) / count(*))"
SQL["stat_sample"] = with_(RESULT + ", q AS (SELECT *, avg(sharpe) OVER (PARTITION BY sector) AS m FROM r)", "SELECT sector, count(*) AS n, " + ", ".join(f"{r4(x)} AS \"{n}\"" for n, x in (("mean", "avg(sharpe)"), ("std", "stddev_samp(sharpe)"), ("se", "stddev_samp(sharpe) / sqrt(count(*))"), ("min", "min(sharpe)"), ("max", "max(sharpe)"), ("median", "quantile_cont(sharpe, 0.5)"), ("q1", "quantile_cont(sharpe, 0.25)"), ("q3", "quantile_cont(sharpe, 0.75)"), ("skew", f"{M3} / pow(stddev_samp(sharpe), 3)"), ("kurtosis", f"{M4} / pow(stddev_samp(sharpe), 4) - 3"))) + " FROM q GROUP BY 1")
HELD = "q AS (SELECT *, close AS equity FROM b)"
SQL["ana_distribution"] = with_(
    f"{NATION}, {HELD}, {RET.format('q')}, k AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret, ts) AS i, count(*) OVER (PARTITION BY symbol) AS n, avg(ret) OVER (PARTITION BY symbol) AS m FROM rd WHERE ret IS NOT NULL)",
    "SELECT symbol, count(*) AS n, " + ", ".join(f"{r4(x)} AS {n}" for n, x in (("mean", "avg(ret)"), ("std", "stddev_pop(ret)"), ("skew", "(sum(pow(ret - m, 3)) / count(*)) / pow(stddev_pop(ret), 3)"), ("kurtosis", "(sum(pow(ret - m, 4)) / count(*)) / pow(stddev_pop(ret), 4) - 3"), ("var_95", "abs(max(ret) FILTER (i = round(0.05 * (n - 1)) + 1))"), ("var_99", "abs(max(ret) FILTER (i = round(0.01 * (n - 1)) + 1))"), ("cvar_95", "abs(avg(ret) FILTER (i <= greatest(ceil(0.05 * n), 1)))"), ("cvar_99", "abs(avg(ret) FILTER (i <= greatest(ceil(0.01 * n), 1)))"))) + " FROM k GROUP BY symbol",
)
SQL["ana_volatility_regimes"] = with_(
    f"{NATION}, {T}, a AS (SELECT symbol, ts, CASE WHEN rn >= 10 THEN avg(tr) OVER {w(10)} END AS atr FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY atr NULLS LAST, ts) AS i, count(atr) OVER (PARTITION BY symbol) AS n FROM a), m AS (SELECT symbol, max(atr) FILTER (i = round(0.5 * (n - 1)) + 1) AS med FROM k GROUP BY 1)",
    "SELECT a.symbol, a.ts, CASE WHEN atr > 1.5 * med THEN 'high' WHEN atr < 0.75 * med THEN 'low' ELSE 'neutral' END AS regime FROM a JOIN m ON m.symbol = a.symbol",
)
SQL["ana_trend_regimes"] = with_(f"{NATION}, a AS (SELECT symbol, ts, CASE WHEN rn >= 50 THEN avg(close) OVER {w(50)} END AS s FROM b), c AS (SELECT *, s / lag(s) OVER ({S}) - 1 AS x FROM a)", "SELECT symbol, ts, CASE WHEN x > 0.02 THEN 'strong_up' WHEN x > 0.005 THEN 'up' WHEN x < -0.02 THEN 'strong_down' WHEN x < -0.005 THEN 'down' ELSE 'neutral' END AS regime FROM c")
SQL["val_folds"] = "SELECT i AS fold, i * 63 AS is_start, i * 63 + 252 AS is_end, i * 63 + 257 AS oos_start, i * 63 + 320 AS oos_end FROM range(5) t(i)"
SQL["val_walk_forward"] = with_(
    f"{NATION}, {HELD}, {RET.format('q')}, n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1), fo AS (SELECT symbol, i AS fold FROM n, range(1000) t(i) WHERE i * 30 + 135 <= n), x AS (SELECT fo.symbol, fold, rd.ts, equity, ret, rn - 1 - fold * 30 AS pos FROM fo JOIN rd ON rd.symbol = fo.symbol AND rn - 1 >= fold * 30 AND rn - 1 < fold * 30 + 135)",
    f"SELECT symbol, fold::INT AS fold, {r4(SHARPE.format('CASE WHEN pos > 0 AND pos < 100 THEN ret END'))} AS is_sharpe, {r4(SHARPE.format('CASE WHEN pos > 105 THEN ret END'))} AS oos_sharpe, {r4('arg_max(equity, ts) / (arg_min(equity, ts) FILTER (pos >= 105)) - 1')} AS oos_return FROM x GROUP BY 1, 2",
)
LB = ", ".join(f"{r4(x)} AS {n}" for n, x in (("avg_sharpe", "avg(sharpe)"), ("min_sharpe", "min(sharpe)"), ("max_sharpe", "max(sharpe)"), ("geo_cagr", "exp(avg(ln(greatest(1 + cagr, 1e-10)))) - 1"), ("avg_cagr", "avg(cagr)"), ("worst_drawdown", "max(max_drawdown)"), ("avg_drawdown", "avg(max_drawdown)"), ("hit_rate", "avg((cagr > 0)::INT)"), ("avg_trades", "avg(num_trades)")))
SQL["lb_across_symbols"] = with_(RESULT, f"SELECT strategy_type, config_id, count(*) AS symbols, {LB} FROM r GROUP BY 1, 2")
SQL["lb_board"] = with_(RESULT + ", a AS (SELECT strategy_type, config_id, avg(sharpe) AS s FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY strategy_type ORDER BY s DESC, config_id) AS i FROM a)", f"SELECT (row_number() OVER (ORDER BY s DESC, config_id))::INT AS rank, config_id, {r4('s')} AS avg_sharpe FROM k WHERE i <= 2 ORDER BY rank LIMIT 8")
SQL["lb_common_dates"] = with_(EVENT, "SELECT ts FROM e GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM e)")
SQL["lb_portfolio"] = with_(
    f"{EVENT}, dd AS (SELECT ts FROM e GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM e)), q AS (SELECT symbol, ts, close + 1000 AS equity FROM e SEMI JOIN dd USING (ts)), {RET.format('q')}, x AS (SELECT ts, avg(ret) AS ret FROM rd WHERE ret IS NOT NULL GROUP BY ts)",
    "SELECT ts, round(ret, 3) + 0.0 AS ret, round(100000 * exp(sum(ln(1 + ret)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)), 3) + 0.0 AS equity FROM x",
)
SQL["out_candles"] = with_(NATION, f"SELECT ts, {', '.join(f'{r4(c)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM b WHERE symbol = 'NATION_2'")

# sweeps: the same state machine for each configuration
SQL["swp_donchian"] = recursive(
    f"""{NATION}, cfg AS (SELECT e.v AS n, x.v AS k FROM (VALUES (10), (20), (40), (55)) e(v), (VALUES (5), (10), (20)) x(v) WHERE x.v < e.v),
s AS (SELECT b.symbol, b.ts, b.rn, b.open, b.close, n, k, b.rn > n AND b.close > (SELECT max(y.high) FROM b y WHERE y.symbol = b.symbol AND y.rn < b.rn AND y.rn >= b.rn - n) AS e, b.rn > n AND b.close < (SELECT min(y.low) FROM b y WHERE y.symbol = b.symbol AND y.rn < b.rn AND y.rn >= b.rn - k) AS x FROM b, cfg),
m AS (SELECT symbol, n, k, rn, 0 AS pos, FALSE AS xf, NULL::DOUBLE AS price, 1000000.0::DOUBLE AS cash, NULL::DOUBLE AS ep FROM s WHERE rn = 1
  UNION ALL SELECT s.symbol, s.n, s.k, s.rn, CASE WHEN m.pos = 0 AND y.e THEN 1 WHEN m.pos = 1 AND y.x THEN 0 ELSE m.pos END, m.pos = 1 AND y.x,
  CASE WHEN m.pos = 0 AND y.e THEN s.open * 1.0005 WHEN m.pos = 1 AND y.x THEN s.open * 0.9995 END,
  m.cash + CASE WHEN m.pos = 0 AND y.e THEN -s.open * 1.0005 * 1.001 WHEN m.pos = 1 AND y.x THEN s.open * 0.9995 * 0.999 ELSE 0 END,
  CASE WHEN m.pos = 0 AND y.e THEN s.open * 1.0005 ELSE m.ep END
  FROM m JOIN s ON s.symbol = m.symbol AND s.n = m.n AND s.k = m.k AND s.rn = m.rn + 1 JOIN s y ON y.symbol = m.symbol AND y.n = m.n AND y.k = m.k AND y.rn = m.rn),
q AS (SELECT s.symbol || '/' || s.n || '/' || s.k AS symbol, s.symbol AS sym, s.n, s.k, s.ts, m.price, m.cash + m.pos * s.close AS equity, CASE WHEN m.xf THEN m.price - m.ep - (m.price + m.ep) * 0.001 END AS net FROM m JOIN s USING (symbol, n, k, rn)),
{RET.format("q")}, a AS (SELECT sym, n, k, arg_max(equity, ts) AS fe, date_diff('second', min(ts), max(ts)) // 86400 / 365.25::DOUBLE AS years, {SHARPE.format("ret")} AS sharpe, avg(ret) AS mr, sqrt(avg(CASE WHEN ret < 0 THEN ret * ret WHEN ret IS NOT NULL THEN 0 END)) AS bad, max(dd) AS max_drawdown, count(net) AS t, count(*) FILTER (net > 0) AS wins, coalesce(sum(net) FILTER (net > 0), 0) AS won, coalesce(-sum(net) FILTER (net < 0), 0) AS lost, coalesce(sum(abs(price)), 0) AS traded FROM rd GROUP BY sym, n, k), c AS (SELECT *, CASE WHEN years <= 0 THEN 0 WHEN fe <= 0 THEN -1 ELSE pow(fe / 1000000, 1 / years) - 1 END AS cagr FROM a)""",
    f"SELECT sym AS symbol, n AS entry_lookback, k AS exit_lookback, {r4('fe')} AS final_equity, {r4('(fe - 1000000) / 1000000')} AS total_return, {r4('cagr')} AS cagr, {r4('sharpe')} AS sharpe, {r4('CASE WHEN bad > 0 THEN mr * 252 / (bad * sqrt(252)) ELSE 0 END')} AS sortino, {r4('max_drawdown')} AS max_drawdown, {r4('CASE WHEN max_drawdown > 0 THEN cagr / max_drawdown ELSE 0 END')} AS calmar, {r4('CASE WHEN t > 0 THEN wins::DOUBLE / t ELSE 0 END')} AS win_rate, {r4('CASE WHEN lost > 0 THEN least(won / lost, 999.99) WHEN won > 0 THEN 999.99 ELSE 0 END')} AS profit_factor, t AS num_trades, {r4('CASE WHEN years > 0 AND (1000000 + fe) / 2 > 0 THEN traded / ((1000000 + fe) / 2) / years ELSE 0 END')} AS turnover FROM c",
)
SQL["bt_long_short"] = recursive(
    f"""{NATION}, {DC}, s AS (SELECT symbol, ts, rn, open, close, coalesce(rn > 20 AND close > u, FALSE) AS e, coalesce(rn > 20 AND close < l2, FALSE) AS x, coalesce(rn > 20 AND close < l, FALSE) AS es, coalesce(rn > 20 AND close > u2, FALSE) AS xs FROM t),
m AS (SELECT symbol, rn, 0 AS pos, NULL::VARCHAR AS side, NULL::DOUBLE AS price, 1000000.0::DOUBLE AS cash FROM s WHERE rn = 1
  UNION ALL SELECT symbol, rn, CASE side WHEN 'entry' THEN 1 WHEN 'entry_short' THEN -1 WHEN 'exit' THEN 0 WHEN 'exit_short' THEN 0 ELSE pos END, side, price, cash + CASE WHEN side IN ('entry', 'exit_short') THEN -price * 1.001 WHEN side IS NOT NULL THEN price * 0.999 ELSE 0 END
  FROM (SELECT *, CASE WHEN side IN ('entry', 'exit_short') THEN open * 1.0005 WHEN side IS NOT NULL THEN open * 0.9995 END AS price FROM
  (SELECT s.symbol, s.rn, s.open, m.pos, m.cash, CASE WHEN m.pos = 0 AND y.e THEN 'entry' WHEN m.pos = 0 AND y.es THEN 'entry_short' WHEN m.pos = 1 AND y.x THEN 'exit' WHEN m.pos = -1 AND y.xs THEN 'exit_short' END AS side
  FROM m JOIN s ON s.symbol = m.symbol AND s.rn = m.rn + 1 JOIN s y ON y.symbol = m.symbol AND y.rn = m.rn)))""",
    f"SELECT s.symbol, s.ts, m.pos AS position_state, m.side AS fill_side, {r4('m.price')} AS fill_price, {r4('m.cash')} AS cash, {r4('m.cash + m.pos * s.close')} AS equity FROM m JOIN s USING (symbol, rn)",
)

# strategies on recurrences
REC: dict[str, tuple] = {}
CHANGES = "ch AS (SELECT symbol, rn, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS dn FROM b WHERE pc IS NOT NULL)"
JOIN = "LEFT JOIN {0} ON {0}.symbol = b.symbol AND {0}.rn = b.rn"
REC["rsi"] = crossing(f"{CHANGES}, {ema(5, '1.0::DOUBLE / 5', 'up', 'ch', 'u')}, {ema(5, '1.0::DOUBLE / 5', 'dn', 'ch', 'n')}, z AS (SELECT b.*, CASE WHEN n.v = 0 THEN 100 ELSE 100 - 100 / (1 + u.v / n.v) END AS v FROM b {JOIN.format('u')} {JOIN.format('n')})", "v", 6, 45, 55)
MACD = f"{ema(12, '2.0::DOUBLE / 13', 'close', 'b', 'f')}, {ema(26, '2.0::DOUBLE / 27', 'close', 'b', 's')}, ln AS (SELECT f.symbol, f.rn, f.v - s.v AS line FROM f JOIN s ON s.symbol = f.symbol AND s.rn = f.rn), {ema(9, '2.0::DOUBLE / 10', 'line', 'ln', 'g')}"
REC["macd"] = crossing(f"{MACD}, z AS (SELECT b.*, ln.line - g.v AS v FROM b {JOIN.format('ln')} {JOIN.format('g')})", "v", 35, 0, 0)
DMI = (
    f"m AS (SELECT symbol, rn, coalesce({TR}, high - low) AS tr, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pd, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS md FROM b), {ema(14, '1.0::DOUBLE / 14', 'tr', 'm', 'a')}, {ema(14, '1.0::DOUBLE / 14', 'pd', 'm', 'u')}, {ema(14, '1.0::DOUBLE / 14', 'md', 'm', 'n')}, "
    f"di AS (SELECT a.symbol, a.rn, CASE WHEN a.v = 0 THEN 0 ELSE 100 * u.v / a.v END AS p, CASE WHEN a.v = 0 THEN 0 ELSE 100 * n.v / a.v END AS q FROM a JOIN u USING (symbol, rn) JOIN n USING (symbol, rn)), dx AS (SELECT *, CASE WHEN p + q = 0 THEN 0 ELSE 100 * abs(p - q) / (p + q) END AS dx FROM di), {ema(14, '1.0::DOUBLE / 14', 'dx', 'dx', 'ax')}"
)
REC["dmi_adx"] = (f"{DMI}, t AS (SELECT b.*, di.p, di.q, ax.v AS adx FROM b {JOIN.format('di')} {JOIN.format('ax')})", "t", "rn > 28 AND p > q AND adx > 12", "rn > 28 AND (p <= q OR adx < 12)", "rn > 28 AND q > p AND adx > 12", "rn > 28 AND (q <= p OR adx < 12)")
ST = f"{T}, st0 AS (SELECT symbol, rn, close, (high + low) / 2 AS mid, avg(coalesce(tr, high - low)) OVER {w(10)} AS atr FROM t), {supertrend(0.2, False, 's1')}, y AS (SELECT b.*, s1.up, lag(s1.up) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS was FROM b {JOIN.format('s1')})"
REC["supertrend"] = (ST, "y", "rn > 10 AND up AND NOT was", "rn > 10 AND NOT up AND was")
REC["supertrend_cooldown"] = REC["supertrend"]
KC = f"{T}, {ema(20, '2.0::DOUBLE / 21', 'close', 'b', 'e1')}, y AS (SELECT b.*, e1.v AS c, 0.1 * avg(t.tr) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS 9 PRECEDING) AS a FROM b JOIN t ON t.symbol = b.symbol AND t.rn = b.rn {JOIN.format('e1')})"
REC["keltner"] = (KC, "y", "rn > 20 AND close > c + a", "rn > 20 AND (close < c - a OR close < c)", "rn > 20 AND close < c - a", "rn > 20 AND (close > c + a OR close > c)")
SK = f"k0 AS (SELECT *, CASE WHEN rn >= 14 THEN CASE WHEN max(high) OVER {w(14)} = min(low) OVER {w(14)} THEN 50.0 ELSE 100 * (close - min(low) OVER {w(14)}) / (max(high) OVER {w(14)} - min(low) OVER {w(14)}) END END AS raw FROM b), k1 AS (SELECT *, CASE WHEN rn >= 16 THEN avg(raw) OVER {w(3)} END AS k FROM k0), k2 AS (SELECT *, CASE WHEN rn >= 18 THEN avg(k) OVER {w(3)} END AS d FROM k1), y AS (SELECT *, k - d AS gap, lag(k - d) OVER ({S}) AS gap0 FROM k2)"
REC["stochastic"] = (SK, "y", "rn > 20 AND gap0 <= 0 AND gap > 0 AND k < 20 AND d < 20", "rn > 20 AND gap0 >= 0 AND gap < 0 AND k > 80 AND d > 80")
IC = f"i AS (SELECT *, CASE WHEN rn >= 52 THEN {HALF(9)} END AS t, CASE WHEN rn >= 52 THEN {HALF(26)} END AS kj, CASE WHEN rn >= 52 THEN {HALF(52)} END AS sb FROM b), y AS (SELECT *, (t + kj) / 2 AS sa, t - kj AS gap, lag(t - kj) OVER ({S}) AS gap0 FROM i)"
REC["ichimoku"] = (IC, "y", "rn > 78 AND close > greatest(sa, sb) AND gap0 <= 0 AND gap > 0", "rn > 78 AND (close < least(sa, sb) OR (gap0 >= 0 AND gap < 0))")
for _name, (_ctes, _rel, *_tests) in REC.items():
    _cols = ", ".join(f"coalesce({t}, FALSE) AS {c}" for t, c in zip(_tests, ("raw_entry", "raw_exit", "raw_entry_short", "raw_exit_short"), strict=False))
    SQL[f"str_{_name}"] = recursive(f"{NATION}, {_ctes}", f"SELECT symbol, ts, {_cols} FROM {_rel}")

# votes of three Donchian strategies
VOTE = "t AS (SELECT *, " + ", ".join(f"coalesce(rn > {n} AND close > max(high) OVER {p(n)}, FALSE)::INT AS e{n}, coalesce(rn > {n} AND close < min(low) OVER {p(n // 2)}, FALSE)::INT AS x{n}" for n in (10, 20, 40)) + " FROM b)"
SQL["str_vote_majority"] = with_(f"{NATION}, {VOTE}", "SELECT symbol, ts, e10 + e20 + e40 > 1 AS raw_entry, x10 + x20 + x40 > 1 AS raw_exit FROM t")

# --- queries over whole tables of results ---
COMBO = RESULT + ", c AS (SELECT *, iteration > 2 AS is_combo, CASE iteration WHEN 3 THEN 'majority' WHEN 4 THEN 'weighted' ELSE 'unanimous' END AS voting_method FROM r)"
SQL["agg_voting_methods"] = with_(COMBO, f"SELECT voting_method, count(*) AS n, {r4('median(sharpe)')} AS median_sharpe, {r4('avg(sharpe)')} AS mean_sharpe, {r4('stddev_samp(sharpe)')} AS std_sharpe, {r4('median(cagr)')} AS median_cagr, {r4('avg(max_drawdown)')} AS avg_max_dd, {r4('avg(num_trades)')} AS avg_trades FROM c WHERE is_combo GROUP BY 1")
SQL["agg_combo_robustness"] = with_(COMBO + ", cg AS (SELECT is_combo, avg(sharpe) AS m, stddev_samp(sharpe) AS d, avg((sharpe > 0)::INT) AS w FROM c GROUP BY is_combo, strategy_type, config_id HAVING count(*) >= 5)", f"SELECT n.name AS category, count(m) AS num_configs, {r4('coalesce(avg(w), 0)')} AS avg_symbol_win_ratio, {r4('coalesce(avg(m), 0)')} AS avg_sharpe, {r4('coalesce(avg(d), 0)')} AS avg_sharpe_std, {r4('coalesce(avg(m / (1 + coalesce(d, 0))), 0)')} AS avg_robustness_score FROM (VALUES ('Combo', TRUE), ('Single', FALSE)) n(name, flag) LEFT JOIN cg ON cg.is_combo = n.flag GROUP BY 1")
BIN = "CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) * {0} / (hi - lo)), {0} - 1) END"
SQL["agg_parameter_spread"] = with_(
    RESULT + ", v AS (SELECT strategy_type, iteration, unnest([{'p': 'num_trades', 'x': num_trades::DOUBLE}, {'p': 'sortino', 'x': sortino}], recursive := true) FROM r), l AS (SELECT CASE WHEN max(iteration) > 3 THEN max(iteration) - 3 ELSE max(iteration) // 2 END AS late FROM r), e AS (SELECT strategy_type, p, min(x) AS lo, max(x) AS hi, count(*) AS n FROM v GROUP BY 1, 2), "
    f"h AS (SELECT strategy_type, p, {BIN.format(20)} AS bin, count(*) AS k, any_value(n) AS n FROM v JOIN e USING (strategy_type, p) GROUP BY 1, 2, 3), t AS (SELECT strategy_type, p, -sum(k / n * log2(k / n)) AS entropy FROM h GROUP BY 1, 2)",
    f"SELECT strategy_type, p AS parameter, {r4('min(x)')} AS all_min, {r4('max(x)')} AS all_max, {r4('avg(x)')} AS all_mean, {r4('stddev_samp(x)')} AS all_std, count(x) AS all_count, {r4('avg(x) FILTER (iteration <= 2)')} AS early_mean, {r4('stddev_samp(x) FILTER (iteration <= 2)')} AS early_std, {r4('avg(x) FILTER (iteration >= late)')} AS late_mean, {r4('stddev_samp(x) FILTER (iteration >= late)')} AS late_std, {r4('any_value(entropy)')} AS entropy FROM v JOIN t USING (strategy_type, p), l GROUP BY 1, 2",
)
SQL["agg_convergence"] = with_(
    RESULT + ", i AS (SELECT iteration, row_number() OVER (ORDER BY iteration) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT iteration FROM r)), s AS (SELECT iteration, k // greatest(1, n // 10) AS w FROM i WHERE n >= 5), v AS (SELECT w, sharpe AS x, iteration FROM r JOIN s USING (iteration)), e AS (SELECT w, min(x) AS lo, max(x) AS hi, count(*) AS n, min(iteration) AS a, max(iteration) AS b FROM v GROUP BY 1 HAVING count(*) >= 5), "
    f"h AS (SELECT w, {BIN.format(10)} AS bin, count(*) AS k, any_value(n) AS n, any_value(a) AS a, any_value(b) AS b FROM v JOIN e USING (w) GROUP BY 1, 2), t AS (SELECT w, any_value(a) AS a, any_value(b) AS b, any_value(n) AS n, -sum(k / n * log2(k / n)) AS y FROM h GROUP BY 1), z AS (SELECT arg_min(y, w) AS y0, arg_max(y, w) AS y1, count(*) AS c FROM t)",
    f"SELECT a AS iteration_start, b AS iteration_end, {r4('y')} AS entropy, n AS sample_size, {r4('y0')} AS initial_entropy, {r4('y1')} AS final_entropy, {r4('CASE WHEN c >= 2 AND y0 > 0 THEN (y0 - y1) / y0 ELSE 0 END')} AS convergence_rate FROM t, z",
)
SQL["agg_discovery"] = with_(RESULT, "SELECT max(iteration) AS last_discovery, (SELECT max(iteration) FROM r) AS iterations, (SELECT max(iteration) FROM r) - max(iteration) AS stagnation FROM (SELECT iteration FROM r ORDER BY sharpe DESC, config_id LIMIT 10)")
SQL["agg_coverage"] = with_(RESULT + ", e AS (SELECT min(sharpe) AS a, max(sharpe) AS b, min(cagr) AS c, max(cagr) AS d FROM r)", f"SELECT count(DISTINCT (least(floor((sharpe - a) * 10 / (b - a)), 9), least(floor((cagr - c) * 10 / (d - c)), 9))) AS visited, {r4('count(DISTINCT (least(floor((sharpe - a) * 10 / (b - a)), 9), least(floor((cagr - c) * 10 / (d - c)), 9))) / 100.0')} AS coverage FROM r, e")
SQL["swp_neighbours"] = with_(
    RESULT + ", g2 AS (SELECT symbol, strategy_type, config_id, entry_lookback // 5 AS n, exit_lookback AS k, sharpe FROM r), h AS (SELECT a.symbol, a.strategy_type, a.config_id, any_value(a.sharpe) AS x, count(b.sharpe) AS n, avg(b.sharpe) AS mean, coalesce(var_pop(b.sharpe), 0) AS v FROM g2 a LEFT JOIN g2 b ON b.symbol = a.symbol AND b.strategy_type = a.strategy_type AND greatest(abs(b.n - a.n), abs(b.k - a.k)) BETWEEN 1 AND 2 GROUP BY 1, 2, 3)",
    f"SELECT symbol, strategy_type, config_id, n, round(mean, 8) + 0.0 AS mean, round(v, 12) + 0.0 AS variance, round(CASE WHEN v > 0 THEN 1 / (1 + abs(x - mean) / greatest(sqrt(v), 0.001)) ELSE 1 END, 8) + 0.0 AS stability FROM h",
)
# Weights of four risk profiles on seven components.
PROFILE = {
    "balanced": (0.225, 0.10, 0.15, 0.10, 0.10, 0.20, 0.125),
    "conservative": (0.175, 0.15, 0.10, 0.15, 0.15, 0.15, 0.125),
    "aggressive": (0.325, 0.05, 0.20, 0.10, 0.05, 0.15, 0.125),
    "trend_options": (0.25, 0.05, 0.25, 0.10, 0.05, 0.20, 0.10),
}
ACROSS = RESULT + ", a AS (SELECT strategy_type, config_id, avg(sharpe) AS avg_sharpe, min(sharpe) AS min_sharpe, exp(avg(ln(greatest(1 + cagr, 1e-10)))) - 1 AS geo, avg((cagr > 0)::INT) AS hit, max(max_drawdown) AS down FROM r GROUP BY 1, 2)"


def robust(sharpe: float, least: float, hit: float, down: float, tail: float, kurtosis: float, regime: float) -> str:
    return f"({sharpe} * least(greatest(avg_sharpe / 2, 0), 1.5) + {least} * least(greatest(min_sharpe / 2, -0.5), 1) + {hit} * hit + {down} * (1 - least(greatest(down, 0), 1)) + 0.5 * ({tail} + {kurtosis} + {regime}))"


SQL["lb_robust_score"] = with_(ACROSS, f"SELECT config_id, round({robust(0.25, 0.10, 0.20, 0.15, 0.10, 0.10, 0.10)}, 12) + 0.0 AS score, round({robust(*PROFILE['trend_options'])}, 12) + 0.0 AS trend_score FROM a")
_boards = " UNION ALL ".join(f"SELECT '{p}' AS profile, (row_number() OVER (ORDER BY v DESC, config_id))::INT AS rank, config_id, {r4('v')} AS rank_value FROM (SELECT *, row_number() OVER (PARTITION BY strategy_type ORDER BY v DESC, config_id) AS i FROM (SELECT strategy_type, config_id, {robust(*ws)} AS v FROM a)) WHERE i <= 3" for p, ws in PROFILE.items())
SQL["lb_ranked_by_profile"] = with_(ACROSS, f"SELECT * FROM ({_boards}) WHERE rank <= 10")
_boards = " UNION ALL ".join(f"SELECT '{m}' AS metric, (row_number() OVER (ORDER BY {c} DESC, config_id))::INT AS rank, config_id, {r4(c)} AS rank_value FROM a" for m, c in (("avg_sharpe", "avg_sharpe"), ("min_sharpe", "min_sharpe"), ("geo_mean_cagr", "geo"), ("hit_rate", "hit"), ("mean_oos_sharpe", "avg_sharpe")))
SQL["lb_ranked_by_metric"] = with_(ACROSS, f"SELECT * FROM ({_boards}) WHERE rank <= 5")

# --- portfolios ---
ALIGNED = f"{EVENT}, dd AS (SELECT ts FROM e GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM e)), q AS (SELECT symbol, ts, close + 1000 AS equity FROM e SEMI JOIN dd USING (ts)), {RET.format('q')}, wt AS (SELECT symbol, 1 / greatest(stddev_samp(ret), 1e-10) AS v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM rd WHERE ret IS NOT NULL) WHERE k <= 60 GROUP BY 1), wn AS (SELECT symbol, v / sum(v) OVER () AS weight FROM wt)"
SQL["lb_portfolio_inverse"] = with_(f"{ALIGNED}, x AS (SELECT ts, exp(sum(weight * ln(greatest(1 + ret, 1e-10)))) - 1 AS ret FROM rd JOIN wn USING (symbol) WHERE ret IS NOT NULL GROUP BY ts)", "SELECT ts, round(ret, 3) + 0.0 AS ret, round(100000 * exp(sum(ln(1 + ret)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)), 3) + 0.0 AS equity FROM x")
SQL["lb_portfolio_summary"] = with_(
    f"{ALIGNED}, x AS (SELECT ts, sum(weight * ret) AS ret FROM rd JOIN wn USING (symbol) WHERE ret IS NOT NULL GROUP BY ts), c AS (SELECT *, 100000 * exp(sum(ln(1 + ret)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS eq FROM x), k AS (SELECT *, greatest(max(eq) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 100000) AS pk FROM c)",
    f"SELECT (SELECT count(*) FROM wn) AS symbols, count(*) + 1 AS overlap_days, {r4('max((pk - eq) / pk)')} AS max_drawdown, {r4('avg(ret) / stddev_samp(ret) * sqrt(252)')} AS sharpe, {r4('pow(arg_max(eq, ts) / 100000, 252.0 / (count(*) + 1)) - 1')} AS cagr, {r4('(SELECT max(weight) FROM wn)')} AS largest_weight FROM k HAVING count(*) >= 20",
)

# --- more strategies ---
MORE: dict[str, tuple] = {}
MORE["turtle_s1"] = SIG["donchian"]
MORE["turtle_s2"] = (f"t AS (SELECT *, max(high) OVER {p(55)} AS u, min(low) OVER {p(55)} AS l, max(high) OVER {p(20)} AS u2, min(low) OVER {p(20)} AS l2 FROM b)", "t", "rn > 55 AND close > u", "rn > 55 AND close < l2", "rn > 55 AND close < l", "rn > 55 AND close > u2")
FLIPS = "t2 AS (SELECT *, up AND NOT was AS turned_up, NOT up AND was AS turned_down FROM y)"
MORE["supertrend_volume"] = (f"{ST}, vy AS (SELECT *, avg(volume) OVER {w(20)} AS vs FROM y)", "vy", "rn > 20 AND up AND NOT was AND volume >= vs", "rn > 20 AND NOT up AND was")
MORE["supertrend_confirmed"] = (f"{ST}, r1 AS (SELECT *, rn - coalesce(max(CASE WHEN NOT coalesce(up, FALSE) THEN rn END) OVER ({S} ROWS UNBOUNDED PRECEDING), 0) AS run FROM y)", "r1", "rn > 13 AND run = 3", "rn > 13 AND NOT up")
MORE["supertrend_asymmetric"] = (
    f"{T}, st0 AS (SELECT symbol, rn, close, (high + low) / 2 AS mid, avg(coalesce(tr, high - low)) OVER {w(10)} AS atr FROM t), {supertrend(0.1, False, 's1')}, {supertrend(0.3, False, 's2')}, y AS (SELECT b.*, s1.up AS u1, lag(s1.up) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS w1, s2.up AS u2, lag(s2.up) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS w2 FROM b {JOIN.format('s1')} {JOIN.format('s2')})",
    "y", "rn > 10 AND u1 AND NOT w1", "rn > 10 AND NOT u2 AND w2",
)
MORE["high_52w_trailing"] = (
    f"x0 AS (SELECT *, CASE WHEN rn >= 52 THEN close / max(close) OVER {w(52)} END AS x FROM b), x1 AS (SELECT *, coalesce(x < 0.9, TRUE) AS far FROM x0), x2 AS (SELECT *, sum(far::INT) OVER ({S} ROWS UNBOUNDED PRECEDING) AS island FROM x1), "
    f"x3 AS (SELECT *, max(CASE WHEN NOT far THEN close END) OVER (PARTITION BY symbol, island ORDER BY ts ROWS UNBOUNDED PRECEDING) AS top0 FROM x2), x4 AS (SELECT *, coalesce(top0, last_value(top0 IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING)) AS top FROM x3)",
    "x4", "rn > 52 AND x >= 0.9", "rn > 52 AND close < 0.7 * top",
)
MORE["heikin_ashi"] = (
    f"h AS (SELECT symbol, rn, (open + close) / 2 AS ho, (open + high + low + close) / 4 AS hc FROM b WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, (h.ho + h.hc) / 2, (b.open + b.high + b.low + b.close) / 4 FROM h JOIN b ON b.symbol = h.symbol AND b.rn = h.rn + 1), "
    f"h1 AS (SELECT b.*, hc > ho AS bull, hc < ho AS bear FROM b JOIN h ON h.symbol = b.symbol AND h.rn = b.rn), h2 AS (SELECT *, rn - coalesce(max(CASE WHEN NOT bear THEN rn END) OVER ({S} ROWS UNBOUNDED PRECEDING), 0) AS bears, rn - coalesce(max(CASE WHEN NOT bull THEN rn END) OVER ({S} ROWS UNBOUNDED PRECEDING), 0) AS bulls FROM h1), h3 AS (SELECT *, lag(bears) OVER ({S}) AS bears0, lag(bulls) OVER ({S}) AS bulls0 FROM h2)",
    "h3", "rn > 4 AND bull AND bears0 >= 3", "rn > 4 AND bear", "rn > 4 AND bear AND bulls0 >= 3", "rn > 4 AND bull",
)
PS = SQL["rec_parabolic_sar"].removeprefix("WITH RECURSIVE ").rsplit(" SELECT b.symbol, b.ts,", 1)[0].removeprefix(NATION + ", ")
PSY = f"{PS}, y AS (SELECT b.*, ps.up, lag(ps.up) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS was FROM b {JOIN.format('ps')})"
MORE["psar"] = (PSY, "y", "rn > 5 AND (coalesce(up AND NOT was, FALSE) OR (rn = 6 AND up))", "rn > 5 AND NOT up AND was", "rn > 5 AND NOT up AND was", "rn > 5 AND up AND NOT was")
MORE["psar_filtered"] = (f"{PSY}, y2 AS (SELECT *, avg(close) OVER {w(50)} AS sm FROM y)", "y2", "rn > 50 AND up AND NOT was AND close > sm", "rn > 50 AND NOT up AND was")
MORE["psar_delayed"] = (f"{PSY}, y2 AS (SELECT *, lag(coalesce(up AND NOT was, FALSE), 2) OVER ({S}) AS flip, rn - coalesce(max(CASE WHEN NOT coalesce(up, FALSE) THEN rn END) OVER ({S} ROWS UNBOUNDED PRECEDING), 0) AS run FROM y)", "y2", "rn > 7 AND flip AND run >= 3", "rn > 7 AND NOT up AND was")
RSI5 = f"{CHANGES}, {ema(5, '1.0::DOUBLE / 5', 'up', 'ch', 'u')}, {ema(5, '1.0::DOUBLE / 5', 'dn', 'ch', 'n')}, z AS (SELECT b.*, CASE WHEN n.v = 0 THEN 100 ELSE 100 - 100 / (1 + u.v / n.v) END AS rsi FROM b {JOIN.format('u')} {JOIN.format('n')})"
MORE["rsi_bollinger"] = (f"{RSI5}, y AS (SELECT *, {MID} AS mid, {DEV} AS dev FROM z)", "y", "rn > 20 AND rsi < 45 AND close <= mid - 0.5 * dev", "rn > 20 AND (close > mid OR rsi > 60)")
MORE["macd_adx"] = (f"{MACD}, {DMI}, y AS (SELECT b.*, ln.line - g.v AS hist, lag(ln.line - g.v) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS hist0, ax.v AS adx FROM b {JOIN.format('ln')} {JOIN.format('g')} {JOIN.format('ax')})", "y", "rn > 35 AND hist0 <= 0 AND hist > 0 AND adx > 8", "rn > 35 AND hist0 >= 0 AND hist < 0")
SKZ = SK.replace("y AS (SELECT *,", "k3 AS (SELECT symbol, rn,")
MORE["confluence"] = (f"{RSI5}, {SKZ}, y AS (SELECT z.*, k3.gap, k3.gap0, lag(rsi) OVER (PARTITION BY z.symbol ORDER BY z.ts) AS rsi0 FROM z JOIN k3 ON k3.symbol = z.symbol AND k3.rn = z.rn)", "y", "rn > 20 AND rsi0 <= 45 AND rsi > 45 AND gap > 0", "rn > 20 AND (coalesce(rsi0 >= 55 AND rsi < 55, FALSE) OR coalesce(gap0 >= 0 AND gap < 0, FALSE))")
for _name, (_ctes, _rel, *_tests) in MORE.items():
    _cols = ", ".join(f"coalesce({t}, FALSE) AS {c}" for t, c in zip(_tests, ("raw_entry", "raw_exit", "raw_entry_short", "raw_exit_short"), strict=False))
    SQL[f"str_{_name}"] = recursive(f"{NATION}, {_ctes}", f"SELECT symbol, ts, {_cols} FROM {_rel}")
VOTE3 = "t AS (SELECT *, " + ", ".join(f"coalesce(rn > {n} AND close > max(high) OVER {p(n)}, FALSE)::INT AS e{n}, coalesce(rn > {n} AND close < min(low) OVER {p(n // 2)}, FALSE)::INT AS x{n}" for n in (20, 50, 100)) + " FROM b)"
SQL["str_ensemble"] = with_(f"{NATION}, {VOTE3}", "SELECT symbol, ts, e20 + e50 + e100 > 1 AS raw_entry, x20 + x50 + x100 > 1 AS raw_exit FROM t")
VOTEW = "t AS (SELECT *, " + ", ".join(f"coalesce(rn > {n} AND close > lag(close, {n}) OVER ({S}), FALSE)::INT * {n} AS e{n}, coalesce(rn > {n} AND close < lag(close, {n}) OVER ({S}), FALSE)::INT * {n} AS x{n}" for n in (5, 10, 20)) + " FROM b)"
SQL["str_vote_weighted"] = with_(f"{NATION}, {VOTEW}", "SELECT symbol, ts, e5 + e10 + e20 > 17 AS raw_entry, x5 + x10 + x20 > 17 AS raw_exit FROM t")
VOTEU = f"{DC.replace('t AS', 't0 AS')}, t1 AS (SELECT *, 100 * (close - lag(close, 12) OVER ({S})) / lag(close, 12) OVER ({S}) AS v FROM t0), t AS (SELECT *, lag(v) OVER ({S}) AS v0 FROM t1)"
SQL["str_vote_unanimous"] = with_(f"{NATION}, {VOTEU}", "SELECT symbol, ts, e AND NOT x AS raw_entry, x AS raw_exit FROM (SELECT symbol, ts, coalesce(rn > 20 AND close > u, FALSE) AND coalesce(rn > 13 AND v0 <= 0 AND v > 0, FALSE) AS e, coalesce(rn > 20 AND close < l2, FALSE) OR coalesce(rn > 13 AND v0 >= 0 AND v < 0, FALSE) AS x FROM t)")

# --- sized positions and pyramids, one bar a step ---
SQL["bt_turtle_size"] = recursive(f"{NATION}, {T}, {ema(20, '1.0::DOUBLE / 20', 'coalesce(tr, high - low)', 't', 'aw')}", f"SELECT b.symbol, b.ts, round(aw.v, 2) + 0.0 AS atr_w, round(CASE WHEN aw.v > 0 AND close > 0 THEN least(greatest(1e13 / (aw.v * close), 1), 1e9) END, 2) + 0.0 AS size FROM b {JOIN.format('aw')}")
SQL["bt_sized"] = recursive(
    f"""{NATION}, {DC}, tt AS (SELECT *, {TR} AS tr FROM t), s AS (SELECT symbol, ts, rn, open, close, coalesce(rn > 20 AND close > u, FALSE) AS e, coalesce(rn > 20 AND close < l2, FALSE) AS x, CASE WHEN rn >= 14 AND avg(coalesce(tr, high - low)) OVER {w(14)} > 0 THEN least(greatest(1e11 / (avg(coalesce(tr, high - low)) OVER {w(14)} * close), 1), 100) END AS size FROM tt),
m AS (SELECT symbol, rn, 0.0::DOUBLE AS qty, 1000000.0::DOUBLE AS cash FROM s WHERE rn = 1
  UNION ALL SELECT s.symbol, s.rn, CASE WHEN m.qty = 0 AND y.e AND y.size IS NOT NULL THEN y.size WHEN m.qty > 0 AND y.x THEN 0 ELSE m.qty END,
  m.cash + CASE WHEN m.qty = 0 AND y.e AND y.size IS NOT NULL THEN -s.open * 1.0005 * y.size * 1.001 WHEN m.qty > 0 AND y.x THEN s.open * 0.9995 * m.qty * 0.999 ELSE 0 END
  FROM m JOIN s ON s.symbol = m.symbol AND s.rn = m.rn + 1 JOIN s y ON y.symbol = m.symbol AND y.rn = m.rn)""",
    f"SELECT s.symbol, s.ts, {r4('m.qty')} AS position_qty, {r4('m.cash')} AS cash, {r4('m.cash + m.qty * s.close')} AS equity FROM m JOIN s USING (symbol, rn)",
)
SQL["bt_pyramid"] = recursive(
    f"""{NATION}, {DC}, tt AS (SELECT *, {TR} AS tr FROM t), {ema(14, '1.0::DOUBLE / 14', 'coalesce(tr, high - low)', 'tt', 'aw')}, s AS (SELECT t.symbol, t.ts, t.rn, t.open, t.close, coalesce(t.rn > 20 AND t.close > u, FALSE) AS e, coalesce(t.rn > 20 AND t.close < l2, FALSE) AS x, aw.v AS atr FROM t LEFT JOIN aw ON aw.symbol = t.symbol AND aw.rn = t.rn),
m AS (SELECT symbol, rn, 0 AS n, NULL::VARCHAR AS act, NULL::DOUBLE AS lastp, 0.0::DOUBLE AS total, 0.0::DOUBLE AS paid, NULL::DOUBLE AS atr, 1000000.0::DOUBLE AS cash, NULL::INT AS out_n, NULL::DOUBLE AS average, NULL::DOUBLE AS net FROM s WHERE rn = 1
  UNION ALL SELECT symbol, rn, CASE act WHEN 'entry' THEN 1 WHEN 'add' THEN n + 1 WHEN 'exit' THEN 0 ELSE n END, act, CASE WHEN act IN ('entry', 'add') THEN buy ELSE lastp END, CASE act WHEN 'entry' THEN buy WHEN 'add' THEN total + buy WHEN 'exit' THEN 0 ELSE total END,
  CASE act WHEN 'entry' THEN buy * 0.001 WHEN 'add' THEN paid + buy * 0.001 WHEN 'exit' THEN 0 ELSE paid END, CASE WHEN act = 'entry' THEN coalesce(atr0, 4.0) ELSE atr END, cash + CASE WHEN act IN ('entry', 'add') THEN -buy * 1.001 WHEN act = 'exit' THEN sell * n * 0.999 ELSE 0 END,
  CASE WHEN act = 'exit' THEN n END, CASE WHEN act = 'exit' THEN total / n END, CASE WHEN act = 'exit' THEN (sell - total / n) * n - sell * n * 0.001 - paid END
  FROM (SELECT s.symbol, s.rn, s.open * 1.0005 AS buy, s.open * 0.9995 AS sell, m.n, m.lastp, m.total, m.paid, m.atr, m.cash, y.atr AS atr0, CASE WHEN m.n = 0 THEN CASE WHEN y.e THEN 'entry' END WHEN y.x THEN 'exit' WHEN m.n < 3 AND y.close >= m.lastp + 0.1 * m.atr THEN 'add' END AS act
  FROM m JOIN s ON s.symbol = m.symbol AND s.rn = m.rn + 1 JOIN s y ON y.symbol = m.symbol AND y.rn = m.rn))""",
    f"SELECT s.symbol, s.ts, m.n AS units, m.out_n AS exit_units, {r4('m.average')} AS avg_entry_price, {r4('m.net')} AS net_pnl, {r4('m.cash + m.n * s.close')} AS equity FROM m JOIN s USING (symbol, rn)",
)
SQL["swp_costs"] = recursive(f"{NATION}, {SIM}, z AS (SELECT symbol, sum(CASE WHEN ef THEN -o WHEN xf THEN o ELSE 0 END) + arg_max(pos * c, rn) AS gain, coalesce(sum(o) FILTER (ef OR xf), 0) AS traded FROM (SELECT q.*, s.open AS o, s.close AS c FROM q JOIN s USING (symbol, rn)) GROUP BY 1), l AS (SELECT symbol, bps, (gain - traded * bps / 10000) / 1000000 AS ret FROM z, (VALUES (0.0), (25.0), (100.0)) v(bps))", f"SELECT symbol, bps::DOUBLE AS fee_bps, {r4('ret')} AS total_return, (min(CASE WHEN ret <= 0 THEN bps END) OVER (PARTITION BY symbol))::DOUBLE AS breakeven_bps FROM l")

# --- validation ---
THIRDS = f"{NATION}, {HELD}, {RET.format('q')}, k AS (SELECT symbol, ret, row_number() OVER ({S}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rd WHERE ret IS NOT NULL), k2 AS (SELECT *, n // 3 AS size, least(i // (n // 3), 2) AS fold FROM k WHERE n >= 126), k3 AS (SELECT *, CASE WHEN fold = 2 THEN n - size * 2 ELSE size END AS len, i - fold * size AS place FROM k2), k4 AS (SELECT *, floor(len * 0.85) AS e FROM k3), th AS (SELECT symbol, fold, " + ", ".join(f"coalesce(CASE WHEN stddev_samp(CASE WHEN place {o} e THEN ret END) >= 1e-10 THEN avg(CASE WHEN place {o} e THEN ret END) / stddev_samp(CASE WHEN place {o} e THEN ret END) * sqrt(252) END, 0) AS {n}" for o, n in (("<", "is_sharpe"), (">=", "oos_sharpe"))) + " FROM k4 WHERE e >= 20 AND len - e >= 5 GROUP BY 1, 2)"
SQL["val_thirds"] = with_(THIRDS, f"SELECT symbol, fold, {r4('is_sharpe')} AS is_sharpe, {r4('oos_sharpe')} AS oos_sharpe FROM th")
SQL["val_cv"] = "SELECT i AS fold, greatest(greatest(600 - (5 - i) * 100 - 5, 0) - 300, 0) AS train_start, greatest(600 - (5 - i) * 100 - 5, 0) AS train_end, 600 - (5 - i) * 100 AS test_start, 700 - (5 - i) * 100 AS test_end FROM range(5) t(i)"
_wf = SQL["val_walk_forward"].removeprefix("WITH ").rsplit(" SELECT symbol, fold::INT", 1)[0]
SQL["val_grades"] = with_(
    f"{_wf}, y AS (SELECT symbol, fold, {SHARPE.format('CASE WHEN pos > 0 AND pos < 100 THEN ret END')} AS a, {SHARPE.format('CASE WHEN pos > 105 THEN ret END')} AS o, arg_max(equity, ts) / (arg_min(equity, ts) FILTER (pos >= 105)) - 1 AS r FROM x GROUP BY 1, 2), z AS (SELECT symbol, count(*) AS folds, avg(o) AS m, stddev_pop(o) AS s, avg(CASE WHEN abs(a) > 1e-10 THEN o / a ELSE 1 END) AS g, avg((r > 0)::INT) AS p FROM y GROUP BY 1)",
    f"SELECT symbol, folds, {r4('m')} AS mean_oos_sharpe, {r4('s')} AS std_oos_sharpe, {r4('g')} AS mean_degradation, {r4('p')} AS pct_profitable, CASE WHEN m > 0.8 AND p >= 0.75 AND g > 0.7 AND s < 0.5 THEN 'A' WHEN m > 0.5 AND p >= 0.75 AND g > 0.7 AND s < 0.5 THEN 'B' WHEN m > 0.3 AND p >= 0.6 AND g > 0.5 THEN 'C' WHEN m > 0 AND p > 0.5 THEN 'D' ELSE 'F' END AS grade FROM z",
)

# --- regimes and trades ---
VOLREG = SQL["ana_volatility_regimes"].removeprefix("WITH " + NATION + ", ").split(" SELECT a.symbol", 1)[0].replace("t AS (", "vt AS (", 1).replace("FROM t)", "FROM vt)", 1).replace(" a AS (", " va AS (").replace("FROM a)", "FROM va)").replace(" k AS (", " vk AS (").replace("FROM k ", "FROM vk ").replace(" m AS (", " vm AS (")
TRENDREG = SQL["ana_trend_regimes"].removeprefix("WITH " + NATION + ", ").split(" SELECT symbol", 1)[0].replace("a AS (", "ta AS (", 1).replace("FROM a)", "FROM ta)").replace(" c AS (", " tc AS (")
BYREG = "rr AS (SELECT rd.symbol, rd.ts, rd.ret, rd.xf, rd.et, rd.net, coalesce(g.regime, 'neutral') AS regime FROM rd LEFT JOIN reg g ON g.symbol = rd.symbol AND g.ts = rd.ts), dy AS (SELECT symbol, regime, count(*) AS days, product(1 + coalesce(ret, 0)) - 1 AS tr, " + SHARPE.format("ret") + " AS sharpe FROM rr GROUP BY 1, 2), tw AS (SELECT q.symbol, coalesce(g.regime, 'neutral') AS regime, count(*) AS n, avg((q.net > 0)::INT) AS win, avg(q.net) AS avg_net FROM q LEFT JOIN reg g ON g.symbol = q.symbol AND g.ts = q.et WHERE q.xf GROUP BY 1, 2)"
SQL["ana_by_regime"] = recursive(
    f"{NATION}, {SIM}, {RET.format('q')}, {VOLREG}, reg AS (SELECT va.symbol, va.ts, CASE WHEN atr > 1.5 * med THEN 'high' WHEN atr < 0.75 * med THEN 'low' ELSE 'neutral' END AS regime FROM va JOIN vm ON vm.symbol = va.symbol), {BYREG}",
    f"SELECT dy.symbol, dy.regime, days, {r4('tr')} AS total_return, {r4('sharpe')} AS sharpe, {r4('days / sum(days) OVER (PARTITION BY dy.symbol)')} AS share, coalesce(n, 0) AS trades, {r4('coalesce(win, 0)')} AS win_rate, {r4('coalesce(avg_net, 0)')} AS avg_net_pnl FROM dy LEFT JOIN tw ON tw.symbol = dy.symbol AND tw.regime = dy.regime",
)
_TR = ("strong_up", "up", "neutral", "down", "strong_down")
SQL["ana_regime_concentration"] = recursive(
    f"{NATION}, {SIM}, {RET.format('q')}, {TRENDREG}, reg AS (SELECT symbol, ts, CASE WHEN x > 0.02 THEN 'strong_up' WHEN x > 0.005 THEN 'up' WHEN x < -0.02 THEN 'strong_down' WHEN x < -0.005 THEN 'down' ELSE 'neutral' END AS regime FROM tc), {BYREG}, "
    f"al AS (SELECT sy.symbol, v.i, v.regime, coalesce(dy.tr, 0) AS ret FROM (SELECT DISTINCT symbol FROM dy) sy, (VALUES {', '.join(f'({i}, {chr(39)}{r}{chr(39)})' for i, r in enumerate(_TR))}) v(i, regime) LEFT JOIN dy ON dy.symbol = sy.symbol AND dy.regime = v.regime), "
    "ag AS (SELECT symbol, sum(abs(ret)) AS total, sum(greatest(ret, 0)) AS pos, sum(ret * ret) AS sq, arg_max(regime, (abs(ret), i)) AS top, arg_max(ret, (abs(ret), i)) AS topret FROM al GROUP BY 1), h5 AS (SELECT symbol, CASE WHEN total >= 1e-10 THEN sq / (total * total) ELSE 0 END AS hhi, CASE WHEN total >= 1e-10 THEN least(greatest((sq / (total * total) - 0.2) / 0.8, 0), 1) ELSE 0 END AS score, CASE WHEN total >= 1e-10 THEN top ELSE 'strong_up' END AS dominant, CASE WHEN total < 1e-10 THEN 0 WHEN pos > 0 AND topret > 0 THEN topret / pos ELSE abs(topret) / total END AS sh FROM ag)",
    f"SELECT symbol, {r4('hhi')} AS hhi, {r4('score')} AS score, dominant, {r4('sh')} AS dominant_share, {r4('CASE WHEN score <= 0.5 THEN 0 ELSE (score - 0.5) * 2 END')} AS penalty FROM h5",
)
EXC = f"{NATION}, {SIM}, {T.replace('t AS', 'tx AS')}, av AS (SELECT symbol, ts, rn, CASE WHEN rn >= 14 THEN 100 * avg(coalesce(tr, high - low)) OVER {w(14)} / close END AS ev FROM tx), tw AS (SELECT symbol, et, ts AS xt, ep, price, net FROM q WHERE xf), ex AS (SELECT tw.symbol, et, xt, greatest(max((ep - low) / ep), 0) AS mae, greatest(max((high - ep) / ep), 0) AS mfe, count(*) AS held, any_value((price - ep) / ep) AS ret, any_value(net) AS net FROM tw JOIN b ON b.symbol = tw.symbol AND b.ts BETWEEN et AND xt GROUP BY tw.symbol, et, xt)"
SQL["ana_holding"] = recursive(
    f"{EXC}, bk AS (SELECT symbol, CASE WHEN held <= 5 THEN 0 WHEN held <= 10 THEN 1 WHEN held <= 20 THEN 2 WHEN held <= 50 THEN 3 ELSE 4 END AS i, count(*) AS n, avg(ret) AS a, avg((net > 0)::INT) AS win FROM ex GROUP BY 1, 2), al AS (SELECT symbol, v.i, v.label, total FROM (SELECT symbol, count(*) AS total FROM ex GROUP BY 1), (VALUES (0, '1-5 days'), (1, '6-10 days'), (2, '11-20 days'), (3, '21-50 days'), (4, '51+ days')) v(i, label))",
    f"SELECT al.symbol, label AS bucket, coalesce(n, 0) AS trades, {r4('coalesce(n, 0) / total')} AS share, {r4('coalesce(a, 0)')} AS avg_return, {r4('coalesce(win, 0)')} AS win_rate FROM al LEFT JOIN bk ON bk.symbol = al.symbol AND bk.i = al.i WHERE al.i < 4 OR n > 0",
)
_at = lambda c, a, b: f"max({c}) FILTER ({c}_i = count_n * {a} // {b})"
CORR = "coalesce(covar_pop({0}, {1}) / nullif(stddev_pop(CASE WHEN {1} IS NOT NULL THEN {0} END) * stddev_pop(CASE WHEN {0} IS NOT NULL THEN {1} END), 0), 0)"
SQL["ana_trades"] = recursive(
    f"{EXC}, ek AS (SELECT ex.*, av.ev, (net > 0)::INT::DOUBLE AS win, CASE WHEN mae > 0 THEN mfe / mae END AS edge, count(*) OVER (PARTITION BY ex.symbol) AS count_n, " + ", ".join(f"row_number() OVER (PARTITION BY ex.symbol ORDER BY {c}, et) - 1 AS {c}_i" for c in ("held", "mae", "mfe")) + " FROM ex JOIN av ON av.symbol = ex.symbol AND av.ts = ex.et)",
    f"SELECT symbol, count(*) AS trades, {r4('avg(held)')} AS mean_bars, {r4('stddev_pop(held)')} AS std_bars, min(held) AS min_bars, max(held) AS max_bars, {_at('held', 1, 2)} AS median_bars, {_at('held', 1, 4)} AS p25_bars, {_at('held', 3, 4)} AS p75_bars, "
    + ", ".join(f"{r4(f'avg({c})')} AS mean_{c}, {r4(f'stddev_pop({c})')} AS std_{c}, {r4(f'max({c})')} AS max_{c}, {r4(_at(c, 1, 2))} AS median_{c}, {r4(_at(c, 3, 4))} AS p75_{c}, {r4(_at(c, 9, 10))} AS p90_{c}, {r4(f'avg({c}) FILTER (win = 1)')} AS winners_{c}, {r4(f'avg({c}) FILTER (win = 0)')} AS losers_{c}" for c in ("mae", "mfe"))
    + f", {r4('avg(edge)')} AS mean_edge, {r4('avg((edge > 1)::INT)')} AS pct_edge_over_1, {r4(CORR.format('ev', 'ret'))} AS corr_vol_return, {r4(CORR.format('ev', 'win'))} AS corr_vol_win FROM ek GROUP BY symbol",
)

# --- scans ---
HIST = f"h0 AS (SELECT *, coalesce(last_value(CASE WHEN e THEN 1 WHEN x THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol, strategy ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS pos FROM sg), h1 AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY symbol, strategy ORDER BY ts), 0) AS tr FROM h0), h2 AS (SELECT symbol, strategy, max(ts) AS ts, arg_max(close, rn) AS close, arg_max(pos, rn) AS position, max(rn) - max(rn) FILTER (tr <> 0) AS ago FROM h1 GROUP BY 1, 2), h3 AS (SELECT *, CASE WHEN ago < 10 THEN CASE WHEN position = 1 THEN 'entry' ELSE 'exit' END ELSE 'hold' END AS signal FROM h2)"
ONE = "SELECT symbol, ts, rn, close, '{0}' AS strategy, coalesce({1}, FALSE) AS e, coalesce({2}, FALSE) AS x FROM {3}"
SQL["out_latest"] = with_(f"{NATION}, {DC}, sg AS ({ONE.format('d', SIG['donchian'][2], SIG['donchian'][3], 't')}), {HIST}", f"SELECT symbol, ts, {r4('close')} AS close, position, ago AS bars_since, signal FROM h3")
_R = SIG["roc"][0].replace("z AS", "rz AS").replace("t AS (", "rt0 AS (").replace("FROM z)", "FROM rz)")
_H = SIG["high_52w"][0].replace("t AS", "ht AS")
SQL["out_scan"] = with_(
    f"{NATION}, {DC}, {_H}, {_R}, sg AS ({ONE.format('donchian', SIG['donchian'][2], SIG['donchian'][3], 't')} UNION ALL {ONE.format('high_52w', SIG['high_52w'][2], SIG['high_52w'][3], 'ht')} UNION ALL {ONE.format('roc', SIG['roc'][2], SIG['roc'][3], 'rt0')}), {HIST}, h4 AS (SELECT *, count(*) OVER (PARTITION BY symbol, signal) AS confirmations, max((strategy IN ('supertrend', 'high_52w'))::INT) OVER (PARTITION BY symbol, signal) AS slow FROM h3)",
    f"SELECT symbol, strategy, ts, {r4('close')} AS close, position, ago AS bars_since, signal, confirmations FROM h4 WHERE signal = 'hold' OR slow = 1",
)
SQL["exp_coverage"] = with_(RESULT, "SELECT (least(floor(greatest(0, least(1, (num_trades * 7 - 5) / 495.0::DOUBLE)) / 0.02::DOUBLE), 49) + 50 * least(floor(greatest(0, least(1, (entry_lookback - 2) / 198.0::DOUBLE)) / 0.02::DOUBLE), 49))::BIGINT AS cell, count(*) AS visits FROM r GROUP BY 1")
TPS = f"avg(tp) OVER {w(20)}"
SQL["ind_approx"] = with_(
    f"{NATION}, t AS (SELECT *, {TR} AS tr, (high + low + close) / 3 AS tp FROM b)",
    f"SELECT symbol, ts, {f(20, f'CASE WHEN stddev_pop(tp) OVER {w(20)} > 0 THEN (tp - {TPS}) / (0.015 * 0.7979 * stddev_pop(tp) OVER {w(20)}) END')} AS cci_approx, {r4('(high + low) / 2')} AS sar_basic, {f(14, f'(high + low) / 2 + 0.12 * avg(tr) OVER {w(14)}')} AS sar_upper, {f(14, f'(high + low) / 2 - 0.12 * avg(tr) OVER {w(14)}')} AS sar_lower, "
    f"CASE WHEN rn >= 14 THEN (close > (high + low) / 2 - 0.12 * avg(tr) OVER {w(14)})::INT END AS sar_up, CASE WHEN rn >= 10 THEN (close > (high + low) / 2 - 0.3 * avg(tr) OVER {w(10)})::INT END AS st_up, {f(6, f'max(high) OVER {p(6)}', 4, '>')} AS box_top, {f(6, f'min(low) OVER {p(6)}', 4, '>')} AS box_bottom FROM t",
)

# --- Darvas boxes: one bar a step ---


def darvas(n: int) -> str:
    begins = "(complete AND high > top) OR (NOT complete AND bottom IS NULL AND high >= top)"
    waits = "NOT complete AND bottom IS NULL"
    return (
        "dv AS (SELECT symbol, rn, high AS top, low AS floor, NULL::DOUBLE AS bottom, 0 AS cnt, FALSE AS complete, NULL::DOUBLE AS last_low FROM b WHERE rn = 1 UNION ALL "
        f"SELECT symbol, rn, CASE WHEN {begins} THEN high ELSE top END, CASE WHEN {begins} THEN low WHEN {waits} THEN least(floor, low) ELSE floor END, "
        f"CASE WHEN {begins} THEN NULL WHEN {waits} THEN CASE WHEN cnt + 1 >= {n} THEN least(floor, low) END WHEN complete THEN bottom WHEN low > last_low THEN bottom WHEN low < bottom THEN low ELSE bottom END, "
        f"CASE WHEN {begins} THEN 0 WHEN {waits} THEN CASE WHEN cnt + 1 >= {n} THEN 0 ELSE cnt + 1 END WHEN complete THEN cnt WHEN low > last_low THEN cnt + 1 WHEN low < bottom THEN 0 ELSE cnt END, "
        f"CASE WHEN {begins} THEN FALSE WHEN {waits} THEN FALSE WHEN complete THEN TRUE WHEN low > last_low THEN cnt + 1 >= {n} ELSE FALSE END, "
        f"CASE WHEN complete THEN CASE WHEN high > top THEN low ELSE last_low END WHEN {waits} THEN CASE WHEN high < top AND cnt + 1 >= {n} THEN low ELSE last_low END ELSE low END "
        "FROM (SELECT b.symbol, b.rn, b.high, b.low, dv.top, dv.floor, dv.bottom, dv.cnt, dv.complete, dv.last_low FROM dv JOIN b ON b.symbol = dv.symbol AND b.rn = dv.rn + 1))"
    )


SQL["rec_darvas"] = recursive(f"{NATION}, {darvas(2)}", f"SELECT b.symbol, b.ts, CASE WHEN bottom IS NOT NULL THEN {r4('top')} END AS box_top, {r4('bottom')} AS box_bottom, CASE WHEN bottom IS NOT NULL THEN complete::INT END AS box_complete FROM b {JOIN.format('dv')}")
SQL["str_darvas"] = recursive(
    f"{NATION}, {darvas(3)}, y AS (SELECT b.*, CASE WHEN complete THEN top END AS t, CASE WHEN complete THEN bottom END AS o, lag(CASE WHEN complete THEN top END) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS t0, lag(CASE WHEN complete THEN bottom END) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS o0 FROM b {JOIN.format('dv')})",
    "SELECT symbol, ts, rn > 6 AND (coalesce(close > t, FALSE) OR coalesce(close > t0, FALSE)) AS raw_entry, rn > 6 AND (coalesce(close < o, FALSE) OR coalesce(close < o0, FALSE)) AS raw_exit FROM y",
)

# --- sweeps of several strategies: the state machine for each configuration ---
_sig = [("ma_cross", f"ma_cross_fast{n}_slow{k}", f"rn > {k} AND a{n} > a{k} AND NOT p{n} > p{k}", f"rn > {k} AND NOT a{n} > a{k} AND p{n} > p{k}") for n in (5, 10) for k in (20, 50)]
_sig += [("tsmom", f"tsmom_lookback{n}", f"rn > {n} AND close > c{n}", f"rn > {n} AND close < c{n}") for n in (20, 50)]
_sig += [("high_52w", f"high_52w_entry_pct0.9_exit_pct0.5_n{n}", f"rn > {n} AND close / m{n} >= 0.9", f"rn > {n} AND close / m{n} < 0.5") for n in (26, 52)]
_sig += [("opening_range", "opening_range_n2_periodmonth", "rn > 2 AND i >= 2 AND close > oh", "rn > 2 AND i >= 2 AND close < ol")]
_base = "z0 AS (SELECT *, " + ", ".join([f"avg(close) OVER {w(n)} AS a{n}" for n in (5, 10, 20, 50)] + [f"lag(close, {n}) OVER ({S}) AS c{n}" for n in (20, 50)] + [f"max(close) OVER {w(n)} AS m{n}" for n in (26, 52)] + [f"row_number() OVER ({PM}) AS i"]) + " FROM b), z1 AS (SELECT *, " + ", ".join([f"lag(a{n}) OVER ({S}) AS p{n}" for n in (5, 10, 20, 50)] + [f"max(CASE WHEN i <= 2 THEN high END) OVER ({PM} ROWS UNBOUNDED PRECEDING) AS oh", f"min(CASE WHEN i <= 2 THEN low END) OVER ({PM} ROWS UNBOUNDED PRECEDING) AS ol"]) + " FROM z0)"
_rows = " UNION ALL ".join(f"SELECT symbol, ts, rn, open, close, '{s}' AS strategy, '{c}' AS config, coalesce({e}, FALSE) AS e, coalesce({x}, FALSE) AS x FROM z1" for s, c, e, x in _sig)
SQL["swp_strategies"] = recursive(
    f"""{NATION}, {_base}, s AS ({_rows}),
m AS (SELECT symbol, config, rn, 0 AS pos, FALSE AS xf, NULL::DOUBLE AS price, 1000000.0::DOUBLE AS cash FROM s WHERE rn = 1
  UNION ALL SELECT s.symbol, s.config, s.rn, CASE WHEN m.pos = 0 AND y.e THEN 1 WHEN m.pos = 1 AND y.x THEN 0 ELSE m.pos END, m.pos = 1 AND y.x, CASE WHEN m.pos = 0 AND y.e THEN s.open * 1.0005 WHEN m.pos = 1 AND y.x THEN s.open * 0.9995 END,
  m.cash + CASE WHEN m.pos = 0 AND y.e THEN -s.open * 1.0005 * 1.001 WHEN m.pos = 1 AND y.x THEN s.open * 0.9995 * 0.999 ELSE 0 END
  FROM m JOIN s ON s.symbol = m.symbol AND s.config = m.config AND s.rn = m.rn + 1 JOIN s y ON y.symbol = m.symbol AND y.config = m.config AND y.rn = m.rn),
q AS (SELECT s.symbol || '/' || s.config AS symbol, s.symbol AS sym, s.strategy, s.config, s.ts, m.xf, m.cash + m.pos * s.close AS equity FROM m JOIN s USING (symbol, config, rn)), {RET.format("q")}""",
    f"SELECT sym AS symbol, strategy AS strategy_type, config AS config_id, {r4('(arg_max(equity, ts) - 1000000) / 1000000')} AS total_return, {r4(SHARPE.format('ret'))} AS sharpe, {r4('max(dd)')} AS max_drawdown, count(*) FILTER (xf) AS num_trades FROM rd GROUP BY 1, 2, 3",
)

# --- p-values ---
_ERF = "(0.5 * (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-z * z / 2))"
SQL["val_pooled"] = with_(
    f"{THIRDS}, g1 AS (SELECT count(*) AS folds, avg(oos_sharpe) AS m, stddev_samp(oos_sharpe) AS s, avg((oos_sharpe > 0)::INT) AS pp, avg(is_sharpe) AS i FROM th HAVING count(*) >= 3), g3 AS (SELECT *, CASE WHEN abs(i) > 1e-6 THEN m / i ELSE 0 END AS d, abs(m / (s / sqrt(folds))) AS z FROM g1), g4 AS (SELECT *, 1 / (1 + 0.3275911 * z / sqrt(2)) AS t FROM g3)",
    f"SELECT 'all' AS \"all\", folds, {r4('m')} AS mean_oos_sharpe, {r4('s')} AS std_oos_sharpe, {r4('pp')} AS pct_profitable, {r4('d')} AS degradation, CASE WHEN m > 0.5 AND d > 0.7 AND pp > 0.8 THEN 'A' WHEN m > 0.3 AND d > 0.5 AND pp > 0.7 THEN 'B' WHEN m > 0.1 AND d > 0.3 AND pp > 0.6 THEN 'C' WHEN m > 0 AND d > 0.2 AND pp > 0.5 THEN 'D' ELSE 'F' END AS grade, {r4(f'greatest(1e-10, least(1 - 1e-10, CASE WHEN m >= 0 THEN {_ERF} ELSE 1 - {_ERF} END))')} AS p FROM g4",
)
# Student's distribution by its finite series in the cosine of atan(t / sqrt(df))
_even = "sin(th) * (SELECT sum(exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(th), 2 * k)) FROM range(df // 2) r(k))"
_odd = "2 / pi() * (th + sin(th) * coalesce((SELECT sum(sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(cos(th), 2 * k + 1)) FROM range((df - 1) // 2) r(k)), 0))"
SQL["stat_p_values"] = with_(
    RESULT + f", a1 AS (SELECT config_id, count(sharpe) AS n, avg(sharpe + 0.05) AS mean, CASE WHEN count(sharpe) >= 3 THEN avg(sharpe + 0.05) / (stddev_samp(sharpe) / sqrt(count(sharpe))) END AS t FROM r GROUP BY 1), a2 AS (SELECT *, n - 1 AS df, atan(t / sqrt(n - 1)) AS th FROM a1), a3 AS (SELECT *, CASE WHEN t IS NOT NULL THEN greatest(1e-10, least(1 - 1e-10, 0.5 - 0.5 * CASE WHEN df % 2 = 0 THEN {_even} ELSE {_odd} END)) END AS p FROM a2), a4 AS (SELECT *, count(p) OVER () AS m, row_number() OVER (ORDER BY p NULLS LAST, config_id) AS i FROM a3)",
    f"SELECT config_id, n, {r4('mean')} AS mean, {r4('t')} AS t, {r4('p')} AS p, {r4('least(1, p * m)')} AS bonferroni, {r4('least(1, CASE WHEN p IS NOT NULL THEN max(p * (m - i + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) END)')} AS holm, {r4('least(1, CASE WHEN p IS NOT NULL THEN min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END)')} AS bh FROM a4",
)

# one series over many tasks: the same definitions over all events
ONE = """b0 AS (SELECT 'ALL' AS symbol, time_bucket(INTERVAL 10 MINUTE, ts)::TIMESTAMP AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 2),
b AS (SELECT *, row_number() OVER s AS rn, lag(close) OVER s AS pc, lag(high) OVER s AS ph, lag(low) OVER s AS pl FROM b0 WINDOW s AS (PARTITION BY symbol ORDER BY ts))"""
SQL["one_means"] = recursive(f"{ONE}, {ema(20, '2.0::DOUBLE / 21', 'close', 'b', 'e1')}, {ema(14, '1.0::DOUBLE / 14', 'close', 'b', 'e2')}", f"SELECT b.symbol, b.ts, {r4('e1.v')} AS ema, {r4('e2.v')} AS wilder FROM b LEFT JOIN e1 USING (symbol, rn) LEFT JOIN e2 USING (symbol, rn)")
SQL["one_rsi"] = recursive(f"{ONE}, {RSI_MEANS}", f"SELECT b.symbol, b.ts, {RSI_VALUE} AS rsi FROM b LEFT JOIN u USING (symbol, rn) LEFT JOIN n USING (symbol, rn)")
SQL["one_macd"] = recursive(f"{ONE}, {LINES}", f"SELECT b.symbol, b.ts, CASE WHEN g.v IS NOT NULL THEN {r4('ln.line')} END AS macd, {r4('g.v')} AS macd_signal, {r4('ln.line - g.v')} AS macd_hist FROM b LEFT JOIN ln USING (symbol, rn) LEFT JOIN g USING (symbol, rn)")
SQL["one_dmi"] = SQL["rec_dmi"].replace(NATION, ONE)
ONE_SIM = f"{ONE}, t AS (SELECT *, NULL::DOUBLE AS u, NULL::DOUBLE AS l2 FROM b), {SIM.removeprefix(DC + ', ')}".replace("coalesce(rn > 20 AND close > u, FALSE)", "coalesce(close / pc - 1 > 0.05, FALSE)").replace("coalesce(rn > 20 AND close < l2, FALSE)", "coalesce(close / pc - 1 < -0.03, FALSE)")
_one = {"fill_price": ("price", 8), "fill_fees": ("fees", 10), "cash": ("cash", 4), "equity": ("equity", 4), "drawdown": ("dd", 8)}
SQL["one_long_only"] = recursive(f"{ONE_SIM}, {RET.format('q')}", "SELECT symbol, ts, pos AS position_state, ef AS entry_fill, xf AS exit_fill, " + ", ".join(f"round({x}, {k}) + 0.0 AS {n}" for n, (x, k) in _one.items()) + " FROM rd")
SQL["one_metrics"] = SQL["met_metrics"].replace(f"{NATION}, {SIM}", ONE_SIM)

SQL["exp_untested"] = """WITH r AS (SELECT o_orderkey, o_orderstatus, o_custkey AS config_hash, o_orderdate::DATE AS tested_start, o_orderdate::DATE + floor(o_totalprice / 1000)::INT AS tested_end FROM orders)
SELECT o_orderkey, config_hash, tested_start, tested_end FROM r WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM r h WHERE h.o_orderstatus = 'F' AND h.config_hash = r.config_hash
  AND abs(h.tested_start - r.tested_start) + abs(h.tested_end - r.tested_end) <= 180)"""
SQL["lb_covered"] = """WITH s AS (SELECT o_custkey AS symbol, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1), w AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders)
SELECT symbol, first, last FROM s, w WHERE greatest(last - first, 1) / greatest(z - a, 1)::DOUBLE >= 0.6 AND first - a <= 365"""


# means with adjusted weights
def adjusted_mean(n: int, k: str, x: str, rel: str, name: str) -> str:
    """CTE of (symbol, rn, v): the weighted mean of all values of x so far, once there are n; x begins at the first bar where it isn't null."""
    return (
        f"{name}_x AS (SELECT symbol, rn, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS j FROM {rel} WHERE {x} IS NOT NULL), "
        f"{name}_r AS (SELECT symbol, rn, j, x AS a, 1.0::DOUBLE AS z FROM {name}_x WHERE j = 1 UNION ALL SELECT x.symbol, x.rn, x.j, r.a * (1 - {k}) + x.x, r.z * (1 - {k}) + 1 FROM {name}_r r JOIN {name}_x x ON x.symbol = r.symbol AND x.j = r.j + 1), "
        f"{name} AS (SELECT symbol, rn, a / z AS v FROM {name}_r WHERE j >= {n})"
    )


_K = "1.0::DOUBLE / 14"
SQL["rec_adjusted"] = recursive(
    f"{NATION}, m AS (SELECT symbol, rn, coalesce({TR}, high - low) AS tr, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pd, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS md, (open + high + low + close) / 4 AS hc FROM b), "
    + ", ".join(adjusted_mean(14, _K, x, "m", n) for x, n in (("tr", "a"), ("pd", "u"), ("md", "n")))
    + ", di AS (SELECT a.symbol, a.rn, CASE WHEN a.v = 0 THEN 0 ELSE 100 * u.v / a.v END AS p, CASE WHEN a.v = 0 THEN 0 ELSE 100 * n.v / a.v END AS q FROM a JOIN u USING (symbol, rn) JOIN n USING (symbol, rn)), dx AS (SELECT *, CASE WHEN p + q = 0 THEN 0 ELSE 100 * abs(p - q) / (p + q) END AS dx FROM di), "
    + f"{adjusted_mean(14, _K, 'dx', 'dx', 'ax')}, {adjusted_mean(1, '0.5::DOUBLE', 'hc', 'm', 'hm')}, h AS (SELECT b.*, (b.open + b.high + b.low + b.close) / 4 AS hc, coalesce(hm.v, (b.open + b.close) / 2) AS ho FROM b LEFT JOIN hm ON hm.symbol = b.symbol AND hm.rn = b.rn - 1)",
    "SELECT h.symbol, h.ts, " + ", ".join(f"round({x}, 8) + 0.0 AS {n}" for n, x in (("atr_adjusted", "a.v"), ("adjusted_plus_di", "di.p"), ("adjusted_minus_di", "di.q"), ("adjusted_adx", "ax.v"), ("adjusted_ha_open", "ho"), ("adjusted_ha_high", "greatest(high, ho, hc)"), ("adjusted_ha_low", "least(low, ho, hc)"), ("adjusted_ha_close", "hc")))
    + " FROM h LEFT JOIN a USING (symbol, rn) LEFT JOIN di USING (symbol, rn) LEFT JOIN ax USING (symbol, rn)",
)
