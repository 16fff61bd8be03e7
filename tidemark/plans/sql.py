"""Pieces of DuckDB SQL that give the same rows as the operators."""

from __future__ import annotations

from tidemark.sources.synthetic import DAILY_SQL, INTRADAY_SQL, STATEMENTS_SQL

S = "PARTITION BY symbol ORDER BY t"


def roll(fn: str, x: str, n: int, least: int, over: str = S) -> str:
    w = f"OVER ({over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least} THEN {fn}({x}) {w} END"


def lag(x: str, k: int = 1, over: str = S) -> str:
    return f"lag({x}, {k}) OVER ({over})" if k >= 0 else f"lead({x}, {-k}) OVER ({over})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def z(source: str, out: str, names: list[str], keep: str = "date, symbol, t", by: str = "date", clip: bool = True) -> str:
    """CTEs that end in `out`: source with the columns as z-scores."""
    p = f"OVER (PARTITION BY {by})"
    steps, last = [], source
    if clip:
        steps.append(f"{out}__m AS (SELECT *, {', '.join(f'median({c}) {p} AS md_{c}' for c in names)} FROM {source})")
        steps.append(f"{out}__d AS (SELECT *, {', '.join(f'median(abs({c} - md_{c})) {p} AS mad_{c}' for c in names)} FROM {out}__m)")
        cut = lambda c: f"CASE WHEN mad_{c} > 1e-13 THEN CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, md_{c} - mad_{c} * 4.4478), md_{c} + mad_{c} * 4.4478) END ELSE {c} END AS {c}"
        steps.append(f"{out}__c AS (SELECT {keep}, {', '.join(map(cut, names))} FROM {out}__d)")
        last = f"{out}__c"
    steps.append(f"{out} AS (SELECT {keep}, {', '.join(f'({c} - avg({c}) {p}) / CASE WHEN stddev_samp({c}) {p} > 1e-13 THEN stddev_samp({c}) {p} END AS {c}' for c in names)} FROM {last})")
    return ", ".join(steps)


def mean_std(source: str, out: str, names: list[str], n: int = 5, negate: bool = False, keep: str = "date, symbol, t") -> str:
    least, sign = max(n - 1, 3), "-" if negate else ""
    parts = ", ".join(f"{roll('avg', c, n, least)} AS m_{c}, {roll('stddev_samp', c, n, least)} AS s_{c}" for c in names)
    cols = [f"{k}_{c}" for c in names for k in "ms"]
    return f"{out}_r AS (SELECT {keep}, {parts} FROM {source}), {z(f'{out}_r', f'{out}_z', cols, keep)}, {out} AS (SELECT {keep}, {', '.join(f'{sign}(m_{c} + s_{c}) / 2 AS {c}' for c in names)} FROM {out}_z)"


def mean_z(source: str, out: str, names: list[str], keep: str = "date, symbol, t") -> str:
    return f"{out}_r AS (SELECT {keep}, {', '.join(f'{roll('avg', c, 5, 4)} AS {c}' for c in names)} FROM {source}), {z(f'{out}_r', out, names, keep)}"


def renamed(source: str, out: str, pairs: dict[str, str], keep: str) -> str:
    return f"{out} AS (SELECT {keep}, {', '.join(f'{a} AS {b}' for a, b in pairs.items())} FROM {source})"


def rank_average(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


WEEK = "CAST(date_trunc('week', date + 2) + INTERVAL 4 DAY AS DATE)"  # the Friday; Saturdays and Sundays go on

_ewm = lambda x, n: (
    f"CASE WHEN count({x}) OVER w >= {n} THEN sum({x} * CASE WHEN {x} IS NOT NULL THEN exp(t * {{r}}) END) OVER w / sum(CASE WHEN {x} IS NOT NULL THEN exp(t * {{r}}) END) OVER w END"
)


def ewm(x: str, n: int) -> str:
    import math

    return _ewm(x, n).replace("{r}", repr(-math.log(1 - 2 / (n + 1))))


TECHNICAL = f"""WITH {DAILY_SQL}, d AS (SELECT *, close - {lag('close')} AS diff FROM grid),
g AS (SELECT *, CASE WHEN diff IS NOT NULL THEN greatest(diff, 0) END AS gain, CASE WHEN diff IS NOT NULL THEN greatest(-diff, 0) END AS loss FROM d),
f AS (SELECT date, symbol, {div(lag('close', 21), lag('close', 252))} - 1 AS RS_12M, {div(lag('close', 21), lag('close', 126))} - 1 AS RS_6M,
 {div('close - lo', 'hi - lo')} AS Range_52W, 100 - 100 / (1 + {div('g140', 'l140')}) AS RSI_28W, 100 - 100 / (1 + {div('g80', 'l80')}) AS RSI_16W
 FROM (SELECT *, {roll('min', 'low', 252, 126)} AS lo, {roll('max', 'high', 252, 126)} AS hi, {ewm('gain', 140)} AS g140, {ewm('loss', 140)} AS l140, {ewm('gain', 80)} AS g80, {ewm('loss', 80)} AS l80
       FROM g WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""

_REV = ["interday_rev_volflip", "intraday_rev_volflip", "overnight_rev_volflip"]
_flip = ", ".join(f"CASE WHEN s_{c} < avg(s_{c}) OVER (PARTITION BY date) THEN -m_{c} ELSE m_{c} END AS {c}" for c in _REV)
REVERSAL = f"""WITH {DAILY_SQL}, a AS (SELECT date, symbol, t, {div('close', lag('close'))} - 1 AS interday_rev_volflip, {div('close', 'open')} - 1 AS intraday_rev_volflip, {div('open', lag('close'))} - 1 AS o FROM grid),
b AS (SELECT *, abs(o - avg(o) OVER (PARTITION BY date)) AS overnight_rev_volflip FROM a),
c AS (SELECT date, symbol, t, {', '.join(f"{roll('avg', x, 20, 15)} AS m_{x}, {roll('stddev_samp', x, 20, 15)} AS s_{x}" for x in _REV)} FROM b),
e AS (SELECT date, symbol, t, {_flip} FROM c), e2 AS (SELECT *, {', '.join(f'{x} AS z{i}' for i, x in enumerate(_REV))} FROM e), {z('e2', 'h', ['z0', 'z1', 'z2'], f'date, symbol, t, {", ".join(_REV)}')},
f AS (SELECT *, (z0 + z1 + z2) / 3 AS team_coin FROM h)"""

_FLOWS = ["revenues", "net_income", "operating_income", "income_tax", "pretax_income", "operating_cash_flow", "investing_cash_flow"]
_STOCKS = ["assets", "current_assets", "liabilities", "current_liabilities", "equity", "shares"]
QUARTERS = f"{STATEMENTS_SQL}, quarters AS (SELECT * REPLACE (coalesce(filing_date, end_date + 90) AS filing_date) FROM statements)"
_F = "PARTITION BY symbol ORDER BY filing_date, end_date"
TTM = f"{QUARTERS}, ttm AS (SELECT symbol, filing_date, end_date, {', '.join(f'{roll("sum", c, 4, 4, _F)} AS {c}' for c in _FLOWS)}, {', '.join(_STOCKS)} FROM quarters)"
_E = "PARTITION BY symbol ORDER BY end_date"
_r8 = lambda fn, y: f"CASE WHEN count({y}) OVER ({_E} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) >= 8 THEN {fn}({y}, k) OVER ({_E} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) END"
SCORES = f"""q1 AS (SELECT *, CAST(row_number() OVER ({_E}) AS DOUBLE) AS k, {lag('revenues', 4, _E)} AS r4 FROM quarters), q2 AS (SELECT *, {div('revenues - r4', 'abs(r4)')} AS yoy FROM q1),
scores AS (SELECT symbol, filing_date, {_r8('regr_slope', 'diluted_eps')} * {_r8('regr_r2', 'diluted_eps')} AS EPS_Score, {_r8('regr_r2', 'yoy')} AS Growth_Stability FROM q2)"""
FUNDAMENTAL = f"""WITH {DAILY_SQL}, {TTM}, {SCORES},
k AS (SELECT g.date, g.symbol, g.t, g.close, q.* EXCLUDE (symbol, filing_date, end_date), s.EPS_Score, s.Growth_Stability FROM grid g ASOF LEFT JOIN ttm q ON g.symbol = q.symbol AND g.date >= q.filing_date
      ASOF LEFT JOIN scores s ON g.symbol = s.symbol AND g.date >= s.filing_date),
k2 AS (SELECT *, operating_cash_flow + investing_cash_flow AS fcf, close * shares AS worth, CASE WHEN income_tax / nullif(pretax_income, 0) IS NOT NULL THEN least(greatest(income_tax / nullif(pretax_income, 0), 0), 0.5) END AS rate,
       CASE WHEN operating_cash_flow IS NOT NULL AND net_income IS NOT NULL THEN greatest(operating_cash_flow - net_income, 0) END AS extra FROM k),
f AS (SELECT date, symbol, {div('net_income', 'equity')} AS ROE, {div('operating_income * (1 - rate)', 'assets - current_liabilities')} AS ROIC, -{div('worth + liabilities - current_assets', 'operating_income + extra')} AS EV_EBITDA,
      {div('fcf', 'worth')} AS FCF_Yield, -{div('worth', 'revenues')} AS PS, {div(f"fcf - {lag('fcf', 252)}", f"abs({lag('fcf', 252)})")} AS FCF_Growth, EPS_Score, Growth_Stability FROM k2)"""

# intraday groups, with thresholds for 48 bars a day
_M = "PARTITION BY date, symbol ORDER BY i"
_B = "PARTITION BY date, symbol ORDER BY ts"
_signed = lambda v, k: f"CASE WHEN {v} IS NOT NULL AND {k} IS NOT NULL THEN {v} * (count(*) FILTER (WHERE {v} IS NOT NULL AND {k} IS NOT NULL) OVER d + 1 - 2 * row_number() OVER (PARTITION BY date, symbol, {v} IS NOT NULL AND {k} IS NOT NULL ORDER BY {k}, ts)) END"
_BN = ["vol_battle_ret", "vol_battle_pos", "amp_battle"]
_dist = lambda c: f"abs(({c} - avg({c}) OVER (PARTITION BY date)) / nullif(stddev_samp({c}) OVER (PARTITION BY date), 0))"
_md20 = ", ".join(f"({roll('avg', c, 20, 10)} + {roll('stddev_samp', c, 20, 10)}) / 2 AS {c}" for c in _BN)
BATTLE_DAILY = f"""b0 AS (SELECT symbol, date, ts, volume, count(*) OVER (PARTITION BY date, symbol) AS n, {div('close', lag('close', 5, _B))} - 1 AS ret5, {div('high - low', 'close')} AS amp, close,
 max(close) OVER ({_B} ROWS UNBOUNDED PRECEDING) AS hi, min(close) OVER ({_B} ROWS UNBOUNDED PRECEDING) AS lo FROM ibars),
b1 AS (SELECT *, ({div('close - hi', 'hi')} + {div('close - lo', 'lo')}) / 2 AS pos FROM b0 WHERE n >= 20),
b2 AS (SELECT date, symbol, {_signed('volume', 'ret5')} AS a, {_signed('volume', 'pos')} AS b, {_signed('amp', 'ret5')} AS c, count(ret5) OVER d AS nr, count(pos) OVER d AS np FROM b1 WINDOW d AS (PARTITION BY date, symbol)),
battle AS (SELECT date, symbol, sum(a) FILTER (WHERE nr >= 8) AS vol_battle_ret, sum(b) FILTER (WHERE np >= 8) AS vol_battle_pos, sum(c) FILTER (WHERE nr >= 8) AS amp_battle FROM b2 GROUP BY date, symbol)"""
BATTLE = f"""WITH {INTRADAY_SQL}, {BATTLE_DAILY}, p AS (SELECT iday.date, iday.symbol, iday.t, {', '.join(_BN)} FROM iday LEFT JOIN battle USING (date, symbol)),
p1 AS (SELECT date, symbol, t, {', '.join(f'{_dist(c)} AS {c}' for c in _BN)} FROM p), p2 AS (SELECT date, symbol, t, {_md20} FROM p1),
p3 AS (SELECT *, ({_dist('vol_battle_ret')} + {_dist('vol_battle_pos')}) / 2 AS vol_battle, {_dist('amp_battle')} AS da FROM p2), f AS (SELECT *, ({_dist('vol_battle')} + da) / 2 AS bull_bear_battle FROM p3)"""

_SU = ["weekly_dazzling_vol", "weekly_dazzling_ret"]
SURGE_DAILY = f"""s0 AS (SELECT date, symbol, i, {div('close', lag('close', 1, _M))} - 1 AS ret, volume - {lag('volume', 1, _M)} AS dv FROM ig WHERE n_day >= 20),
s1 AS (SELECT *, CASE WHEN count(ret) OVER a >= 2 THEN stddev_samp(ret) OVER a END AS sd5, count(dv) OVER d AS n, avg(dv) OVER d AS m, stddev_samp(dv) OVER d AS s FROM (SELECT * FROM s0 WHERE i >= 1)
       WINDOW a AS ({_M} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), d AS (PARTITION BY date, symbol)),
surge AS (SELECT date, symbol, avg(sd5) AS weekly_dazzling_vol, avg(ret) AS weekly_dazzling_ret FROM s1 WHERE n >= 8 AND s <> 0 AND dv > m + s GROUP BY date, symbol)"""
SURGE = f"""WITH {INTRADAY_SQL}, {SURGE_DAILY}, p AS (SELECT iday.date, iday.symbol, iday.t, {', '.join(f'abs({c} - avg({c}) OVER (PARTITION BY iday.date)) AS {c}' for c in _SU)} FROM iday LEFT JOIN surge USING (date, symbol)),
{mean_std('p', 'q', _SU)}, q2 AS (SELECT date, symbol, t, -weekly_dazzling_vol AS weekly_dazzling_vol, weekly_dazzling_ret, -weekly_dazzling_vol AS za, weekly_dazzling_ret AS zb FROM q),
{z('q2', 'r', ['za', 'zb'], 'date, symbol, t, weekly_dazzling_vol, weekly_dazzling_ret')}, f AS (SELECT *, (za + zb) / 2 AS moderate_risk FROM r)"""

_FU = ["fuzzy_corr", "fuzzy_amount_ratio", "fuzzy_volume_ratio"]
_ratio = lambda x: f"CASE WHEN count(*) FILTER (WHERE a > m) >= 3 AND avg({x}) > 0 THEN avg({x}) FILTER (WHERE a > m) / nullif(avg({x}), 0) END"
FUZZY_DAILY = f"""u0 AS (SELECT date, symbol, i, volume, close * volume AS tv, {div('close', lag('close', 1, _M))} - 1 AS ret FROM ig WHERE n_day >= 20), u1 AS (SELECT *, {roll('stddev_samp', 'ret', 5, 5, _M)} AS v FROM u0),
u2 AS (SELECT *, {roll('stddev_samp', 'v', 5, 5, _M)} AS a FROM u1), u3 AS (SELECT *, count(*) OVER (PARTITION BY date, symbol) AS n, avg(a) OVER (PARTITION BY date, symbol) AS m FROM u2 WHERE i >= 9 AND a IS NOT NULL AND volume IS NOT NULL AND tv IS NOT NULL),
fuzzy AS (SELECT date, symbol, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(tv) > 0 THEN corr(a, tv) END AS fuzzy_corr, {_ratio('tv')} AS fuzzy_amount_ratio, {_ratio('volume')} AS fuzzy_volume_ratio FROM u3 WHERE n >= 8 GROUP BY date, symbol)"""
FUZZY = f"""WITH {INTRADAY_SQL}, {FUZZY_DAILY}, p AS (SELECT iday.date, iday.symbol, iday.t, {', '.join(_FU)} FROM iday LEFT JOIN fuzzy USING (date, symbol)), {mean_std('p', 'f', _FU, negate=True)}"""

_sq = " + ".join(f"({c} - m) * ({c} - m)" for c in ("open", "high", "low", "close"))
REBUILD_DAILY = f"""r0 AS (SELECT *, (open + high + low + close) / 4 AS m FROM ig WHERE n_day >= 15), r1 AS (SELECT date, symbol, i, m, {_sq} AS ss, {div('close', lag('close', 1, _M))} - 1 AS ret FROM r0),
r2 AS (SELECT *, CASE WHEN count(m) OVER w >= 5 THEN avg(m) OVER w END AS mu, CASE WHEN count(m) OVER w >= 5 THEN (sum(ss) OVER w + 20 * var_pop(m) OVER w) / 19 END AS v FROM r1 WINDOW w AS ({_M} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
r3 AS (SELECT *, CASE WHEN mu > 0 THEN v / nullif(mu * mu, 0) END AS bv FROM r2), r4 AS (SELECT *, ret / nullif(bv, 0) AS rvr FROM r3 WHERE bv > 0 AND ret IS NOT NULL),
r5 AS (SELECT *, count(*) OVER d AS n, avg(bv) OVER d + stddev_samp(bv) OVER d AS cut FROM r4 WINDOW d AS (PARTITION BY date, symbol)),
rebuild AS (SELECT date, symbol, covar_samp(rvr, bv) AS disaster_rebuild, CASE WHEN count(*) FILTER (WHERE bv >= cut) >= 2 THEN covar_samp(rvr, bv) FILTER (WHERE bv >= cut) END AS peak_climbing FROM r5 WHERE n >= 8 GROUP BY date, symbol)"""
REBUILD = f"""WITH {INTRADAY_SQL}, {REBUILD_DAILY}, p AS (SELECT iday.date, iday.symbol, iday.t, disaster_rebuild, peak_climbing FROM iday LEFT JOIN rebuild USING (date, symbol)), {mean_std('p', 'q', ['disaster_rebuild', 'peak_climbing'])},
f AS (SELECT date, symbol, -disaster_rebuild AS disaster_rebuild, peak_climbing FROM q)"""

TIDAL_DAILY = f"""t0 AS (SELECT *, count(close) OVER (PARTITION BY date, symbol) AS nc, count(volume) OVER (PARTITION BY date, symbol) AS nv FROM ig WHERE n_day >= 29),
t1 AS (SELECT *, CASE WHEN i >= 4 AND i <= n_day - 5 THEN sum(coalesce(volume, 0)) OVER ({_M} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) END AS nb FROM t0 WHERE nc > 0 AND nv > 0),
t2 AS (SELECT date, symbol, first(i ORDER BY nb DESC, i) AS pk, max(nb) AS top FROM t1 WHERE i >= 14 AND i <= n_day - 15 GROUP BY date, symbol),
t3 AS (SELECT t1.*, pk FROM t1 JOIN t2 USING (date, symbol) WHERE top <> 0 AND nb IS NOT NULL),
t4 AS (SELECT date, symbol, first(i ORDER BY nb, i) FILTER (WHERE i < pk) AS mi, first(close ORDER BY nb, i) FILTER (WHERE i < pk) AS mc, first(nb ORDER BY nb, i) FILTER (WHERE i < pk) AS mv,
  first(i ORDER BY nb, i) FILTER (WHERE i > pk) AS ni, first(close ORDER BY nb, i) FILTER (WHERE i > pk) AS nc, first(nb ORDER BY nb, i) FILTER (WHERE i > pk) AS nv, first(close ORDER BY i) FILTER (WHERE i = pk) AS pc, max(pk) AS pk FROM t3 GROUP BY date, symbol),
t5 AS (SELECT *, (pc - mc) / nullif(mc, 0) / nullif(pk - mi, 0) AS rise, (nc - pc) / nullif(pc, 0) / nullif(ni - pk, 0) AS ebb FROM t4 WHERE mc IS NOT NULL AND nc IS NOT NULL AND pc IS NOT NULL AND mc <> 0 AND ni <> mi),
tidal AS (SELECT date, symbol, (nc - mc) / nullif(mc, 0) / nullif(ni - mi, 0) AS full_tidal, CASE WHEN mv < nv THEN rise ELSE ebb END AS strong_half_tidal, CASE WHEN mv < nv THEN ebb ELSE rise END AS aggressive_weak_half FROM t5)"""
_TI = ["full_tidal", "strong_half_tidal", "aggressive_weak_half"]
TIDAL = f"""WITH {INTRADAY_SQL}, {TIDAL_DAILY}, p AS (SELECT iday.date, iday.symbol, iday.t, {', '.join(_TI)} FROM iday LEFT JOIN tidal USING (date, symbol)),
p2 AS (SELECT date, symbol, t, {', '.join(f"{roll('avg', c, 5, 4)} AS {c}" for c in _TI)}, {roll('stddev_samp', 'aggressive_weak_half', 5, 4)} AS stable_weak_half FROM p), {z('p2', 'q', [*_TI, 'stable_weak_half'])},
f AS (SELECT date, symbol, {', '.join(_TI)}, -stable_weak_half AS stable_weak_half FROM q)"""

_taylor = lambda r: f"(2 * (({r}) - 1 - ln(CASE WHEN ({r}) > 0 THEN {r} END)) - ln(CASE WHEN ({r}) > 0 THEN {r} END) * ln(CASE WHEN ({r}) > 0 THEN {r} END))"
JUMP_DAILY = f"""j0 AS (SELECT date, symbol, {div('close', lag('close', 1, _M))} AS r FROM ig WHERE n_day >= 20), jump AS (SELECT date, symbol, avg({_taylor('r')}) AS jump FROM j0 GROUP BY date, symbol)"""
_JU = ["modified_amplitude_1", "modified_amplitude_2"]
JUMP = f"""WITH {INTRADAY_SQL}, {JUMP_DAILY}, p AS (SELECT iday.date, iday.symbol, iday.t, high, low, close, jump FROM iday LEFT JOIN ibar_day USING (date, symbol) LEFT JOIN jump USING (date, symbol)),
p1 AS (SELECT date, symbol, t, jump, {div('high - low', lag('close'))} AS amp, {div('high', lag('low'))} AS hr FROM p), p2 AS (SELECT *, {_taylor('hr')} AS ty FROM p1),
p3 AS (SELECT date, symbol, t, jump AS weekly_jump, CASE WHEN jump < avg(jump) OVER (PARTITION BY date) THEN -amp ELSE amp END AS modified_amplitude_1, CASE WHEN ty < avg(ty) OVER (PARTITION BY date) THEN -amp ELSE amp END AS modified_amplitude_2 FROM p2),
{mean_std('p3', 'wj', ['weekly_jump'], negate=True)}, {mean_z('p3', 'ma', _JU)}, e AS (SELECT ma.*, weekly_jump, weekly_jump AS zc, modified_amplitude_1 AS za, modified_amplitude_2 AS zb FROM ma JOIN wj USING (date, symbol, t)),
{z('e', 'e1', ['za', 'zb', 'zc'], 'date, symbol, t, weekly_jump, modified_amplitude_1, modified_amplitude_2')}, e2 AS (SELECT *, (za + zb) / 2 AS modified_amplitude, (za + zb) / 2 AS zd FROM e1),
{z('e2', 'e3', ['zd'], 'date, symbol, t, weekly_jump, modified_amplitude_1, modified_amplitude_2, modified_amplitude, zc')}, f AS (SELECT *, (zc + zd) / 2 AS moth_to_flame FROM e3)"""

GROUPS = {"technical": TECHNICAL, "reversal": REVERSAL, "fundamental": FUNDAMENTAL, "battle": BATTLE, "surge": SURGE, "fuzzy": FUZZY, "rebuild": REBUILD, "tidal": TIDAL, "jump": JUMP}


def factor(group: str, name: str, digits: int) -> str:
    return f"{GROUPS[group]} SELECT date, symbol, round({name}, {digits}) + 0.0 AS value FROM f WHERE {name} IS NOT NULL"
