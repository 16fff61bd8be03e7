"""Queries of fixed income and options, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators import options, rates
from tidemark.plans.table_queries import r, rd
from tidemark.sources import synthetic

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _lit(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)


_EXTRA = [("206001", "9128280A", "2016-12-31", "2017-06-30", "2023-12-31", 2.25, 2, 2, 98.5, 0.0, 98.45, 98.55, 30000.0), ("206002", "9128281B", "2015-11-15", "2016-05-15", "2025-11-15", 2.25, 2, 2, 97.8, 0.26, 97.75, 97.85, None)]
_rows = ", ".join(f"({', '.join(map(_lit, x))})" for x in [*rates.FIXTURE, *_EXTRA])
QUOTES = f"""quotes AS (SELECT id AS KYTREASNO, cusip AS TCUSIP, DATE '2018-12-28' AS CALDT, CAST(a AS DATE) AS TDATDT, CAST(b AS DATE) AS TFCPDT, CAST(c AS DATE) AS TMATDT, coup::DOUBLE AS TCOUPRT, nip AS TNIPPY, it AS ITYPE,
 px::DOUBLE AS TDNOMPRC, ac::DOUBLE AS TDACCINT, bid::DOUBLE AS TDBID, ask::DOUBLE AS TDASK, outs::DOUBLE AS TDTOTOUT FROM (VALUES {_rows}) v(id, cusip, a, b, c, coup, nip, it, px, ac, bid, ask, outs))"""
_buckets = ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in rates.BUCKETS)
OTR = f"""WITH {QUOTES}, bk AS (SELECT * FROM (VALUES {_buckets}) v(bucket, lo, hi)), ins AS (SELECT *, date_diff('day', CALDT, TMATDT) / 365.25 AS ttm, TDASK - TDBID AS spread FROM quotes),
ch AS (SELECT *, row_number() OVER (PARTITION BY CALDT, bucket ORDER BY TDATDT DESC NULLS LAST, spread ASC NULLS LAST, TDTOTOUT DESC NULLS LAST, CAST(KYTREASNO AS BIGINT)) AS n FROM ins JOIN bk ON ttm BETWEEN lo AND hi)"""


@query(f"{OTR} SELECT bucket, KYTREASNO AS selected_id, {rd('ttm')} AS ttm, {rd('spread')} AS spread, TDBID AS bid, TDASK AS ask, TDTOTOUT AS liquidity FROM ch WHERE n = 1")
def otr_report(spark, sf_dir):
    _, _, report = rates.split_on_the_run(rates.sample_quotes(spark, True))
    return report.drop("CALDT").withColumns({"ttm": r("ttm"), "spread": r("spread")})


@query(f"{OTR} SELECT KYTREASNO, TCUSIP FROM quotes WHERE KYTREASNO NOT IN (SELECT KYTREASNO FROM ch WHERE n = 1)")
def off_the_run(spark, sf_dir):
    return rates.split_on_the_run(rates.sample_quotes(spark, True))[1].select("KYTREASNO", "TCUSIP")


@query(f"""WITH {QUOTES} SELECT TCUSIP AS cusip, CASE WHEN ITYPE = 4 OR coalesce(TNIPPY, 0) = 0 OR coalesce(TCOUPRT, 0) = 0 THEN 'bill' WHEN ITYPE = 2 THEN 'note' ELSE 'bond' END AS itype,
CASE WHEN ITYPE = 4 OR coalesce(TNIPPY, 0) = 0 OR coalesce(TCOUPRT, 0) = 0 THEN 0 ELSE TCOUPRT / 100 END AS coupon, CAST(CASE WHEN ITYPE = 4 OR coalesce(TNIPPY, 0) = 0 OR coalesce(TCOUPRT, 0) = 0 THEN 0 ELSE greatest(TNIPPY, 2) END AS INTEGER) AS freq FROM quotes""")
def instruments(spark, sf_dir):
    return rates.instruments(rates.sample_quotes(spark, True)).select("cusip", "itype", "coupon", "freq")


def _items(spark, extra=False, **o):
    return rates.cashflows(rates.instruments(rates.sample_quotes(spark, extra)), **o)


# steps from the date before, as chained month arithmetic does; a recursive query on the SQL side
FLOWS = f"""WITH RECURSIVE {QUOTES}, it AS (SELECT TCUSIP AS cusip, CALDT AS v, TFCPDT AS f, TMATDT AS m, TDATDT AS dd, CASE WHEN ITYPE = 4 THEN 0 ELSE TCOUPRT END AS c, CASE WHEN ITYPE = 4 THEN 0 ELSE TNIPPY END AS q, TDNOMPRC AS clean, TDACCINT AS accrued FROM quotes),
st AS (SELECT cusip, f AS d FROM it WHERE q > 0 AND f < m UNION ALL SELECT st.cusip, CAST(d + INTERVAL 6 MONTH AS DATE) FROM st JOIN it USING (cusip) WHERE CAST(d + INTERVAL 6 MONTH AS DATE) < m),
flows AS (SELECT cusip, d AS pay_date, c / 2 AS amount FROM st JOIN it USING (cusip) WHERE d > v UNION ALL SELECT cusip, m, CASE WHEN q > 0 THEN c / q ELSE 0 END + 100 FROM it WHERE m > v)"""


@query(f"{FLOWS} SELECT cusip, pay_date, {rd('amount')} AS amount FROM flows")
def cashflows(spark, sf_dir):
    return _items(spark, True).select("cusip", F.explode("flows").alias("x")).select("cusip", "x.pay_date", r("x.amount").alias("amount"))


#: Stored values: of the report those that were observed of the compatible algorithm, of the exact one and of the spline those of a solution written apart from this library.
_REPORT = """SELECT DATE '2018-12-28' AS val_date, CAST(step AS INTEGER) AS step, cusip, maturity_t, CAST(maturity AS DATE) AS maturity, price, pv_known, cf_maturity, df_solved, zero_cc, residual, 'ok' AS status, '' AS warn
FROM (VALUES (1, '912796UQ', 0.164271::DOUBLE, '2019-02-26', 99.598333333334::DOUBLE, 0.0::DOUBLE, 100.0::DOUBLE, 0.995983::DOUBLE, 0.024501::DOUBLE, 0.0::DOUBLE), (2, '912796RW', 0.517454, '2019-07-05', 98.7098125, 0.0, 100.0, 0.987098, 0.025096, 0.0),
(3, '912796RT', 1.013005, '2020-01-02', 97.41, 0.0, 100.0, 0.9741, 0.025904, 0.0), {}) t(step, cusip, maturity_t, maturity, price, pv_known, cf_maturity, df_solved, zero_cc, residual)"""
_COMPATIBLE = _REPORT.format("""(4, '9128285S', 2.009582, '2020-12-31', 99.95703125, 4.839555, 101.25, 0.939432, 0.031091, -0.016955), (5, '9128285U', 5.007529, '2023-12-31', 100.328125, 12.010156, 101.3125, 0.871738, 0.027412, 0.138007),
(6, '9128285M', 9.883641, '2028-11-15', 103.83995165745856, 26.071926, 101.5625, 0.765716, 0.027009, -0.044326), (7, '912810SE', 29.883641, '2048-11-15', 107.28371029005525, 68.464865, 101.6875, 0.381746, 0.032225, -2.790878)""")
_EXACT = _REPORT.format("""(4, '9128285S', 2.009582, '2020-12-31', 99.95703125, 3.655444, 101.25, 0.951127, 0.024934, 0.0), (5, '9128285U', 5.007529, '2023-12-31', 100.328125, 11.094434, 101.3125, 0.880777, 0.025352, 0.0),
(6, '9128285M', 9.883641, '2028-11-15', 103.83995165745856, 26.199586, 101.5625, 0.764459, 0.027175, 0.0), (7, '912810SE', 29.883641, '2048-11-15', 107.28371029005525, 66.594933, 101.6875, 0.400135, 0.030651, 0.0)""")
_SPLINE = "SELECT DATE '2018-12-28' AS val_date, t::DOUBLE AS t, df::DOUBLE AS df FROM (VALUES (0.0, 1.0), (0.5, 0.95), (1.0, 0.9), (1.5, 0.845571), (2.0, 0.8), (2.5, 0.763544), (3.0, 0.734238), (3.5, 0.70994), (4.0, 0.688832), (4.5, 0.669323), (5.0, 0.65), (5.5, 0.629859), (6.0, 0.609003), (6.5, 0.587769), (7.0, 0.566463), (7.5, 0.545357), (8.0, 0.524688), (8.5, 0.504659), (9.0, 0.485443), (9.5, 0.467183), (10.0, 0.45), (10.5, 0.43396), (11.0, 0.419001), (11.5, 0.405038), (12.0, 0.391993), (12.5, 0.379794), (13.0, 0.368376), (13.5, 0.357682), (14.0, 0.347655), (14.5, 0.338247), (15.0, 0.329412), (15.5, 0.321109), (16.0, 0.313298), (16.5, 0.305944), (17.0, 0.299014), (17.5, 0.292479), (18.0, 0.28631), (18.5, 0.280481), (19.0, 0.274968), (19.5, 0.269748), (20.0, 0.264801), (20.5, 0.260106), (21.0, 0.255647), (21.5, 0.251405), (22.0, 0.247365), (22.5, 0.243511), (23.0, 0.239829), (23.5, 0.236307), (24.0, 0.23293), (24.5, 0.229688), (25.0, 0.226568), (25.5, 0.223561), (26.0, 0.220656), (26.5, 0.217842), (27.0, 0.215112), (27.5, 0.212455), (28.0, 0.209864), (28.5, 0.207331), (29.0, 0.204847), (29.5, 0.202406), (30.0, 0.2)) v(t, df)"
_EOM = f"""{FLOWS}, sk AS (SELECT cusip, m, v, c, CASE WHEN f = last_day(f) THEN last_day(CAST(f + to_months(CAST(6 * k AS INTEGER)) AS DATE)) ELSE CAST(f + to_months(CAST(6 * k AS INTEGER)) AS DATE) END AS d FROM it, range(0, 121) g(k) WHERE q > 0),
fe AS (SELECT cusip, d, c / 2 AS a FROM sk WHERE d > v AND d <= m UNION ALL SELECT cusip, m, 100.0 FROM it WHERE m > v) SELECT cusip, d AS pay_date, {rd('sum(a)')} AS amount FROM fe WHERE cusip NOT IN ('9128280A', '9128281B') GROUP BY cusip, d"""


@query(_EOM)
def cashflows_end_of_month(spark, sf_dir):
    return _items(spark, end_of_month=True).select("cusip", F.explode("flows").alias("x")).select("cusip", "x.pay_date", r("x.amount").alias("amount"))


@query(_COMPATIBLE)
def bootstrap_report(spark, sf_dir):
    return rates.bootstrap(_items(spark)).withColumns({c: r(c) for c in ("maturity_t", "pv_known", "df_solved", "zero_cc", "residual")})


@query(_EXACT)
def bootstrap_exact(spark, sf_dir):
    return rates.bootstrap(_items(spark, end_of_month=True), exact=True).withColumns({c: r(c) for c in ("maturity_t", "pv_known", "df_solved", "zero_cc", "residual")})


_NODES = [(0.1, 0.98), (0.5, 0.95), (1.0, 0.90), (2.0, 0.80), (5.0, 0.65), (10.0, 0.45), (30.0, 0.2)]
NODES = "nodes AS (SELECT t::DOUBLE AS t, df::DOUBLE AS df, row_number() OVER (ORDER BY t) AS i FROM (VALUES " + ", ".join(f"({t}, {d})" for t, d in _NODES) + ") v(t, df)), seg AS (SELECT i, t AS t0, ln(df) AS l0, lead(t) OVER (ORDER BY t) AS t1, ln(lead(df) OVER (ORDER BY t)) AS l1 FROM nodes)"


def df_sql(t: str, shift: str = "0") -> str:
    pick = f"greatest(1, least({len(_NODES) - 1}, (SELECT count(*) FROM nodes WHERE nodes.t <= {t})))"
    return f"(CASE WHEN {t} <= 0 THEN 1.0 ELSE (SELECT exp(l0 + (l1 - l0) / (t1 - t0) * ({t} - t0)) FROM seg WHERE i = {pick}) * exp(-({shift}) * {t}) END)"


def _curve(spark) -> DataFrame:
    nodes = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(d).alias("df")) for t, d in _NODES))
    return spark.range(1).select(F.lit("2018-12-28").cast("date").alias("val_date"), nodes.alias("nodes"))


_TIMES = "tt AS (SELECT range / 4.0::DOUBLE AS tq FROM range(0, 161))"


@query(f"WITH {NODES}, {_TIMES}, d AS (SELECT tq, {df_sql('tq')} AS df FROM tt) SELECT tq AS t, {rd('df')} AS df, {rd('CASE WHEN tq <= 0 THEN 0 ELSE -ln(df) / nullif(tq, 0) END')} AS zero_cc, {rd('CASE WHEN tq <= 0 THEN 0 ELSE (1 / df - 1) / nullif(tq, 0) END')} AS zero_simple FROM d")
def zero_rates(spark, sf_dir):
    t = F.col("id") / 4.0
    rows = spark.range(161).select(t.cast("double").alias("t")).crossJoin(_curve(spark))
    return rows.select("t", r(rates.discount("nodes", "t")).alias("df"), r(rates.zero_rate("nodes", "t")).alias("zero_cc"), r(rates.zero_rate("nodes", "t", True)).alias("zero_simple"))


@query(f"WITH {NODES}, {_TIMES} SELECT tq AS t, {rd(f'(ln({df_sql("tq")}) - ln({df_sql("(tq + 1)")}))')} AS fwd FROM tt")
def forward_rates(spark, sf_dir):
    rows = spark.range(161).select((F.col("id") / 4.0).cast("double").alias("t")).crossJoin(_curve(spark))
    return rows.select("t", r(rates.forward_rate("nodes", F.col("t"), F.col("t") + 1)).alias("fwd"))


_PV = lambda s: f"SELECT cusip, sum(amount * {df_sql('(date_diff(' + chr(39) + 'day' + chr(39) + ', v, pay_date) / 365.25)', s)}) AS dirty FROM flows JOIN it USING (cusip) GROUP BY cusip"


@query(f"{FLOWS}, {NODES}, p AS ({_PV('0')}) SELECT cusip, {rd('dirty')} AS dirty, {rd('dirty - accrued')} AS clean_price, {rd('dirty - clean - accrued')} AS difference FROM p JOIN it USING (cusip)")
def bond_price(spark, sf_dir):
    p = rates.price(_items(spark, True), _curve(spark))
    return p.select("cusip", r("dirty").alias("dirty"), r("clean_price").alias("clean_price"), r("difference").alias("difference"))


@query(f"{FLOWS}, {NODES}, a AS ({_PV('0')}), b AS ({_PV('0.0001')}), c AS ({_PV('-0.0001')}) SELECT cusip, {rd('a.dirty')} AS dirty, {rd('(c.dirty - b.dirty) / 0.0002 / a.dirty', 5)} AS duration FROM a JOIN b USING (cusip) JOIN c USING (cusip)")
def duration(spark, sf_dir):
    d = rates.duration(_items(spark, True), _curve(spark))
    return d.select("cusip", r("dirty").alias("dirty"), r("duration", 5).alias("duration"))


@query(f"{FLOWS}, {NODES}, p AS ({_PV('0.0125')}) SELECT cusip, {rd('dirty')} AS target, 0.0125::DOUBLE AS z_spread FROM p")
def z_spread(spark, sf_dir):
    """Recovers a spread of 125 basis points from prices on the shifted curve."""
    items = _items(spark, True)
    target = rates.price(items, rates.shifted(_curve(spark), 0.0125)).select("cusip", F.col("dirty").alias("target"))
    rows = rates.z_spread(rates.price(items, _curve(spark)).join(target, "cusip"), "target")
    return rows.select("cusip", r("target").alias("target"), r("z_spread").alias("z_spread"))


@query()
def off_the_run_pricing(spark, sf_dir):
    quotes = rates.sample_quotes(spark, True)
    otr, off, _ = rates.split_on_the_run(quotes)
    curve = rates.curves(rates.bootstrap(rates.cashflows(rates.instruments(otr))))
    priced = rates.z_spread(rates.price(rates.cashflows(rates.instruments(off)), curve))
    return priced.select("cusip", r("dirty").alias("dirty"), r("market").alias("market"), r("difference").alias("difference"), r("z_spread", 8).alias("z_spread"))


@query(_SPLINE)
def spline_curve(spark, sf_dir):
    return rates.spline_curve(_curve(spark), [i / 2 for i in range(61)]).withColumn("df", r("df"))


_x = lambda a: f"(1 - exp(-tq / {a})) / nullif(tq / {a}, 0)"


@query(f"WITH {_TIMES} SELECT tq AS t, {rd(f'0.03 - 0.01 * {_x(1.5)} + 0.02 * ({_x(1.5)} - exp(-tq / 1.5)) + 0.01 * ({_x(5.0)} - exp(-tq / 5.0))')} AS zero FROM tt WHERE tq > 0")
def nelson_siegel(spark, sf_dir):
    rows = spark.range(1, 161).select((F.col("id") / 4.0).cast("double").alias("t"))
    return rows.select("t", r(rates.nelson_siegel_svensson("t", 0.03, -0.01, 0.02, 0.01, 1.5, 5.0)).alias("zero"))


@query(f"SELECT p_partkey, {rd('100 * (1 - p_size / 1000.0 * (p_partkey % 360) / 360)')} AS price, {rd('p_size / 1000.0')} AS yield FROM part")
def bill_and_note(spark, sf_dir):
    """Bill prices, and the yields of notes priced at par."""
    p = synthetic.table(spark, sf_dir, "part")
    rate = F.col("p_size") / 1000.0
    return p.select("p_partkey", r(rates.bill_price(rate, F.col("p_partkey") % 360)).alias("price"), r(rates.note_yield(F.lit(100.0), rate, (F.col("p_partkey") % 10) + 1)).alias("yield"))


# options

CHAIN = """chain AS (SELECT p_brand AS symbol, DATE '2024-01-01' + CAST(p_size * 7 AS INTEGER) AS expiration, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS type, p_retailprice AS strike, 950.0::DOUBLE AS spot, p_size * 7 / 365.0::DOUBLE AS years,
 0.1 + (p_partkey % 50) / 100.0::DOUBLE AS iv, p_partkey % 40 / 8.0::DOUBLE AS bid, p_partkey % 40 / 8.0 + 0.1::DOUBLE AS ask, (CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END) * ((p_partkey * 37) % 101) / 101.0::DOUBLE AS delta, p_partkey FROM part)"""


def _chain(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    return synthetic.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_size") * 7).cast("int")).alias("expiration"), F.when(key % 2 == 0, "call").otherwise("put").alias("type"), F.col("p_retailprice").alias("strike"),
        F.lit(950.0).alias("spot"), (F.col("p_size") * 7 / 365.0).cast("double").alias("years"), (0.1 + (key % 50) / 100.0).alias("iv"), (key % 40 / 8.0).alias("bid"), (key % 40 / 8.0 + 0.1).alias("ask"),
        (F.when(key % 2 == 0, 1).otherwise(-1) * ((key * 37) % 101) / 101.0).alias("delta"), "p_partkey",
    )


_PHI = "(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * CASE WHEN ({x}) = 0 THEN 0 ELSE sign({x}) * list_sum(list_transform(range(0, 121), lambda k: exp((2 * k + 1) * ln(abs({x})) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))) END)"
_phi = lambda x: _PHI.replace("{x}", f"least(greatest({x}, -8), 8)")
BSM = f"""{CHAIN}, d AS (SELECT *, (ln(spot / strike) + (0.045 - 0.013 + iv * iv / 2) * years) / (iv * sqrt(years)) AS d1 FROM chain), d2_ AS (SELECT *, d1 - iv * sqrt(years) AS d2 FROM d),
bsm AS (SELECT *, CASE WHEN type = 'call' THEN spot * exp(-0.013 * years) * {_phi('d1')} - strike * exp(-0.045 * years) * {_phi('d2')} ELSE strike * exp(-0.045 * years) * {_phi('(-d2)')} - spot * exp(-0.013 * years) * {_phi('(-d1)')} END AS price,
 spot * exp(-0.013 * years) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(years) AS vega FROM d2_)"""


@query(f"WITH {BSM} SELECT p_partkey, {rd('price', 5)} AS price, {rd('vega', 5)} AS vega FROM bsm")
def black_scholes(spark, sf_dir):
    return _chain(spark, sf_dir).select("p_partkey", r(options.black_scholes("type", "spot", "strike", "years", 0.045, 0.013, "iv"), 5).alias("price"), r(options.vega("spot", "strike", "years", 0.045, 0.013, "iv"), 5).alias("vega"))


@query(f"WITH {CHAIN} SELECT p_partkey, round(iv, 4) AS iv FROM chain WHERE iv BETWEEN 0.25 AND 0.5 AND years > 0.2")
def implied_volatility(spark, sf_dir):
    """Recovers the volatility that priced each option."""
    rows = _chain(spark, sf_dir).where("iv between 0.25 and 0.5 and years > 0.2").withColumn("price", options.black_scholes("type", "spot", "strike", "years", 0.045, 0.013, "iv"))
    return rows.select("p_partkey", F.round(options.implied_volatility(tolerance=1e-8)("type", "price", "spot", "strike", "years"), 4).alias("iv"))


_OTM = f"{CHAIN}, otm AS (SELECT * FROM chain WHERE (type = 'call' AND strike > spot) OR (type = 'put' AND strike < spot)), surf AS (SELECT *, strike / nullif(spot, 0) AS moneyness, (bid + ask) / 2 AS mid FROM otm WHERE years > 0.015 AND (bid + ask) / 2 > 0.05 AND iv BETWEEN 0.05 AND 1.5)"


@query(f"WITH {_OTM} SELECT p_partkey FROM otm")
def option_otm_filter(spark, sf_dir):
    return options.out_of_the_money(_chain(spark, sf_dir)).select("p_partkey")


@query(f"WITH {_OTM} SELECT symbol, expiration, type, strike, {rd('moneyness')} AS moneyness, {rd('years')} AS years, {rd('mid')} AS mid, {rd('iv')} AS iv FROM surf")
def iv_surface(spark, sf_dir):
    return options.surface(_chain(spark, sf_dir)).withColumns({c: r(c) for c in ("moneyness", "years", "mid", "iv")})


@query(f"WITH {_OTM} SELECT symbol, expiration, first(strike ORDER BY abs(moneyness - 1), strike, type) AS strike, {rd('first(years ORDER BY abs(moneyness - 1), strike, type)')} AS years FROM surf GROUP BY symbol, expiration")
def term_structure(spark, sf_dir):
    return options.term_structure(options.surface(_chain(spark, sf_dir))).select("symbol", "expiration", "strike", r("years").alias("years"))


@query(f"WITH {CHAIN}, e AS (SELECT DISTINCT symbol, expiration, date_diff('day', DATE '2024-01-01', expiration) AS dte FROM chain), t AS (SELECT * FROM (VALUES (7), (30), (60), (90), (180), (365)) v(target)) SELECT DISTINCT symbol, first(expiration ORDER BY abs(dte - target), expiration) AS expiration FROM e CROSS JOIN t WHERE dte > 0 GROUP BY symbol, target")
def nearest_expiries(spark, sf_dir):
    return options.nearest_expiries(_chain(spark, sf_dir), "2024-01-01")


@query("WITH s AS (SELECT p_brand AS symbol, min(p_retailprice) AS spot FROM part GROUP BY p_brand), g AS (SELECT symbol, spot, CAST(floor(spot * 0.95 / 5) * 5 AS INTEGER) AS lo, CAST(ceil(spot * 1.05 / 5) * 5 AS INTEGER) AS hi FROM s) SELECT symbol, spot, CAST(unnest(range(lo, hi + 1, 5)) AS INTEGER) AS strike FROM g")
def strikes_grid(spark, sf_dir):
    return options.strike_grid(synthetic.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_retailprice").alias("spot")))


_LEGS = f"{CHAIN}, far AS (SELECT * FROM chain WHERE ((type = 'put' AND strike <= spot * (1 - 0.01)) OR (type = 'call' AND strike >= spot * (1 + 0.01))) AND abs(delta) <= 0.5), lg AS (SELECT symbol, expiration, first(strike ORDER BY abs(abs(delta) - 0.15), strike) FILTER (WHERE type = 'put') AS sp, first(strike ORDER BY abs(abs(delta) - 0.15), strike) FILTER (WHERE type = 'call') AS sc FROM far GROUP BY symbol, expiration), legs AS (SELECT symbol, expiration, sp - 10 AS long_put, sp AS short_put, sc AS short_call, sc + 10 AS long_call FROM lg WHERE sp IS NOT NULL AND sc IS NOT NULL)"


def _legs(spark, sf_dir):
    return options.condor_legs(_chain(spark, sf_dir), max_delta=0.5)


@query(f"WITH {_LEGS} SELECT * FROM legs")
def condor_legs(spark, sf_dir):
    return _legs(spark, sf_dir)


@query(f"WITH {_LEGS} SELECT symbol, expiration, {rd('(dayofyear(expiration) % 4) * 100 / nullif(1000 - (dayofyear(expiration) % 4) * 100, 0)')} AS reward_risk, (dayofyear(expiration) % 4) * 100 / nullif(1000 - (dayofyear(expiration) % 4) * 100, 0) >= 0.1 AS accepted FROM legs")
def reward_gate(spark, sf_dir):
    rows = options.reward_gate(_legs(spark, sf_dir).withColumn("credit", (F.dayofyear("expiration") % 4).cast("double")))
    return rows.select("symbol", "expiration", r("reward_risk").alias("reward_risk"), "accepted")


_SNAP = "snap AS (SELECT event_id, ts, 4000 + value AS spot, 4010.0 AS sp, 4300.0 AS sc, (user_id % 20) / 100.0 - 0.1 AS pd, (user_id % 30) / 100.0 AS cd, 2.0 AS credit, (event_id % 50) / 10.0 AS mid, user_id % 45 AS dte FROM events)"


@query(f"WITH {_SNAP} SELECT event_id, CASE WHEN strftime(ts, '%H:%M:%S') >= '15:45:00' THEN 'CLOSE_EOD' WHEN spot <= sp * 1.005 OR spot >= sc * 0.995 THEN 'CLOSE_PROXIMITY' WHEN abs(pd + cd) * 100 >= 15 THEN 'CLOSE_DELTA' WHEN mid <= credit * 0.5 THEN 'TAKE_PROFIT' WHEN mid >= credit * 2 THEN 'STOP_LOSS' WHEN dte <= 30 THEN 'TIME_EXIT' ELSE 'HOLD' END AS action FROM snap")
def risk_actions(spark, sf_dir):
    e = synthetic.table(spark, sf_dir, "events")
    rows = e.select("event_id", "ts", (4000 + F.col("value")).alias("spot"), F.lit(4010.0).alias("short_put"), F.lit(4300.0).alias("short_call"), ((F.col("user_id") % 20) / 100.0 - 0.1).alias("put_delta"), ((F.col("user_id") % 30) / 100.0).alias("call_delta"), F.lit(2.0).alias("credit"), ((F.col("event_id") % 50) / 10.0).alias("combo_mid"), (F.col("user_id") % 45).alias("dte"))
    return options.risk_actions(rows, red_delta=15.0, delta_multiplier=100.0, min_days=30).select("event_id", "action")


@query("SELECT event_id, value / 20 BETWEEN 12 AND 30 AND coalesce((value / 20 - 15) / 15, 0) <= 0.15 AND strftime(ts, '%H:%M:%S') BETWEEN '09:45:00' AND '11:30:00' AS enter FROM events")
def entry_allowed(spark, sf_dir):
    rows = synthetic.table(spark, sf_dir, "events").select("event_id", "ts", (F.col("value") / 20).alias("vix"), F.lit(15.0).alias("vix_before"))
    return options.entry_allowed(rows).select("event_id", "enter")


@query(f"WITH {CHAIN} SELECT symbol, expiration, {rd('sum((CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE -1 END) * (bid + ask) / 2)')} AS combo_mid FROM chain GROUP BY symbol, expiration")
def combo_mid(spark, sf_dir):
    legs = _chain(spark, sf_dir).withColumn("side", F.when(F.col("p_partkey") % 3 == 0, "short").otherwise("long"))
    return options.combo_mid(legs).withColumn("combo_mid", r("combo_mid"))


def _log(spark, sf_dir) -> DataFrame:
    """Orders as condor trades: two in three open, each filled at once."""
    o = synthetic.table(spark, sf_dir, "orders").where("o_orderkey % 3 < 2 or o_orderkey % 2 = 0")
    base = o.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderkey") % 3 == 0, "close").otherwise("open").alias("action"), F.date_format("o_orderdate", "yyyyMM").alias("expiry"),
        F.col("o_orderpriority").alias("reason"), (F.col("o_orderkey") % 500 / 100.0).alias("fill_price"), (F.col("o_orderkey") % 4 + 1).cast("long").alias("qty"), F.lit(1.3).alias("commission"),
    )
    return base.withColumn("event", F.lit("ORDER")).unionByName(base.withColumn("event", F.lit("FILL")))


_L = "PARTITION BY expiry ORDER BY seq"
TRIPS = f"""WITH lo AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'close' ELSE 'open' END AS action, strftime(o_orderdate, '%Y%m') AS expiry, o_orderkey % 500 / 100.0::DOUBLE AS px, o_orderkey % 4 + 1 AS qty FROM orders WHERE o_orderkey % 3 < 2 OR o_orderkey % 2 = 0),
l1 AS (SELECT *, sum(CASE action WHEN 'open' THEN 1 ELSE -1 END) OVER ({_L}) AS lv FROM lo), l2 AS (SELECT *, least(min(lv) OVER ({_L}), 0) AS void, sum(CAST(action = 'open' AS INTEGER)) OVER ({_L}) AS ko FROM l1), l3 AS (SELECT *, void = coalesce(lag(void) OVER ({_L}), 0) AS ok FROM l2),
l4 AS (SELECT *, sum(CAST(action = 'close' AND ok AS INTEGER)) OVER ({_L}) AS kc FROM l3), trips AS (SELECT a.expiry, a.ko AS k, a.px AS credit, b.px AS debit, least(a.qty, b.qty) AS qty, (a.px - b.px) * 100 * least(a.qty, b.qty) AS gross_pnl, (a.px - b.px) * 100 * least(a.qty, b.qty) - 2.6 AS net_pnl
 FROM l4 a JOIN l4 b ON a.expiry = b.expiry AND a.ko = b.kc AND a.action = 'open' AND b.action = 'close' AND b.ok)"""


@query(f"{TRIPS} SELECT expiry, CAST(k AS BIGINT) AS k, {rd('credit')} AS credit, {rd('debit')} AS debit, qty, {rd('gross_pnl', 3)} AS gross_pnl, {rd('net_pnl', 3)} AS net_pnl FROM trips")
def trade_round_trips(spark, sf_dir):
    t = options.round_trips(_log(spark, sf_dir))
    return t.select("expiry", "k", r("credit").alias("credit"), r("debit").alias("debit"), "qty", r("gross_pnl", 3).alias("gross_pnl"), r("net_pnl", 3).alias("net_pnl"))


@query(f"""{TRIPS}, c AS (SELECT *, sum(net_pnl) OVER (ORDER BY expiry, k ROWS UNBOUNDED PRECEDING) AS tot FROM trips), p AS (SELECT *, greatest(max(tot) OVER (ORDER BY expiry, k ROWS UNBOUNDED PRECEDING), 0) AS pk FROM c)
SELECT count(*) AS total_trades, {rd('sum(net_pnl)', 2)} AS net_pnl, {rd('avg(CAST(net_pnl > 0 AS INTEGER))')} AS win_rate, {rd('max(pk - tot)', 2)} AS max_drawdown, count(*) FILTER (WHERE net_pnl < -500) AS tail_losses FROM p""")
def trade_log_summary(spark, sf_dir):
    s = options.trade_summary(options.round_trips(_log(spark, sf_dir)))
    return s.select("total_trades", r("net_pnl", 2).alias("net_pnl"), r("win_rate").alias("win_rate"), r("max_drawdown", 2).alias("max_drawdown"), "tail_losses")
