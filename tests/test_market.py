"""Kernels, factors, portfolios, curves and options against plain Python, and stored values of the Treasury sample."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.functions import kernels as k
from tidemark.operators import backtest, factors, ml, options, rates, research, signals
from tidemark.sources import bars as bar_sources, tables


def frame(spark, pdf, schema):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(4)
    x = pd.DataFrame(rng.standard_normal((60, 9)).cumsum(0) + 50, columns=[f"s{i}" for i in range(9)])
    return x.mask(rng.random(x.shape) < 0.08)


@pytest.fixture(scope="module")
def long(spark, panel):
    rows = panel.rename_axis("t").reset_index().melt("t", var_name="symbol", value_name="x")
    rows["date"] = [dt.date(2024, 1, 1) + dt.timedelta(int(i)) for i in rows["t"]]
    return frame(spark, rows[["t", "symbol", "x", "date"]], "t int, symbol string, x double, date date").cache()


def wide(df, value):
    return df.select("t", "symbol", value).toPandas().pivot(index="t", columns="symbol", values=value).astype(float)


def close(a, b):
    return np.allclose(a.to_numpy(float), b.to_numpy(float), equal_nan=True, atol=1e-9)


def test_rolling_and_ewm(long, panel):
    w = k.series()
    assert close(wide(long.withColumn("y", k.rolling(F.stddev_samp, "x", 7, 4, w)), "y"), panel.rolling(7, min_periods=4).std())
    assert close(wide(long.withColumn("y", k.ewm_mean("x", 10, 5, w)), "y"), panel.ewm(span=10, min_periods=5).mean())
    assert close(wide(long.withColumn("y", k.ffill("x", w)), "y"), panel.ffill())


def test_ranks_and_scores(long, panel):
    assert close(wide(long.withColumn("y", k.rank_average("x", "date")), "y"), panel.rank(axis=1))
    assert close(wide(long.withColumn("y", k.rank_percent("x", "date")), "y"), panel.rank(axis=1, pct=True))

    def score(row):
        med = row.median()
        mad = (row - med).abs().median()
        row = row.clip(med - 3 * 1.4826 * mad, med + 3 * 1.4826 * mad) if mad else row
        return (row - row.mean()) / row.std()

    assert close(wide(k.zscore(long, ["x"]), "x"), panel.apply(score, axis=1))


def test_quantile_buckets_are_those_of_qcut(long, panel):
    got = wide(long.withColumn("y", k.quantile_bucket("x", 4)), "y")
    assert close(got, panel.apply(lambda r: pd.qcut(r.rank(method="first"), 4, labels=False) + 1, axis=1))


def test_week_end(spark):
    days = spark.createDataFrame([(dt.date(2024, 3, d),) for d in range(1, 10)], "d date").select("d", k.week_end("d").alias("w")).collect()
    assert [r.w.day for r in days] == [1, 8, 8, 8, 8, 8, 8, 8, 15]


def test_asof_keeps_missing_values(spark):
    left = spark.createDataFrame([("a", dt.date(2024, 1, d)) for d in (1, 5, 9)], "symbol string, date date")
    right = spark.createDataFrame([("a", dt.date(2024, 1, 2), 1.0), ("a", dt.date(2024, 1, 8), None)], "symbol string, at date, v double")
    assert [r.v for r in k.asof_backward(left, right, "date", "at", "symbol", ["v"]).orderBy("date").collect()] == [None, 1.0, None]


def test_densify_averages_repeats_and_drops_empty_symbols(spark):
    d = dt.date(2024, 1, 1)
    rows = [(d, "a", 1.0), (d, "a", 3.0), (d + dt.timedelta(1), "b", 5.0), (d, "c", None)]
    got = {(r.t, r.symbol): r.close for r in bar_sources.densify(spark.createDataFrame(rows, "date date, symbol string, close double")).collect()}
    assert got == {(0, "a"): 2.0, (1, "a"): None, (0, "b"): None, (1, "b"): 5.0}


def test_bar_store(spark, tmp_path):
    store = bar_sources.BarStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.load()
    bar = lambda ts, s, c: (pd.Timestamp(ts).to_pydatetime(), s, c, c, c, c, 10)
    store.save(spark.createDataFrame([bar("2023-05-01", "a", 1.0), bar("2024-05-01", "a", 2.0)], bar_sources.BAR))
    store.save(spark.createDataFrame([bar("2024-05-01", "a", 3.0), bar("2024-05-02", "b", 4.0)], bar_sources.BAR))
    assert sorted((r.symbol, r.close) for r in store.load().collect()) == [("a", 1.0), ("a", 3.0), ("b", 4.0)]
    assert [r.close for r in store.load(["a"], "2024-01-01", "2024-12-31").collect()] == [3.0]
    assert [r.symbol for r in store.symbols().collect()] == ["a", "b"] and store.latest().day == 2 and store.exists() and not store.exists("1m")
    plan = store.load(["a"], "2024-01-01", "2024-12-31")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [" in plan


def test_battle_closed_form(spark):
    rng = np.random.default_rng(9)
    n = 40
    close_, volume = rng.random(n) + 10, rng.integers(1, 9, n).astype(float)
    rows = [(dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 9, i), "a", float(c), float(c) + 1, float(c) - 1, float(c), float(v)) for i, (c, v) in enumerate(zip(close_, volume))]
    bars = spark.createDataFrame(rows, "date date, ts timestamp, symbol string, open double, high double, low double, close double, volume double")
    got = factors.battle_daily(bars).first()
    ret = np.full(n, np.nan)
    ret[5:] = close_[5:] / close_[:-5] - 1
    ok = ~np.isnan(ret)
    order = np.argsort(ret[ok])
    v = volume[ok][order]
    assert got.vol_battle_ret == pytest.approx((np.cumsum(v) - np.cumsum(v[::-1])).sum())


def test_pairwise_mean_correlation(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((12, 5))
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(i), f"s{j}", float(x[i, j])) for i in range(12) for j in range(5)]
    got = factors.pairwise_mean_corr(spark.createDataFrame(rows, "t int, date date, symbol string, v double"), "v", 6, 3, 3).toPandas()
    c = np.abs(np.corrcoef(x[6:12].T))
    last = got[got.date == got.date.max()].set_index("symbol").value
    assert len(got) == 7 * 5 and last["s2"] == pytest.approx((c[2].sum() - 1) / 4)


def test_all_factors_are_in_a_group():
    assert len(factors.FACTORS) == 46 and len(factors.GROUPS) == 11


def test_correlation_dedup_keeps_comparing_a_dropped_factor():
    corr = {("a", "b"): 0.9, ("a", "c"): 0.8, ("b", "c"): 0.1}
    assert research.correlation_dedup(["a", "b", "c"], {"a": 0.1, "b": 0.5, "c": 0.05}, corr) == ["b"]
    assert research.correlation_dedup(["a", "b", "c"], {"a": 0.9, "b": 0.5, "c": 0.4}, corr) == ["a"]


def test_orthogonalize_forms_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(dt.date(2024, 1, 1), f"s{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.standard_normal((30, 2)))]
    df = spark.createDataFrame(rows, "date date, symbol string, y double, x double")
    a = research.orthogonalize(df, "y", ["x"]).orderBy("symbol").toPandas().value
    b = research.orthogonalize_one(df, "y", "x").orderBy("symbol").toPandas().value
    assert np.allclose(a, b)


def test_hht_phase_is_that_of_a_transform(spark):
    rng = np.random.default_rng(1)
    c = 100 + rng.standard_normal(120).cumsum()
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(i), float(x)) for i, x in enumerate(c)], "symbol string, date date, close double")
    got = signals.hht(df).orderBy("date").toPandas()
    d = pd.Series(c).rolling(60).mean().diff().to_numpy()[-30:]
    spectrum = np.fft.fft(d)
    spectrum[1:15] *= 2
    spectrum[16:] = 0
    z = np.fft.ifft(spectrum)[-1]
    assert got.phase.iloc[-1] == pytest.approx(math.atan2(z.imag, z.real)) and got.signal.iloc[-1] == ("BUY" if abs(got.phase.iloc[-1]) <= math.pi / 2 else "FLAT")
    assert got.phase.iloc[:89].isna().all()


@given(st.lists(st.tuples(st.integers(-9, 9).filter(bool), st.integers(1, 20)), min_size=1, max_size=25))
@settings(max_examples=15, deadline=None)
def test_fifo_equals_a_queue(spark, trades):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), i, q, float(p)) for i, (q, p) in enumerate(trades)], "symbol string, date date, order_id int, quantity long, price double")
    queue, truth = [], []
    for q, p in trades:
        if q > 0:
            queue.append([p, q])
        need = -q
        while need > 0 and queue:
            took = min(need, queue[0][1])
            truth.append((took, (p - queue[0][0]) * took))
            need -= took
            queue[0][1] -= took
            if not queue[0][1]:
                queue.pop(0)
    got = [(r.quantity, r.pnl) for r in backtest.fifo_matches(df).orderBy("sell_id", "buy_id").collect()]
    assert got == truth


def test_equity_and_metrics(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 7)]
    prices = [10.0, 12.0, 9.0, 11.0, 8.0, 13.0]
    bars = spark.createDataFrame([("a", d, p) for d, p in zip(days, prices)], "symbol string, date date, close double")
    orders = spark.createDataFrame([("o", "a", days[0], 10), ("late", "a", days[-1], 5)], "order_id string, symbol string, date date, quantity int")
    filled = backtest.fills(orders, bars)
    assert [(r.date, r.price) for r in filled.collect()] == [(days[1], 12.0)]
    curve = backtest.equity_curve(filled, bars, 1000.0)
    total = [r.total for r in curve.orderBy("date").collect()]
    assert total == [1000.0, 1000.0, 970.0, 990.0, 960.0, 1010.0]
    m = backtest.metrics(curve, 1000.0).first()
    r = pd.Series(total).pct_change().dropna()
    assert m.sharpe_ratio == pytest.approx(252**0.5 * r.mean() / r.std()) and m.max_dd_duration == 3 and m.max_drawdown == pytest.approx(-0.04)
    run = backtest.simulate(bars, lambda p: {"a": 1.0}, "day", 1000.0).orderBy("date").toPandas()
    assert run.total.tolist()[:3] == [1000.0, 1000.0, 1000.0 - 100 * 3]


GOLDEN = [
    ("912796UQ", 0.164271, 99.598333, 0, 0.995983, 0.024501, 0), ("912796RW", 0.517454, 98.709812, 0, 0.987098, 0.025096, 0),
    ("912796RT", 1.013005, 97.41, 0, 0.9741, 0.025904, 0), ("9128285S", 2.009582, 99.957031, 4.839555, 0.939432, 0.031091, -0.016955),
    ("9128285U", 5.007529, 100.328125, 12.010156, 0.871738, 0.027412, 0.138007), ("9128285M", 9.883641, 103.839952, 26.071926, 0.765716, 0.027009, -0.044326),
    ("912810SE", 29.883641, 107.28371, 68.464865, 0.381746, 0.032225, -2.790878),
]


def test_bootstrap_of_the_sample(spark):
    items = rates.cashflows(rates.instruments(rates.sample_quotes(spark)))
    assert {r.cusip: r.n for r in items.select("cusip", F.size("flows").alias("n")).collect()} == dict(zip([g[0] for g in GOLDEN], [1, 1, 1, 5, 11, 20, 60]))
    report = rates.bootstrap(items)
    for r, g in zip(report.orderBy("step").collect(), GOLDEN):
        assert r.cusip == g[0] and r.status == "ok"
        assert (r.maturity_t, r.price, r.pv_known, r.df_solved, r.zero_cc, r.residual) == pytest.approx(g[1:], abs=1.01e-6)
    curve = rates.curves(report)
    t = spark.createDataFrame([(0.25,), (1.5,), (3.0,), (20.0,), (40.0,)], "t double").crossJoin(curve)
    assert [r.d for r in t.select(rates.discount("nodes", "t").alias("d")).collect()] == pytest.approx([0.9938192807, 0.9570018284, 0.9165059120, 0.5384714110, 0.2684540763], abs=1e-9)
    z = rates.z_spread(rates.price(items, curve)).select("cusip", "z_spread").collect()
    assert {r.cusip: round(r.z_spread * 1e4, 4) for r in z if r.cusip == "912810SE"} == {"912810SE": pytest.approx(-13.8129, abs=2e-4)}


def test_exact_bootstrap_reprices(spark):
    items = rates.cashflows(rates.instruments(rates.sample_quotes(spark)), end_of_month=True)
    assert {r.n for r in items.where("cusip in ('9128285S', '9128285U')").select(F.size("flows").alias("n")).collect()} == {4, 10}
    assert all(abs(r.residual) < 1e-8 for r in rates.bootstrap(items, exact=True).collect())


def test_bootstrap_odd_instruments(spark):
    row = lambda cusip, clean, maturity: (cusip, dt.date(2025, 1, 1), dt.date(2024, 1, 1), None, maturity, 0.0, 0, clean, 0.0)
    schema = "cusip string, val_date date, dated_date date, first_coupon date, maturity date, coupon double, freq int, clean double, accrued double"
    items = spark.createDataFrame([row("a", 98.0, dt.date(2025, 7, 1)), row("b", 97.0, dt.date(2025, 7, 1)), row("c", -100.0, dt.date(2026, 1, 1)), row("d", 99.0, dt.date(2025, 1, 1))], schema)
    got = {r.cusip: r for r in rates.bootstrap(rates.cashflows(items)).collect()}
    assert got["a"].df_solved == pytest.approx(0.98) and got["b"].warn == "duplicate_maturity" and (got["c"].status, got["c"].warn) == ("fail", "df_nonpositive") and "d" not in got


def test_note_yields_reprice_without_lambdas(spark):
    rows = spark.createDataFrame([(p, c, n) for p in (60.0, 100.0, 130.0) for c in (0.0, 0.025, 0.05) for n in (1, 7, 30)], "price double, coupon double, years int")
    out = rows.withColumn("y", rates.note_yield(F.col("price"), F.col("coupon"), F.col("years")))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()  # a lambda costs microseconds a round and coupon
    for r in out.collect():
        n = r.years * 2
        assert sum(r.coupon * 50 / (1 + r.y / 2) ** k for k in range(1, n + 1)) + 100 / (1 + r.y / 2) ** n == pytest.approx(r.price, abs=1e-6)


def test_live_signal_reads_its_rows_once(spark):
    rows = spark.createDataFrame([(i, f"s{j}", float(j % 5), float((i + j) % 7), 0.01 * (j % 5) + 0.02 * ((i + j) % 7)) for i in range(9) for j in range(25)], "date int, symbol string, a double, b double, fwd double")
    past, latest = rows.where("date < 8"), rows.where("date = 8")
    out = ml.live_signal(past, latest, ["a", "b"], trees=2)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.symbol: r for r in out.collect()}
    alone = ml.models(["a", "b"], past.count())["ridge"].fit(past).transform(latest).collect()
    assert len(got) == 25 and all(got[r.symbol].ridge == pytest.approx(r.prediction) and got[r.symbol].equal_weight == (r.a + r.b) / 2 for r in alone)
    assert all(r.ensemble == (r.ridge + r.forest) / 2 for r in got.values())


def test_black_scholes_and_back(spark):
    rows = [("call", 100.0, 90.0, 0.5, 0.3), ("put", 100.0, 120.0, 1.0, 0.2), ("call", 100.0, 100.0, 0.1, 0.5)]
    df = spark.createDataFrame(rows, "type string, spot double, strike double, years double, iv double")
    df = df.withColumn("price", options.black_scholes("type", "spot", "strike", "years", 0.045, 0.013, "iv"))
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    for r in df.withColumn("back", options.implied_volatility(tolerance=1e-10)("type", "price", "spot", "strike", "years")).collect():
        d1 = (math.log(r.spot / r.strike) + (0.045 - 0.013 + r.iv**2 / 2) * r.years) / (r.iv * r.years**0.5)
        d2 = d1 - r.iv * r.years**0.5
        s, x = r.spot * math.exp(-0.013 * r.years), r.strike * math.exp(-0.045 * r.years)
        assert r.price == pytest.approx(s * phi(d1) - x * phi(d2) if r.type == "call" else x * phi(-d2) - s * phi(-d1), abs=1e-10) and r.back == pytest.approx(r.iv, abs=1e-6)


def test_risk_limits_hold_at_the_limit(spark):
    rows = spark.createDataFrame([(4030.05, 2.0), (4030.06, 2.0), (4278.5, 2.0), (4100.0, 0.77)], "spot double, combo_mid double")
    rows = rows.selectExpr("timestamp'2024-01-02 10:00:00' ts", "spot", "4010.0D short_put", "4300.0D short_call", "0.0D put_delta", "0.0D call_delta", "1.1D credit", "combo_mid", "40 dte")
    got = {r.spot: r.action for r in options.risk_actions(rows, take_profit=0.3).collect()}
    assert got == {4030.05: "CLOSE_PROXIMITY", 4030.06: "HOLD", 4278.5: "CLOSE_PROXIMITY", 4100.0: "TAKE_PROFIT"}


def test_round_trips_equal_a_queue(spark):
    rng = np.random.default_rng(5)
    log, opens, truth = [], {}, []
    for i in range(120):
        action, expiry, price, qty = ("open", "close")[int(rng.integers(0, 2))], "xyz"[int(rng.integers(0, 3))], float(rng.integers(1, 9)), int(rng.integers(1, 4))
        log += [(i, "ORDER", i, action, expiry, "r", None, None, None), (1000 + i, "FILL", i, None, None, None, price, qty, 1.0)]
        if action == "open":
            opens.setdefault(expiry, []).append((price, qty))
        elif opens.get(expiry):
            p, q = opens[expiry].pop(0)
            truth.append((expiry, (p - price) * 100 * min(q, qty) - 2.0))
    df = spark.createDataFrame(log, "seq long, event string, order_id long, action string, expiry string, reason string, fill_price double, qty long, commission double")
    got = options.round_trips(df)
    assert sorted((r.expiry, r.net_pnl) for r in got.collect()) == sorted(truth)
    assert options.trade_summary(got).first().net_pnl == pytest.approx(sum(p for _, p in truth))


def weeks(spark, n, k=1, seed=7):
    rng = np.random.default_rng(seed)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(7 * i), f"s{j:02}", *map(float, x), float(2 * x[0] + 0.01 * e)) for i in range(n) for j, (*x, e) in enumerate(rng.standard_normal((25, k + 1)))]
    return spark.createDataFrame(rows, "date date, symbol string, " + ", ".join(f"f{i} double" for i in range(k)) + ", fwd double")


@pytest.mark.parametrize("model, least", [("ridge", 0.99), ("forest", 0.8), ("boosting", 0.9), ("svr", 0.99), ("pca_ridge", 0.99)])
def test_walk_forward_uses_only_the_past(spark, model, least):
    df = weeks(spark, 12, 2)
    got = ml.walk_forward(df, ["f0", "f1"], model, purge=1).toPandas()
    assert sorted(got.date.unique()) == [dt.date(2024, 1, 1) + dt.timedelta(7 * i) for i in range(9, 12)] and len(got) == 75
    assert np.corrcoef(got.value, got.fwd)[0, 1] > least
    # what comes later changes nothing
    from pyspark.sql import functions as F

    changed = df.withColumn("fwd", F.when(F.col("date") >= "2024-03-11", -F.col("fwd")).otherwise(F.col("fwd")))
    again = ml.walk_forward(changed, ["f0", "f1"], model, purge=1).toPandas()
    both = got.merge(again, on=["date", "symbol"])
    assert np.allclose(both.value_x, both.value_y) and (both.fwd_x != both.fwd_y).any()


def test_ridge_equals_normal_equations(spark):
    df = weeks(spark, 11, 3)
    pdf = df.toPandas().sort_values(["date", "symbol"])
    names = ["f0", "f1", "f2"]
    got = ml.walk_forward(df, names, "ridge").toPandas().set_index(["date", "symbol"]).value
    for day in sorted(pdf.date.unique())[8:]:
        train, test = pdf[pdf.date < day], pdf[pdf.date == day]
        mean, spread = train[names].mean(), train[names].std(ddof=0)
        z = ((train[names] - mean) / spread).to_numpy()
        b = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (train.fwd - train.fwd.mean()))
        for r in test.itertuples():
            assert got[day, r.symbol] == pytest.approx(train.fwd.mean() + ((np.array([r.f0, r.f1, r.f2]) - mean) / spread).to_numpy() @ b)


def test_spearman_of_columns_with_gaps():
    rng = np.random.default_rng(0)
    x = np.round(rng.standard_normal((20, 9)), 1)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 8] = 1.0
    total = np.ones(9)
    total[8] = 0
    for i in range(9):
        for j in range(9):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = pd.Series(x[ok, i]).rank(), pd.Series(x[ok, j]).rank()
            if i != j and a.std() > 0 and b.std() > 0:
                total[i] += abs(np.corrcoef(a, b)[0, 1])
    assert np.allclose(factors.mean_abs_spearman(x, block=4), (total - 1) / 8)


def test_regression_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    n = 60
    rows = [(dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 10) + dt.timedelta(minutes=i), s, i, n, 100 + float(rng.standard_normal()), float(rng.integers(1, 1000))) for s in "ab" for i in range(n)]
    grid = spark.createDataFrame(rows, "date date, ts timestamp, symbol string, i int, n_day int, close double, volume double")
    got = {r.symbol: r for r in factors.regression_daily(grid).collect()}
    for s in "ab":
        close, volume = (np.array([r[k] for r in rows if r[2] == s]) for k in (5, 6))
        y, v = close[1:] / close[:-1] - 1, np.diff(volume)
        x = np.column_stack([np.ones(len(y) - 5), *(v[5 - k : len(v) - k] for k in range(6))])
        b, rss, *_ = np.linalg.lstsq(x, y[5:], rcond=None)
        t = b / np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (len(x) - 7))
        assert (got[s].t0, got[s].mist) == pytest.approx((t[0], t[2:].std(ddof=1)))


def test_feed(spark):
    rows = [(dt.datetime(2024, 1, 2, 10, m), s, float(m)) for m in (3, 1, 2) for s in ("b", "a", "c")]
    feed, seen = bar_sources.HistoricFeed(spark.createDataFrame(rows, "ts timestamp, symbol string, close double")), []
    feed.subscribe(["a", "b"], seen.append)
    while feed.has_next():
        feed.next()
    assert [[(r.symbol, r.close) for r in x] for x in seen] == [[("a", m), ("b", m)] for m in (1.0, 2.0, 3.0)]
    with pytest.raises(StopIteration):
        feed.next()
    feed.reset()
    assert feed.next()[0].close == 1.0


def test_files_of_symbols_and_chains(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for s in ("AAA", "BBB"):
        pq.write_table(pa.table({"fiscal_year": [2024], "end_date": ["2024-03-31"]} | ({"assets": [1.0]} if s == "AAA" else {})), tmp_path / f"{s}_fundamentals.parquet")
    got = sorted((r.symbol, str(r.end_date), r.assets) for r in tables.read_statements(spark, str(tmp_path)).collect())
    assert got == [("AAA", "2024-03-31", 1.0), ("BBB", "2024-03-31", None)] and tables.read_statements(spark, str(tmp_path), ["bbb"]).count() == 1
    for kind in ("calls", "puts"):
        (tmp_path / f"spx_2024-06-21_{kind}.csv").write_text("strike,as_of\n100,2024-05-22\n")
    chain = tables.read_chains(spark, str(tmp_path)).collect()
    assert {(r.symbol, r.type, r.strike) for r in chain} == {("SPX", "call", 100), ("SPX", "put", 100)} and chain[0].years == pytest.approx(30 / 365)
    table = spark.range(100)
    assert sorted(tables.sample(table, 7).collect()) == sorted(tables.sample(table.repartition(5), 7).collect()) and tables.sample(table, 7, 1).collect() != tables.sample(table, 7).collect()


def test_sessions_are_local_whatever_the_zone(spark):
    times = [(dt.datetime(2024, 1, 3, 14, 35), 1), (dt.datetime(2024, 7, 3, 13, 35), 1), (dt.datetime(2024, 7, 3, 13, 34), 0), (dt.datetime(2024, 1, 3, 20, 58), 0)]
    from pyspark.sql import functions as F

    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            rows = spark.createDataFrame([(int(t.replace(tzinfo=dt.timezone.utc).timestamp()), k) for t, k in times], "s long, ok int").withColumn("ts", F.timestamp_seconds("s"))
            assert sorted(r.ok for r in bar_sources.session_only(rows).collect()) == [1, 1]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_strategies_are_compared(spark):
    days = [(dt.date(2023, 1, 1) + dt.timedelta(i), s, *[100 * (1 + k / 1000) ** i] * 4, 1.0) for i in range(300) for k, s in ((1, "up"), (-1, "down"))]
    df = spark.createDataFrame(days, "date date, symbol string, open double, high double, low double, close double, volume double")
    got = {(r.strategy, r.symbol): r for r in backtest.compare(df, cost_rate=0.0).collect()}
    assert len(got) == 10 and got["buy_and_hold", "up"].total_return == pytest.approx(1.001**298 - 1) and got["sma_cross", "down"].total_return == 0
    assert got["buy_and_hold", "up"].fills == 1 and got["buy_and_hold", "down"].max_drawdown == pytest.approx(0.999**298 - 1)


def test_legacy_log(spark):
    log = spark.createDataFrame([(1, "OPEN", None, None, "e", None, None, None, None, None), (2, "CLOSE", None, None, "e", None, None, None, None, 50.0), (3, "CLOSE", None, None, "e", None, None, None, None, -20.0)],
                                "seq long, event string, order_id long, action string, expiry string, reason string, fill_price double, qty long, commission double, pnl double")
    one = options.trade_summary(options.all_trips(log)).first()
    assert (one.total_trades, one.net_pnl, one.win_rate, one.max_drawdown) == (2, 30.0, 0.5, 20.0)


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-02", " x ", "1.5"), ("bad", "", "-99")], "d string, s string, n string")
    got = tables.normalize_types(rows, dates=["d"], strings=["s"], numbers=["n"], sentinels=[-99]).collect()
    assert [(str(r.d), r.s, r.n) for r in got] == [("2024-01-02", "x", 1.5), ("None", None, None)]
    tables.save_table(rows, str(tmp_path / "t.csv"))
    assert tables.load_table(spark, str(tmp_path / "t.csv")).count() == 2
    with pytest.raises(ValueError):
        tables.load_table(spark, "x.txt")
    assert [(r.symbol, r.quantity) for r in tables.parse_positions(spark, "AAPL:100, nvda:50,").collect()] == [("AAPL", 100), ("NVDA", 50)]
