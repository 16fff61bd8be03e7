"""Treasury instruments, curve bootstrapping and pricing.

Instruments: cusip, val_date, itype (bill, note, bond), dated_date, first_coupon, maturity, coupon (decimal), freq, clean, accrued.
A curve is an array of structs (t, df) sorted by t, one a valuation date; discount factors are log-linear between nodes and
go on along the first and last segment outside.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FACE = 100.0
BUCKETS = (("3M", 0.12, 0.35), ("6M", 0.35, 0.75), ("1Y", 0.75, 1.25), ("2Y", 1.6, 2.4), ("5Y", 4.25, 5.75), ("10Y", 9.0, 11.0), ("30Y", 25.0, 35.0))


def year_fraction(start, end, basis: float = 365.25) -> Column:
    """Days over 360, 365 or 365.25."""
    return F.datediff(end, start) / F.lit(basis)


def split_on_the_run(quotes: DataFrame, use_liquidity: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """On-the-run securities by maturity bucket, all others, and a report. Bucket edges are shared, so one may be chosen twice.

    Within a bucket: the latest dated, then the narrowest spread, then (with use_liquidity) the largest amount outstanding, then the id.
    """
    spark = quotes.sparkSession
    buckets = F.broadcast(spark.createDataFrame(list(BUCKETS), "bucket string, lo double, hi double"))  # seven rows
    rows = quotes.withColumns({"ttm": year_fraction("CALDT", "TMATDT"), "spread": F.col("TDASK") - F.col("TDBID")})
    inside = rows.join(buckets, F.col("ttm").between(F.col("lo"), F.col("hi")))
    order = [F.desc_nulls_last("TDATDT"), F.asc_nulls_last("spread"), *([F.desc_nulls_last("TDTOTOUT")] if use_liquidity else []), F.col("KYTREASNO").cast("long")]
    chosen = inside.withColumn("__n", F.row_number().over(Window.partitionBy("CALDT", "bucket").orderBy(*order))).where("__n = 1").drop("__n", "lo", "hi")
    rest = quotes.join(chosen.select("CALDT", "KYTREASNO"), ["CALDT", "KYTREASNO"], "left_anti")
    report = chosen.select("CALDT", "bucket", F.col("KYTREASNO").alias("selected_id"), "ttm", "spread", F.col("TDBID").alias("bid"), F.col("TDASK").alias("ask"), F.col("TDTOTOUT").alias("liquidity"))
    return chosen, rest, report


def instruments(quotes: DataFrame) -> DataFrame:
    """Quotes as instruments: type 4 or no coupon a bill, 2 a note, 1 a bond; percent coupons become decimals."""
    freq, coupon = F.coalesce("TNIPPY", F.lit(0)), F.coalesce("TCOUPRT", F.lit(0.0))
    bill = (F.col("ITYPE") == 4) | (freq == 0) | (coupon == 0)
    return quotes.select(
        F.col("TCUSIP").alias("cusip"), F.col("CALDT").alias("val_date"), F.when(bill, "bill").when(F.col("ITYPE") == 2, "note").otherwise("bond").alias("itype"),
        F.col("TDATDT").alias("dated_date"), F.col("TFCPDT").alias("first_coupon"), F.col("TMATDT").alias("maturity"), F.when(bill, 0.0).otherwise(coupon / 100).alias("coupon"),
        F.when(bill, 0).otherwise(F.greatest(freq, F.lit(2))).alias("freq"), F.col("TDNOMPRC").alias("clean"), F.coalesce("TDACCINT", F.lit(0.0)).alias("accrued"),
    )


def cashflows(items: DataFrame, end_of_month: bool = False) -> DataFrame:
    """Adds `flows`, an array of (pay_date, amount) strictly after val_date.

    Coupons step from the first coupon, or back from maturity without one, each step from the date before it. A schedule
    that drifts off the month's end gets a coupon just before maturity; with end_of_month, steps are taken from the
    first date and month ends stay month ends.
    """
    months = F.when(F.col("freq") > 0, F.round(F.lit(12) / F.nullif("freq", F.lit(0)))).cast("int")
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.months_between("maturity", "__from") / months) + 1, F.lit(1)).cast("int"))
    if end_of_month:
        step = lambda start, k, sign: F.when(start == F.last_day(start), F.last_day(F.add_months(start, (sign * k * months).cast("int")))).otherwise(F.add_months(start, (sign * k * months).cast("int")))
        forward = F.concat(F.array("first_coupon"), F.transform(steps, lambda k: step(F.col("first_coupon"), k, 1)))
        back = F.concat(F.array("maturity"), F.transform(steps, lambda k: step(F.col("maturity"), k, -1)))
    else:
        forward = F.aggregate(steps, F.array("first_coupon"), lambda a, _: F.concat(a, F.array(F.add_months(F.element_at(a, -1), months))))
        back = F.aggregate(steps, F.array("maturity"), lambda a, _: F.concat(a, F.array(F.add_months(F.element_at(a, -1), -months))))
    forward = F.filter(forward, lambda d: d < F.col("maturity"))
    back = F.filter(back, lambda d: (d > F.col("dated_date")) & (d < F.col("maturity")))
    dates = F.when(F.col("freq") == 0, F.array("maturity")).otherwise(F.concat(F.array_sort(F.when(F.col("first_coupon").isNotNull(), forward).otherwise(back)), F.array("maturity")))
    coupon = F.when(F.col("freq") > 0, F.lit(FACE) * F.col("coupon") / F.nullif("freq", F.lit(0))).otherwise(0.0)
    flow = lambda d: F.struct(d.alias("pay_date"), (coupon + F.when(d >= F.col("maturity"), FACE).otherwise(0.0)).alias("amount"))
    rows = items.withColumn("__from", F.coalesce("first_coupon", "dated_date"))
    return rows.withColumn("flows", F.filter(F.transform(dates, flow), lambda f: f["pay_date"] > F.col("val_date"))).drop("__from")


def discount(nodes, t) -> Column:
    """Discount factor at t: 1 at or before 0, log-linear between nodes, the outer segments going on; one node means a flat rate."""
    nodes, t = (F.col(x) if isinstance(x, str) else x for x in (nodes, t))
    i = F.greatest(F.least(F.size(F.filter(nodes, lambda n: n["t"] <= t)), F.size(nodes) - 1), F.lit(1))
    a, b = F.element_at(nodes, i), F.element_at(nodes, F.least(i + 1, F.size(nodes)))
    slope = (F.log(b["df"]) - F.log(a["df"])) / F.nullif(b["t"] - a["t"], F.lit(0.0))
    line = F.when(F.size(nodes) == 1, F.log(a["df"]) * t / F.nullif(a["t"], F.lit(0.0))).otherwise(F.log(a["df"]) + slope * (t - a["t"]))
    return F.when(t <= 0, 1.0).otherwise(F.exp(line))


def zero_rate(nodes, t, simple: bool = False) -> Column:
    df, t = discount(nodes, t), F.col(t) if isinstance(t, str) else t
    safe = F.nullif(t, F.lit(0.0))
    return F.when(t <= 0, 0.0).otherwise((1 / df - 1) / safe if simple else -F.log(df) / safe)


def _log_df(ts: list[float], logs: list[float], t):
    if len(ts) == 1:
        return logs[0] * np.asarray(t) / ts[0]
    i = np.clip(np.searchsorted(ts, t, "right") - 1, 0, len(ts) - 2)
    x, y = np.asarray(ts), np.asarray(logs)
    return y[i] + (y[i + 1] - y[i]) / (x[i + 1] - x[i]) * (np.asarray(t) - x[i])


REPORT = """val_date date, step int, cusip string, maturity_t double, maturity date, price double, pv_known double, cf_maturity double,
df_solved double, zero_cc double, residual double, status string, warn string"""


def bootstrap(items: DataFrame, basis: float = 365.25, exact: bool = False, tolerance: float = 1e-10) -> DataFrame:
    """Report of the curve of each valuation date: instruments by maturity, each giving the discount factor of its last flow.

    Flows before it are discounted on the nodes so far: none yet means they count nothing, flows beyond the last node follow its
    segment. exact=True instead solves each factor so that the instrument reprices on the curve with it.
    Of equal maturities (10 digits) the first by cusip is used, others are `dropped`. Dates are independent tasks.
    """

    def one(key, pdf):
        items, out = [], []
        for r in pdf.sort_values("cusip").itertuples():
            flows = [((f["pay_date"] - r.val_date).days / basis, f["amount"]) for f in r.flows]
            if flows:
                items.append((max(t for t, _ in flows), r, flows))
        seen, ts, logs, before, step = set(), [], [], None, 0
        for end, r, flows in sorted(items, key=lambda x: (x[0], x[1].cusip)):
            price = r.clean + r.accrued
            row = [key[0], None, r.cusip, end, r.maturity, price, None, None, None, None, None, "dropped", "duplicate_maturity"]
            if round(end, 10) in seen:
                out.append(row)
                continue
            seen.add(round(end, 10))
            step += 1
            last = sum(a for t, a in flows if t == end)
            early = [(t, a) for t, a in flows if t != end]
            t, a = np.array([x for x, _ in early]), np.array([x for _, x in early])
            if exact:
                lo, hi = -20.0, 1.0
                for _ in range(200):
                    mid = (lo + hi) / 2
                    value = last * np.exp(mid) + (a * np.exp(_log_df([*ts, end], [*logs, mid], t))).sum()
                    lo, hi = (mid, hi) if value < price else (lo, mid)
                known = float(price - last * np.exp(mid))
                solved = float(np.exp(mid)) if price > 0 else float("nan")
            else:
                known = float((a * np.exp(_log_df(ts, logs, t))).sum()) if ts and len(t) else 0.0
                solved = (price - known) / last if last else float("nan")
            status, warn = "ok", ""
            if not np.isfinite(solved):
                status, warn = "fail", "df_nonfinite"
            elif solved <= 0:
                status, warn = "fail", "df_nonpositive"
            elif before is not None and solved > before + tolerance:
                status, warn = "warn", "df_increasing"
            elif solved > 1.05:
                status, warn = "warn", "df_high"
            row[1], row[6:9], row[11:] = step, (known, last, solved if np.isfinite(solved) else None), (status, warn)
            if status != "fail":
                ts.append(end)
                logs.append(float(np.log(solved)))
                before = solved
                all_t, all_a = np.array([x for x, _ in flows]), np.array([x for _, x in flows])
                row[9], row[10] = -logs[-1] / end, float((all_a * np.exp(_log_df(ts, logs, all_t))).sum() - price)
            out.append(row)
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in REPORT.replace("\n", " ").split(", ")])
        frame["step"] = frame["step"].astype("Int32")
        return frame

    return items.select("val_date", "cusip", "maturity", "clean", "accrued", "flows").groupBy("val_date").applyInPandas(one, REPORT)


def curves(report: DataFrame) -> DataFrame:
    """val_date and nodes of the factors that were solved."""
    good = report.where("status in ('ok', 'warn')")
    return good.groupBy("val_date").agg(F.array_sort(F.collect_list(F.struct(F.col("maturity_t").alias("t"), F.col("df_solved").alias("df")))).alias("nodes"))


def price(items: DataFrame, curve: DataFrame, basis: float = 365.25) -> DataFrame:
    """Dirty and clean price on the curve of the same date, market price and difference. Instruments without flows are left out."""
    rows = items.join(curve, "val_date").where(F.size("flows") > 0)
    t = lambda f: F.datediff(f["pay_date"], F.col("val_date")) / F.lit(basis)
    rows = rows.withColumn("dirty", F.aggregate("flows", F.lit(0.0), lambda s, f: s + f["amount"] * discount("nodes", t(f))))
    return rows.withColumns({"clean_price": F.col("dirty") - F.col("accrued"), "market": F.col("clean") + F.col("accrued")}).withColumn("difference", F.col("dirty") - F.col("market"))


def z_spread(priced: DataFrame, target="market", bound: float = 0.05, rounds: int = 60, basis: float = 365.25) -> DataFrame:
    """Adds z_spread, the continuous spread over the curve that gives the target price, within +-bound, by bisection; NULL where it isn't."""
    t = lambda f: F.datediff(f["pay_date"], F.col("val_date")) / F.lit(basis)
    parts = F.transform("flows", lambda f: F.struct(t(f).alias("t"), (f["amount"] * discount("nodes", t(f))).alias("pv")))
    rows = priced.withColumn("__parts", parts)
    value = lambda s: F.aggregate("__parts", F.lit(0.0), lambda a, p: a + p["pv"] * F.exp(-s * p["t"]))
    goal = F.col(target)

    def halve(x, _):
        mid = (x["lo"] + x["hi"]) / 2
        high = value(mid) > goal
        return F.struct(F.when(high, mid).otherwise(x["lo"]).alias("lo"), F.when(high, x["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(-bound).alias("lo"), F.lit(bound).alias("hi")), halve, lambda x: (x["lo"] + x["hi"]) / 2)
    inside = (value(F.lit(-bound)) >= goal) & (value(F.lit(bound)) <= goal)
    return rows.withColumn("z_spread", F.when(inside, found)).drop("__parts")


def forward_rate(nodes, t1, t2) -> Column:
    """Continuous rate between two times."""
    a, b = (F.lit(x) if not isinstance(x, Column) else x for x in (t1, t2))
    return (F.log(discount(nodes, a)) - F.log(discount(nodes, b))) / F.nullif(b - a, F.lit(0.0))


def shifted(curve: DataFrame, shift: float) -> DataFrame:
    """The curve with all continuous zero rates moved in parallel."""
    return curve.withColumn("nodes", F.transform("nodes", lambda n: F.struct(n["t"].alias("t"), (n["df"] * F.exp(-F.lit(shift) * n["t"])).alias("df"))))


def duration(items: DataFrame, curve: DataFrame, step: float = 1e-4) -> DataFrame:
    """cusip, dirty price and effective duration: central difference of prices on shifted curves."""
    up, down, base = (price(items, shifted(curve, s)).select("val_date", "cusip", F.col("dirty").alias(n)) for s, n in ((step, "up"), (-step, "down"), (0.0, "dirty")))
    rows = base.join(up, ["val_date", "cusip"]).join(down, ["val_date", "cusip"])
    return rows.select("val_date", "cusip", "dirty", ((F.col("down") - F.col("up")) / (2 * step) / F.nullif("dirty", F.lit(0.0))).alias("duration"))


def spline_curve(curve: DataFrame, times: list[float]) -> DataFrame:
    """val_date, t and df on the natural cubic spline of log discount factors through (0, 1) and the nodes."""

    def one(key, pdf):
        nodes = sorted((n["t"], n["df"]) for n in pdf["nodes"].iloc[0])
        x = np.array([0.0, *(t for t, _ in nodes if t > 0)])
        y = np.array([0.0, *(np.log(d) for t, d in nodes if t > 0)])
        h, n = np.diff(x), len(x)
        a, rhs = np.eye(n), np.zeros(n)
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            rhs[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
        m = np.linalg.solve(a, rhs)
        t = np.array(times)
        i = np.clip(np.searchsorted(x, t, "right") - 1, 0, n - 2)
        u, v = x[i + 1] - t, t - x[i]
        s = (m[i] * u**3 + m[i + 1] * v**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * u + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * v
        return pd.DataFrame({"val_date": key[0], "t": t, "df": np.exp(s)})

    return curve.groupBy("val_date").applyInPandas(one, "val_date date, t double, df double")


def nelson_siegel_svensson(t, b0: float, b1: float, b2: float, b3: float, tau1: float, tau2: float) -> Column:
    """Continuous zero rate of the four-factor form."""
    t = F.col(t) if isinstance(t, str) else t
    x1, x2 = t / tau1, t / tau2
    load = lambda x: (1 - F.exp(-x)) / F.nullif(x, F.lit(0.0))
    return b0 + b1 * load(x1) + b2 * (load(x1) - F.exp(-x1)) + b3 * (load(x2) - F.exp(-x2))


def bill_price(discount_rate, days) -> Column:
    """Price per 100 of a bill quoted at a bank discount over 360 days."""
    return FACE * (1 - discount_rate * days / 360)


def note_yield(price_, coupon, years, freq: int = 2, rounds: int = 60) -> Column:
    """Yield of a note with whole periods to run, by bisection between -50 % and 200 %, on Arrow batches.

    Coupons are summed in closed form, and a round keeps no more than the lower end: widths are the same for all rows.
    """

    @F.pandas_udf("double")
    def solve(price: pd.Series, rate: pd.Series, periods: pd.Series) -> pd.Series:
        target, payment, n = price.to_numpy(float), rate.to_numpy(float) * FACE / freq, periods.to_numpy(float)
        low = np.full(len(n), -0.5)
        with np.errstate(all="ignore"):
            for i in range(1, rounds + 1):
                x = (low + 2.5 / 2**i) / freq
                growth = np.expm1(-n * np.log1p(x))  # (1 + x) ** -n - 1, precise near 0
                coupons = np.where(n < 1, payment / (1 + x), np.where(x == 0, n * payment, -growth * payment / x))
                low = np.where(coupons + FACE * (1 + growth) > target, low + 2.5 / 2**i, low)
        return pd.Series(low + 2.5 / 2 ** (rounds + 1))

    return solve(price_, coupon, (years * freq).cast("int"))


FIXTURE = [
    ("207288", "912796UQ", "2019-01-02", None, "2019-02-26", 0.0, 0, 4, 99.598333333334, 0.0, 99.5975, 99.599166666667, None),
    ("207292", "912796RW", "2019-01-03", None, "2019-07-05", 0.0, 0, 4, 98.7098125, 0.0, 98.705875, 98.71375, None),
    ("207293", "912796RT", "2019-01-03", None, "2020-01-02", 0.0, 0, 4, 97.41, 0.0, 97.404861111111, 97.415138888889, None),
    ("207294", "9128285S", "2018-12-31", "2019-06-30", "2020-12-31", 2.5, 2, 2, 99.95703125, 0.0, 99.9375, 99.9765625, None),
    ("207296", "9128285U", "2018-12-31", "2019-06-30", "2023-12-31", 2.625, 2, 2, 100.328125, 0.0, 100.3046875, 100.3515625, None),
    ("207269", "9128285M", "2018-11-15", "2019-05-15", "2028-11-15", 3.125, 2, 2, 103.46875, 0.37120165745856, 103.4375, 103.5, 32507.0),
    ("207270", "912810SE", "2018-11-15", "2019-05-15", "2048-11-15", 3.375, 2, 1, 106.8828125, 0.40089779005525, 106.8515625, 106.9140625, 22874.0),
]


def sample_quotes(spark: SparkSession, extra: bool = False) -> DataFrame:
    """Seven Treasury quotes of 2018-12-28, with `extra` two off-the-run notes besides."""
    rows = list(FIXTURE)
    if extra:
        rows += [("206001", "9128280A", "2016-12-31", "2017-06-30", "2023-12-31", 2.25, 2, 2, 98.5, 0.0, 98.45, 98.55, 30000.0), ("206002", "9128281B", "2015-11-15", "2016-05-15", "2025-11-15", 2.25, 2, 2, 97.8, 0.26, 97.75, 97.85, None)]
    schema = "KYTREASNO string, TCUSIP string, a string, b string, c string, TCOUPRT double, TNIPPY int, ITYPE int, TDNOMPRC double, TDACCINT double, TDBID double, TDASK double, TDTOTOUT double"
    df = spark.createDataFrame(rows, schema)
    return df.select("KYTREASNO", "TCUSIP", F.lit("2018-12-28").cast("date").alias("CALDT"), F.col("a").cast("date").alias("TDATDT"), F.col("b").cast("date").alias("TFCPDT"), F.col("c").cast("date").alias("TMATDT"), *df.columns[5:])
