"""Command line: python -m tidemark COMMAND --help."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import backtest, factors, ml, options, quality, rates, research, signals, strategies as registered, trees
from tidemark.plans import weekly
from tidemark.sources import bars as bar_sources, tables
from tidemark.streaming import flows

QUOTE_DATES, QUOTE_NUMBERS = ("CALDT", "TDATDT", "TFCPDT", "TMATDT"), ("TCOUPRT", "TDNOMPRC", "TDACCINT", "TDBID", "TDASK", "TDTOTOUT")


def quotes(spark: SparkSession, args) -> DataFrame:
    raw = tables.load_table(spark, args.data, args.date)
    return tables.normalize_types(raw, dates=QUOTE_DATES, numbers=QUOTE_NUMBERS, integers=("TNIPPY", "ITYPE"), strings=("KYTREASNO", "TCUSIP"))


def select_otr(spark, args) -> None:
    chosen, rest, report = rates.split_on_the_run(quotes(spark, args), not args.no_liquidity)
    for name, table in (("otr", chosen), ("off_the_run", rest), ("report", report)):
        tables.save_table(table, f"{args.out}/{name}")


def build_curve(spark, args) -> None:
    items = rates.cashflows(rates.instruments(rates.split_on_the_run(quotes(spark, args))[0]), end_of_month=args.exact)
    report = rates.bootstrap(items, exact=args.exact).cache()
    tables.save_table(report, f"{args.out}/report")
    tables.save_table(rates.curves(report).select("val_date", F.explode("nodes").alias("n")).select("val_date", "n.t", "n.df"), f"{args.out}/nodes")


def price_off_the_run(spark, args) -> None:
    chosen, rest, _ = rates.split_on_the_run(quotes(spark, args))
    curve = rates.curves(rates.bootstrap(rates.cashflows(rates.instruments(chosen), end_of_month=args.exact), exact=args.exact))
    priced = rates.z_spread(rates.price(rates.cashflows(rates.instruments(rest), end_of_month=args.exact), curve))
    tables.save_table(priced.drop("flows", "nodes"), f"{args.out}/pricing")


def advise(spark, args) -> None:
    bars = bar_sources.BarStore(spark, args.data).load().withColumn("date", F.to_date("ts"))
    signals.recommend(signals.latest_signals(bars), tables.parse_positions(spark, args.positions)).orderBy("symbol").show(args.rows, False)


def profile(spark, args) -> None:
    bars = bar_sources.BarStore(spark, args.data).load(frequency=args.frequency).withColumn("date", F.to_date("ts"))
    quality.symbol_summary(quality.bars_per_day(bars, args.expected)).orderBy("symbol").show(args.rows, False)


def trades(spark, args) -> None:
    log = spark.read.schema("seq long, event string, order_id long, action string, expiry string, reason string, fill_price double, qty long, commission double").json(args.data)
    options.trade_summary(options.all_trips(log)).show(1, False)


def _research(spark, args) -> tuple[DataFrame, DataFrame]:
    """The dense grid of stored daily bars, and long factor rows: a table of date, symbol, factor, value, or the library's daily factors."""
    bars = bar_sources.BarStore(spark, args.data).load(start=args.start, end=args.end).withColumn("date", F.to_date("ts")).drop("ts")
    grid = bar_sources.densify(bars)
    if args.factors:
        return grid, tables.load_table(spark, args.factors).withColumn("date", F.to_date("date"))
    parts = [factors.to_long(factors.technical(grid), list(factors.GROUPS["technical"])), factors.to_long(factors.reversal(grid), list(factors.GROUPS["reversal"]))]
    if args.statements:
        parts.append(factors.to_long(factors.fundamental(grid, tables.read_statements(spark, args.statements)), list(factors.GROUPS["fundamental"])))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return grid, rows


def weekly_pipeline(spark, args) -> None:
    grid, rows = _research(spark, args)
    found = weekly.run(rows, grid, args.model, args.ic, args.corr, args.least, top=args.top)
    for name in ("summary", "predictions", "returns"):
        tables.save_table(getattr(found, name), f"{args.out}/{name}")
    research.performance(found.returns).show(1, False)


def factor_backtest(spark, args) -> None:
    grid, rows = _research(spark, args)
    held = research.rebalance(rows, grid, args.rebalance)
    names = [args.factor] if args.factor else [r.factor for r in rows.select("factor").distinct().orderBy("factor").collect()]
    for name in names:
        own = held.where(F.col("factor") == name)
        quantiles = research.quantile_returns(own, least=args.least).cache()
        tables.save_table(quantiles, f"{args.out}/{name}/quantiles")
        tables.save_table(research.rolling_ic(research.rank_ic(own, args.least)), f"{args.out}/{name}/ic")
        tables.save_table(research.performance(research.long_short(quantiles)).crossJoin(research.monotonicity(quantiles)), f"{args.out}/{name}/metrics")


def daily_predict(spark, args) -> None:
    grid, rows = _research(spark, args)
    names = [r.factor for r in rows.select("factor").distinct().orderBy("factor").collect()]
    panel = ml.daily_panel(rows, grid, research.next_day_returns(grid, 5), dict.fromkeys(names, 1.0), args.least, args.least).cache()
    predicted = ml.walk_forward(panel, names, args.model, min_periods=30, min_test=args.least, purge=5).cache()
    tables.save_table(predicted, f"{args.out}/predictions")
    tables.save_table(ml.daily_evaluation(predicted, least=args.least), f"{args.out}/evaluation")


def pick_stocks(spark, args) -> None:
    _, rows = _research(spark, args)
    bars = bar_sources.BarStore(spark, args.data).load().withColumn("date", F.to_date("ts"))
    names = [r.factor for r in rows.select("factor").distinct().collect()]
    research.pick(rows, bars, dict.fromkeys(names, 1.0), args.top, args.volume).show(args.top, False)


def compare_strategies(spark, args) -> None:
    bars = bar_sources.BarStore(spark, args.data).load(start=args.start, end=args.end).withColumn("date", F.to_date("ts"))
    backtest.compare(bars).orderBy("symbol", F.desc("total_return")).show(args.rows, False)


def strategies(spark, args) -> None:
    for name, one in registered.REGISTRY.items():
        print(f"{name}\tevery {one.poll} s\t{one.about}")


def run_strategy(spark, args) -> None:
    """All quotes there are in a folder of JSON files, once."""
    kinds = "strategy string, ts timestamp, enter boolean, quantity long, filled long, spot double, short_put double, short_call double, combo_mid double, dte int, end_of_day boolean"
    manager = registered.Manager(spark, args.out)
    manager.start(args.name, spark.readStream.schema(kinds).json(args.data), once=True).awaitTermination()
    spark.read.schema(flows.ACTION).json(f"{args.out}/actions/{args.name}").orderBy("ts").show(args.rows, False)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    runs = (
        (select_otr, ("no_liquidity",)), (build_curve, ("exact",)), (price_off_the_run, ("exact",)), (advise, ()), (profile, ()), (trades, ()), (weekly_pipeline, ()), (factor_backtest, ()),
        (daily_predict, ()), (pick_stocks, ()), (compare_strategies, ()), (strategies, ()), (run_strategy, ()),
    )
    for run, own in runs:
        p = commands.add_parser(run.__name__.replace("_", "-"))
        p.set_defaults(run=run)
        p.add_argument("--data", required=run is not strategies)
        p.add_argument("--date")
        p.add_argument("--out", default="out")
        p.add_argument("--rows", type=int, default=50)
        p.add_argument("--positions", default="")
        p.add_argument("--frequency", default="1m")
        p.add_argument("--expected", type=int, default=390)
        if run in (weekly_pipeline, factor_backtest, daily_predict, pick_stocks, compare_strategies):
            for name in ("start", "end", "factors", "statements", "factor"):
                p.add_argument(f"--{name}")
            p.add_argument("--model", default="ridge", choices=("ridge", "equal_weight", *trees.MODELS))
            p.add_argument("--rebalance", default="W", choices=tuple(research.HOLD))
            for name, kind, default in (("ic", float, 0.005), ("corr", float, 0.7), ("least", int, 20), ("top", int, 30), ("volume", float, 5e6)):
                p.add_argument(f"--{name}", type=kind, default=default)
        if run is run_strategy:
            p.add_argument("--name", required=True, choices=tuple(registered.REGISTRY))
        for flag in own:
            p.add_argument(f"--{flag.replace('_', '-')}", action="store_true")
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)


if __name__ == "__main__":
    main()
