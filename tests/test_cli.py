from tidemark import __main__ as cli
from tidemark.operators import rates
from tidemark.sources import tables


def test_curve_commands(spark, tmp_path):
    data = str(tmp_path / "quotes.csv")
    tables.save_table(rates.sample_quotes(spark, True).coalesce(1), data)
    for command in ("select-otr", "build-curve", "price-off-the-run"):
        cli.main([command, "--data", data, "--date", "2018-12-28", "--out", str(tmp_path / command)])
    assert spark.read.csv(str(tmp_path / "select-otr/otr"), header=True).count() == 7
    assert spark.read.csv(str(tmp_path / "build-curve/nodes"), header=True).count() == 7
    priced = spark.read.csv(str(tmp_path / "price-off-the-run/pricing"), header=True, inferSchema=True)
    assert priced.count() == 2 and priced.where("abs(difference) < 5").count() == 2


def test_weekly_pipeline(spark):
    from tidemark.plans import registry

    assert registry.QUERIES["weekly_pipeline"](spark, "/root/testdata/sf0.001").count() > 100
