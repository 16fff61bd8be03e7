"""Files in and out, and types of raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def load_table(spark: SparkSession, path: str, date=None, date_column: str = "CALDT", schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV or Parquet table, by extension, optionally of one date. ValueError for other files or a date without rows."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        table = (reader.schema(schema) if schema else reader).csv(path)
    elif path.endswith(".parquet"):
        table = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown file type: {path}")
    if date is not None:
        table = table.where(F.to_date(F.col(date_column)) == F.to_date(F.lit(date)))
        if table.isEmpty():
            raise ValueError(f"no rows on {date}")
    return table


def save_table(table: DataFrame, path: str, kind: str = "csv") -> None:
    writer = table.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()


def normalize_types(table: DataFrame, dates=(), numbers=(), integers=(), strings=(), sentinels=(), date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Dates, numbers, nullable integers and trimmed strings; what can't be read and sentinel numbers become NULL."""
    bad = [F.lit(float(s)) for s in sentinels]

    def number(c):
        x = F.col(c).try_cast("double")
        return F.when(~x.isin(bad), x) if bad else x

    return table.withColumns(
        {c: F.to_date(F.try_to_timestamp(F.col(c).cast("string"), F.lit(date_format))) for c in dates}
        | {c: number(c) for c in numbers}
        | {c: number(c).cast("long") for c in integers}
        | {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in strings}
    )


def read_statements(spark: SparkSession, folder: str, symbols: list[str] | None = None) -> DataFrame:
    """The statements of a folder with one Parquet file a symbol: the rows with `symbol` from the name of their file.

    Files need not have the same columns. symbols: only theirs; those without a file are left out.
    """
    rows = spark.read.option("mergeSchema", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    rows = rows.withColumn("symbol", F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:_[a-z]+)?\.parquet$", 1)))
    for column in ("end_date", "filing_date"):
        if column in rows.columns:
            rows = rows.withColumn(column, F.to_date(column))
    return rows if symbols is None else rows.where(F.col("symbol").isin([s.upper() for s in symbols]))


def read_chains(spark: SparkSession, folder: str) -> DataFrame:
    """All option chains of a folder of CSV files `SYMBOL_EXPIRATION_calls.csv` or `_puts.csv` one below the other: symbol, expiration and type from the names, years to expiry from `as_of` in the rows, else NULL."""
    rows = spark.read.option("header", True).option("inferSchema", True).option("pathGlobFilter", "*.csv").csv(folder)
    name = F.col("_metadata.file_name")
    part = lambda k: F.regexp_extract(name, r"^([^_]+)_(\d{4}-\d{2}-\d{2})_(call|put)s?\.csv$", k)
    rows = rows.withColumns({"symbol": F.upper(part(1)), "expiration": F.to_date(F.nullif(part(2), F.lit(""))), "type": part(3)}).where("expiration is not null")
    as_of = F.to_date("as_of") if "as_of" in rows.columns else F.lit(None).cast("date")
    return rows.withColumn("years", F.datediff("expiration", as_of) / 365.0)


def sample(table: DataFrame, n: int, seed: int = 42, key: str | None = None) -> DataFrame:
    """n rows, always the same of the same table: those with the lowest hash of `key` and the seed, or of all columns."""
    of = [key] if key else table.columns
    place = F.xxhash64(*of, F.lit(seed))
    return table.orderBy(place, *of).limit(n)


TRADE_LOG = """type string, ts string, order_id long, strategy string, action string, expiry string, short_put double, long_put double,
short_call double, long_call double, limit_price double, qty long, reason string, fill_price double, commission double, rule string, detail string, pnl double"""


def read_trade_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRADE_LOG).json(path)


def append_trade_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def profile(table: DataFrame, by: str | None = None) -> DataFrame:
    """column_name, nulls and distinct values of every column, of each value of `by` if given. One pass over the table."""
    names = [c for c in table.columns if c != by]
    aggregates = [x for c in names for x in (F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.countDistinct(c).alias(f"{c}__distinct"))]
    one = (table.groupBy(by) if by else table.groupBy()).agg(*aggregates)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__nulls").alias("nulls"), F.col(f"{c}__distinct").alias("distinct_values")) for c in names)))
    return one.select(*([by] if by else []), pairs.alias("x")).select(*([by] if by else []), "x.*")


def parse_positions(spark: SparkSession, text: str) -> DataFrame:
    """`AAPL:100, nvda:50` as rows of symbol and quantity."""
    pairs = F.explode(F.split(F.lit(text), ","))
    return spark.range(1).select(pairs.alias("p")).where(F.trim("p") != "").select(
        F.upper(F.trim(F.element_at(F.split("p", ":"), 1))).alias("symbol"), F.trim(F.element_at(F.split("p", ":"), 2)).cast("long").alias("quantity")
    )
