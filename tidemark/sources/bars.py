"""Bar tables in long form: storage by year, the dense grid, and the panels over it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.errors import AnalysisException

BAR = T.StructType([
    T.StructField("ts", T.TimestampType()), T.StructField("symbol", T.StringType()),
    *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")), T.StructField("volume", T.LongType()),
])
FIELDS = ("open", "high", "low", "close", "volume")
SESSION_OPEN, SESSION_CLOSE = "09:35:00", "15:57:00"


class BarStore:
    """Bars as Parquet under root/frequency/year=...; a year is a partition, so date ranges prune files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _all(self, frequency: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.root}/{frequency}")
        except AnalysisException as e:
            raise FileNotFoundError(f"no {frequency} bars under {self.root}") from e

    def load(self, symbols=None, start=None, end=None, frequency: str = "1d") -> DataFrame:
        """Bars of the symbols between start and end, both included, ordered by nothing in particular."""
        bars = self._all(frequency)
        if start is not None:
            bars = bars.where((F.col("year") >= F.year(F.lit(start).cast("timestamp"))) & (F.col("ts") >= F.lit(start).cast("timestamp")))
        if end is not None:
            bars = bars.where((F.col("year") <= F.year(F.lit(end).cast("timestamp"))) & (F.col("ts") <= F.lit(end).cast("timestamp")))
        if symbols is not None:
            bars = bars.where(F.col("symbol").isin(list(symbols)))
        return bars.drop("year")

    def save(self, bars: DataFrame, frequency: str = "1d") -> None:
        """Adds bars; a new bar replaces a stored one of the same time and symbol. Only touched years are written."""
        new = bars.withColumn("year", F.year("ts")).withColumn("__seq", F.lit(1))
        years = [r.year for r in new.select("year").distinct().collect()]
        try:
            old = self._all(frequency).where(F.col("year").isin(years)).withColumn("__seq", F.lit(0))
            new = old.unionByName(new, allowMissingColumns=True)
        except FileNotFoundError:
            pass
        merged = upsert(new, ("ts", "symbol"), "__seq").drop("__seq")
        # written elsewhere first: the years that are replaced are also read. A year is as many files as its rows ask for
        staged = f"{self.root}/.staged-{uuid.uuid4().hex}"
        merged.repartitionByRange("year", "symbol").sortWithinPartitions("year", "symbol", "ts").write.partitionBy("year").option("compression", "snappy").parquet(staged)
        self.spark.read.parquet(staged).write.partitionBy("year").option("partitionOverwriteMode", "dynamic").mode("overwrite").option("compression", "snappy").parquet(f"{self.root}/{frequency}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def symbols(self, frequency: str = "1d") -> DataFrame:
        """Symbols of the latest year."""
        bars = self._all(frequency)
        last = bars.agg(F.max("year")).first()[0]
        return bars.where(F.col("year") == last).select("symbol").distinct().orderBy("symbol")

    def exists(self, frequency: str = "1d") -> bool:
        try:
            return not self._all(frequency).isEmpty()
        except FileNotFoundError:
            return False

    def latest(self, frequency: str = "1d"):
        return self._all(frequency).agg(F.max("ts")).first()[0]


def upsert(rows: DataFrame, keys: tuple[str, ...], sequence: str) -> DataFrame:
    """One row a key: the last by sequence."""
    w = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def universe(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a JSON file {"symbols": [...]}."""
    return spark.read.schema("symbols array<string>").json(path, multiLine=True).select(F.explode("symbols").alias("symbol"))


def valid_bars(bars: DataFrame) -> DataFrame:
    """Bars whose high and low bound the rest; others are left out rather than failing the job."""
    return bars.where((F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close")))


def densify(bars: DataFrame, keys: tuple[str, ...] = (), date: str = "date") -> DataFrame:
    """The grid of all dates and symbols (within keys), with t, the position of the date from 0.

    Repeated (date, symbol) rows are averaged and symbols without a close left out, as a pivot does.
    """
    fields = [c for c in FIELDS if c in bars.columns]
    cells = bars.groupBy(*keys, date, "symbol").agg(*(F.avg(c).alias(c) for c in fields))
    days = cells.select(*keys, date).distinct()
    order = Window.partitionBy(*keys).orderBy(date) if keys else Window.orderBy(date)  # one row a date
    days = days.withColumn("t", (F.row_number().over(order) - 1).cast("int"))
    names = cells.where(F.col("close").isNotNull()).select("symbol").distinct()
    grid = days.crossJoin(names)
    return grid.join(cells, [*keys, date, "symbol"], "left")


def session_only(bars: DataFrame, zone: str = "America/New_York", start: str = SESSION_OPEN, end: str = SESSION_CLOSE) -> DataFrame:
    """Bars whose local time of day is within the session, both ends included."""
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), F.col("ts").cast("timestamp_ntz"))  # whatever zone the session is in
    return bars.where(F.date_format(local, "HH:mm:ss").between(start, end))


def history(bars: DataFrame, n: int, as_of=None, order: str = "date") -> DataFrame:
    """The last n rows of each symbol, not after as_of."""
    if as_of is not None:
        bars = bars.where(F.col(order) <= F.lit(as_of))
    w = Window.partitionBy("symbol").orderBy(F.desc(order))
    return bars.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


class Feed:
    """A source of bars in order of time. Subclasses give `table`; `subscribe` limits the symbols, `next` gives a time's bars."""

    def __init__(self) -> None:
        self._symbols: set[str] | None = None
        self._calls: list[Callable[[list], None]] = []
        self.reset()

    def table(self) -> DataFrame:
        raise NotImplementedError

    def subscribe(self, symbols, call: Callable[[list], None] | None = None) -> None:
        """Adds symbols, and a function that gets the bars of every time."""
        self._symbols = (self._symbols or set()) | set(symbols)
        if call:
            self._calls.append(call)
        self.reset()

    def reset(self) -> None:
        """Back to the first bar."""
        self._rows: Iterator | None = None
        self._ahead: list = []

    def _fill(self) -> None:
        if self._rows is None:
            rows = self.table()
            if self._symbols is not None:
                rows = rows.where(F.col("symbol").isin(sorted(self._symbols)))
            self._rows = iter(replay(rows).toLocalIterator(prefetchPartitions=True))  # a partition at a time on the driver
            self._ahead = [r for r in [next(self._rows, None)] if r is not None]

    def has_next(self) -> bool:
        self._fill()
        return bool(self._ahead)

    def next(self) -> list:
        """The bars of the next time, by symbol. StopIteration after the last."""
        if not self.has_next():
            raise StopIteration
        found = self._ahead
        self._ahead = []
        for r in self._rows:
            if r.ts != found[0].ts:
                self._ahead = [r]
                break
            found.append(r)
        for call in self._calls:
            call(found)
        return found


class HistoricFeed(Feed):
    """The feed of stored bars."""

    def __init__(self, bars: DataFrame) -> None:
        self._bars = bars
        super().__init__()

    def table(self) -> DataFrame:
        return self._bars


def replay(bars: DataFrame) -> DataFrame:
    """Bars in the order of a historical feed: by time, then symbol."""
    return bars.orderBy("ts", "symbol")


def resample(bars: DataFrame, width: str) -> DataFrame:
    """Bars of a longer interval."""
    return (
        bars.groupBy("symbol", F.window("ts", width).start.alias("ts"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    )
