"""The folder that all executors share, and tables of any column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, as in tests on one machine, a temporary one is set."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, with no lineage before that."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that every worker can map into memory."""
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError("memory-mapped files need a shared folder that is mounted as a file system")
    return f"{url.path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def plain(table: DataFrame, needed: Iterable[str], replaced: Iterable[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """The table with its columns called c0, c1, ..., so that none can clash or needs quotes; the true names of these;
    and the new names of the needed ones. Columns named like one of `replaced` are left out.

    A needed column is found by its exact name, else without regard to case. ValueError if there is none.
    """
    gone = {r.lower() for r in replaced}
    names = table.columns
    at = []
    for want in needed:
        found = [i for i, n in enumerate(names) if n == want] or [i for i, n in enumerate(names) if n.lower() == want.lower()]
        if not found:
            raise ValueError(f"no column {want} among {names}")
        at.append(found[0])
    renamed = table.toDF(*(f"c{i}" for i in range(len(names))))
    kept = [i for i, n in enumerate(names) if n.lower() not in gone or i in at]
    return renamed.select(*(f"c{i}" for i in kept)), [names[i] for i in kept], [f"c{i}" for i in at]


def fields(table: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns, under these names."""
    renamed, _, own = plain(table, needed)
    return renamed.select(*(F.col(c).alias(n) for c, n in zip(own, needed)))


def integer_id(column: str | Column) -> Column:
    """An id as a whole number; what can't be read as one is NULL, as is a missing id."""
    return (F.col(column) if isinstance(column, str) else column).try_cast("long")


def small_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A local table of which the planner knows the size, so that it broadcasts it only below its threshold."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema))
