"""The corpus pipeline: quality rules, near-dedup, personal data, mixing, packing. Each stage reads what the one before wrote.

All stages find their columns without regard to case and carry others along, whatever their names; packing ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import crf, mixing, packing, pii, simhash
from tidemark.llm.shared import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose letters and digits at least half stand in lines of content.

    Null and empty texts, and those without a letter or digit, go. Repeated rows are decided alike. Without labels of both
    classes every other document stays. An empty table gives an empty table.
    """
    model = crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    labelled = crf.label_documents(docs, model)
    names = [f"c{i}" for i in range(len(labelled.columns))]
    kept = labelled.toDF(*names).where(F.col(names[-1]))
    own = [(n, c) for n, c in zip(names, labelled.columns)][: -len(crf.RESULT)]
    return kept.select(*(n for n, _ in own)).toDF(*(c for _, c in own))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the lowest doc_id, of equal ones that of the lowest hash of its text.

    Rows without a doc_id or a word stay. Rows that repeat a doc_id and its text become one. An empty table gives an empty one.
    """
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced, and their new lengths.

    Null texts stay null, with a null length; empty ones stay empty. Repeated rows stay repeated.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix takes them.

    Null sources are one source. A source without a word is left out; texts without a word go with the block they are in.
    Repeated rows stand or fall together. An empty table gives an empty table.
    """
    return mixing.mix(docs, mixing.solve(docs)).drop("epoch")


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows with their texts, each in the proportions of the mix and in its order.

    Texts without a word are in no window. Copies that the mix made are told apart by `epoch`. An empty table gives no window.
    """
    return packing.pack(docs, mixed=True)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_dedup),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("packing", windows),
]

#: Decoding, fingerprints and validators aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what the next one has read is deleted."""
    import uuid

    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                old = files.Path(f"{folder}/{i - 1}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
