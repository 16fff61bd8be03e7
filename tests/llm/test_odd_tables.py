"""Every operator and pipeline stage on tables with odd names, odd ids, nulls everywhere, repeats and no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, crf, kneser_ney, mixing, neighbours, packing, pii, queries, secrets, simhash, urls

TEXT = "The first line says a thing of note.\nCall +1 (743) 555-3824 or write to ann@mail.example.com today, it says.\n"
DOCS = [
    ("1", TEXT, "a"), ("1", TEXT, "a"), ("2", TEXT, None), ("x7", TEXT, ""), (None, None, None), (None, "", "b"), ("3", "???", "b"), (None, "alone without an id", "b"),
    ("4", "word " * 30_000, "c"), ("99999999999999999999", "ghp_" + "a1B2" * 9, "a"),
]
EXTRA = ["a.b", "epoch", "__row", "__source", "n", "keep", "score", "hash", "block", "c0", "TEXT2", "a b", "`q`", "id", "key", "window_id", "own"]


def named(spark, rows, kinds):
    """rows with their columns in other cases and between columns of names that could clash, filled with nulls and words."""
    names = [k.split()[0] for k in kinds]
    table = spark.createDataFrame(rows, ", ".join(kinds))
    table = table.toDF(*(n.upper() if i % 2 else n for i, n in enumerate(names)))
    extra = [F.lit("kept" if i % 2 else None).cast("string").alias(n) for i, n in enumerate(EXTRA)]
    return table.select(*extra[:5], *table.columns, *extra[5:])


@pytest.fixture(scope="module")
def docs(spark):
    return named(spark, DOCS, ["doc_id string", "text string", "source string"]).cache()


def both(spark, docs):
    return [docs, docs.limit(0)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([("1", 1), ("3", 0), (None, 1), ("4", 7)], "doc_id string, quality int")


def test_scoring_and_searches(spark, docs):
    model = kneser_ney.train(docs, parts=3)
    assert kneser_ney.score(docs, model).count() == len(DOCS) and kneser_ney.score(docs.limit(0), model).count() == 0
    model.delete()
    assert {r.kind for r in pii.find(docs).collect()} == {"phone", "email"} and pii.find(docs.limit(0)).count() == 0
    assert [(r.doc_id, r.rule) for r in secrets.scan_secrets(docs).collect()] == [(None, "github_token")]


def test_kept_columns(spark, docs, labels):
    for table in both(spark, docs):
        redacted = pii.redact(table)
        assert redacted.columns == table.columns and redacted.count() == table.count()
        assert redacted.where(F.col("TEXT2").isNotNull() & F.col("`a.b`").isNotNull()).count() == 0
        labelled = crf.label_documents(table, crf.fit(table, labels))
        assert labelled.columns == [*(c for c in table.columns if c != "keep"), *crf.RESULT] and labelled.count() == table.count()
        kept = simhash.deduplicate(table)
        assert kept.columns == table.columns and kept.count() == (8 if table is docs else 0)
        solved = mixing.solve(table, 0.9, 1e9)
        mixed = mixing.mix(table, solved, places=True)
        assert mixed.columns == [*(c for c in table.columns if c != "epoch"), *mixing.PLACES]
        assert mixed.where("__source != 'kept'").count() == 0 and (mixed.count() > 0) == (table is docs)
        for is_mixed in (False, True):
            windows = packing.pack(table, window=100, mixed=is_mixed).collect()
            assert sum(w.n_tokens for w in windows) == (sum(len((t or "").split()) for _, t, _ in DOCS) if table is docs else 0)


def test_other_tables(spark):
    pages = named(spark, [("1", "http://ads.example.com/a"), ("2", None), ("2", " "), (None, "x" * 50_000)], ["page_id string", "url string"])
    for table in both(spark, pages):
        model = urls.train(urls.blocklist_labels(table, ("ads",)), table)
        scored = urls.score(table, model)
        assert scored.columns == [*(c for c in table.columns if c != "score"), "score", "spam"] and scored.count() == table.count()
    talk = named(spark, [("1", None, "ann", "hi"), ("1", 1, None, None), ("1", 1, None, None), (None, 2, " ", "")], ["conv_id string", "turn long", "role string", "text string"])
    assert chat.rotate_perspectives(talk).count() == 3 and chat.rotate_perspectives(talk.limit(0)).count() == 0
    vectors = named(spark, [("1", [0.0, 1.0]), ("1", [0.0, 1.0]), ("2", [0.0, 3.0]), ("x", [0.0, 0.0]), (None, [1.0, 1.0]), ("3", [None, 1.0]), ("4", None)], ["vec_id string", "embedding array<double>"])
    assert sorted(map(tuple, neighbours.nearest(vectors).collect())) == [(1, 2, 1, 2.0), (2, 1, 1, 2.0)] and neighbours.nearest(vectors.limit(0)).count() == 0


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    """The tables of a scale directory without a row."""
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "embeddings", "pages", "labels", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_queries_on_empty_tables(spark, empty_dir):
    for name, query in queries.QUERIES.items():
        assert query(spark, empty_dir).count() == 0, name
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path, docs, labels):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    table, counts = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        table = stage(spark, table, str(tmp_path))
        table.write.parquet(f"{tmp_path}/{i}")
        table = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(table.count())
        if i < 4:
            assert not {"doc_id", "TEXT", "source", "a.b", "__row"} - set(table.columns)
    assert 0 < counts[1] < counts[0] < len(DOCS) and counts[2] == counts[1] and counts[4] > 0
    assert table.where("exists(segments, s -> s.text like '%ann@mail%')").count() == 0
