"""The pipeline's stages on null, empty, repeated, very long and clashing rows, and on empty tables."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, removed_spans string, pii_key string, sketch string, kept int"
LABELS = "doc_id long, quality int, toxic int"


def some_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    texts = [prose(30) for _ in range(24)] + [f"{prose(12)} nitwit {prose(12)}" for _ in range(16)]
    rows = [(i, t) for i, t in enumerate(texts)]
    long = prose(120_000)
    rows += [(100, None), (100, None), (101, ""), (None, None), (None, "loose end"), (None, "loose end"), (102, long), (103, " \n\t "), (104, texts[0]), (0, texts[0]), (105, "mail a@b.example now"), (106, "x" * 200_000)]
    return [(i, t, None if i is None else "en", "s", 7, 0.5, "clash", "key", "sk", 1) for i, t in rows]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(some_rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(24 <= i < 40)) for i in range(40)] + [(None, None, 1), (3, None, None), (100, 0, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def read(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet")


def keys(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())


def test_every_stage_keeps_odd_rows(spark, tables):
    d = read(spark, tables)
    odd = F.col("doc_id").isNull() | (F.col("doc_id") >= 100)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, d, tables)
        assert out.columns == d.columns and dict(out.dtypes) == dict(d.dtypes), name
        rows = out.collect()
        assert {r["removed_spans"] for r in rows} == {"clash"} and {r["score"] for r in rows} == {0.5} and {r["pii_key"] for r in rows} == {"key"}, name
        kept = out.where(odd)
        if name == "ngram_jaccard_join":  # copies and repeated rows of an id go, rows without an id stay
            assert [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [None, None, None, 100, 101, 102, 103, 105, 106]
        else:
            assert kept.count() == 11 and kept.where("text is null").count() == 3, name
        assert kept.where("doc_id = 106").first()["text"] == "x" * 200_000 and len(kept.where("doc_id = 102").first()["text"]) > 800_000, name
        if name == "toxicity":
            assert {r["doc_id"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 24} == set(range(24))
        if name == "pii":
            assert kept.where("doc_id = 105").first()["text"] == "mail [EMAIL] now" and kept.where("doc_id = 105").first()["n_chars"] == len("mail [EMAIL] now")


def test_packing_of_odd_rows(spark, tables):
    pieces = pipeline.pack_sequences(spark, read(spark, tables), tables).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in pieces if r["start"] == 0)
    assert ids == sorted((r[0] is None, r[0] or 0) for r in some_rows())
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    assert {r["doc_tokens"] for r in pieces if r["doc_id"] == 100} == {1}


def test_stages_and_run_on_empty_tables(spark, tables, tmp_path):
    empty = str(tmp_path)
    read(spark, tables).limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{empty}/labels.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, read(spark, empty), empty).count() == 0, name
    assert pipeline.run(spark, empty).count() == 0


def test_run_on_odd_rows(spark, tables):
    pieces = pipeline.run(spark, tables).collect()
    found = [r["doc_id"] for r in pieces if r["start"] == 0]
    assert set(range(1, 24)) | {0, 100, 101, 102, 103, 105, 106, None} == set(found) and found.count(None) == 3 and found.count(100) == 1
