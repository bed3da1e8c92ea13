"""Held-out accuracy, vectors against plain counting, rejection, and odd rows."""

import zlib

import numpy as np

from tollbridge.llm import language
from tollbridge.llm.queries import QUERIES


def test_counts_cover_whole_texts(monkeypatch):
    text = "Ébène 12 and, the word! " * 50
    whole = language.counts(text)
    monkeypatch.setattr(language, "_CHUNK", 64)
    assert (language.counts(text) == whole).all()
    words = " " + " ".join(text.lower().replace("12", " ").replace(",", " ").replace("!", " ").split()) + " "
    size = len(words.encode())
    assert whole.sum() == size + (size - 1) + (size - 2)


def test_clusters():
    rng = np.random.default_rng(1)
    base = np.eye(4, 30)
    points = np.repeat(base, 20, axis=0) + 0.02 * rng.random((80, 30))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centres, reach = language.cluster(points.astype(np.float32))
    assert sorted(centres.argmax(axis=1)) == [0, 1, 2, 3] and (reach > 0.9).all()
    centres, reach = language.cluster(np.repeat(points[:1], 5, axis=0).astype(np.float32))
    assert len(centres) == 1


def test_query_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op4_language"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in out) >= 0.98 * len(out)


def corpus(spark):
    rows = [(i, "the cat and the dog were in the house again " * (1 + i % 3), "en") for i in range(60)]
    rows += [(100 + i, "der hund und die katze waren wieder im haus " * (1 + i % 3), "de") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_rejection_and_odd_rows(spark):
    docs = corpus(spark)
    model = language.fit(docs)
    asked = [(1, "the dog and the cat were in the house"), (2, "die katze und der hund"), (3, None), (4, ""), (5, "12 ?!"), (None, "THE DOG"), (6, "中文字" * 30), (7, "the " * 100_000)]
    df = spark.createDataFrame(asked, "doc_id bigint, text string").selectExpr("*", "1 AS score", "2 AS lang_pred")
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, None, 7)] == ["en", "de", "en", "en"]
    assert [(got[i].lang_pred, got[i].score) for i in (3, 4, 5)] == [("und", 0.0)] * 3
    assert got[6].rejected and got[6].lang_pred in ("en", "de")
    assert language.predict(df.limit(0), model).count() == 0


def test_nothing_learned(spark):
    docs = corpus(spark)
    for none in (docs.limit(0), docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"), docs.selectExpr("doc_id", "'12' AS text", "lang")):
        assert {r.lang_pred for r in language.predict(docs, language.fit(none)).collect()} == {"und"}


def test_labels_of_held_out_documents_teach_nothing(spark):
    docs = corpus(spark)
    wrong = docs.selectExpr("doc_id", "text", "lang").withColumn("lang", language.F.when(language.held_out(docs["doc_id"]), "xx").otherwise(docs["lang"]))
    assert "xx" not in language.fit(wrong)["langs"]
