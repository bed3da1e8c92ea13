"""Each stage against a brute-force version of its own input, and odd tables."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import best_distance
from tests.llm.test_lines import expected as plain_lines
from tests.llm.test_near_copies import plain_groups
from tests.llm.test_quality import expected as plain_counts
from tollbridge.llm.decontaminate import edit_budget, item_words

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        after = stage(spark, docs, SF_DIR)
        after.write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_columns(stages):
    assert [columns for *_, columns in stages[:-1]] == [COLUMNS] * 4
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_quality(stages):
    _, before, after, _ = stages[0]
    failed = set()
    for r in before:
        n_words, *_, repeated = plain_counts(r.text)
        if n_words < 10 or 100 * repeated > 20 * n_words:
            failed.add(r.doc_id)
    kept = {r.doc_id for r in after}
    assert not kept & failed and {tuple(r) for r in after} <= {tuple(r) for r in before}
    assert kept == {r.doc_id for r in before} - failed  # so few labels certify no cutoff


def test_lines(stages):
    _, before, after, _ = stages[1]
    wanted = {doc: text for doc, _, _, text in plain_lines([(r.doc_id, r.text) for r in before], 40, 5)}
    assert {r.doc_id: r.text for r in after} == wanted
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_copies(stages):
    _, before, after, _ = stages[2]
    least = plain_groups({r.doc_id: r.text for r in before})
    assert {tuple(r) for r in after} == {tuple(r) for r in before if least[r.doc_id] == r.doc_id}


def test_leaks(spark, stages):
    _, before, after, _ = stages[3]
    items = [item_words(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after}
    for r in before:
        if len(r.text) < 3_000:  # the plain way takes the product of both lengths
            words = item_words(r.text)
            leaks = any(best_distance(item, words) <= edit_budget(len(item)) for item in items)
            assert leaks == (r.doc_id not in kept)


def test_ids(stages):
    _, before, after, _ = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    got = {r.doc_id: r for r in after}
    assert set(got) == {r.doc_id for r in before}
    for r in before:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert (got[r.doc_id].ids, got[r.doc_id].n_tokens) == (ids, len(ids))
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_odd_tables(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (2, None, None, None, None), (None, good + " more", None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    for start, wanted in ((docs, [1, 1, None]), (docs.limit(0), [])):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
        assert [r.doc_id for r in now.orderBy(now["doc_id"].asc_nulls_last()).collect()] == wanted
