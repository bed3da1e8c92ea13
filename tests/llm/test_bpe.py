"""Ids and decoded texts against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tollbridge.llm import bpe
from tollbridge.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.PrefixBpe(bpe.read_file(PATH))
ODD = [
    "", "<|endoftext|>", " <|endoftext|> x", "a\t <|endoftext|><|endoftext|>b  ", "x" * 5000, " " * 300, "\n" * 300, "ab" * 3000,
    "a  ", " a", "don't  we'll ' s 's", "\x1c a\x85 ​　b", "\U0001f600\U0001f600 é漢字", "a \n b\n  c \t",
]


def same(texts):
    for text, ids, wanted in zip(texts, OWN.encode(texts), LIBRARY.encode_batch(texts, add_special_tokens=False)):
        ids = [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]
        assert ids == wanted.ids, text[:200]
        assert OWN.decode(ids) == LIBRARY.decode(wanted.ids, skip_special_tokens=False)


def test_odd_texts():
    same(ODD)
    rng = random.Random(5)
    same(["".join(rng.choices("ab the  \n\t\r\x85\xa0 'sdéß漢😀12½_-.!\x1c​", k=rng.randrange(60))) for _ in range(5000)])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    same([text.encode("utf-8", "replace").decode()])


def test_small_caches_change_nothing(monkeypatch):
    own = bpe.PrefixBpe(bpe.read_file(PATH))
    own.cache.limit = 4
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 3)
    monkeypatch.setattr(bpe, "CACHED_PRETOKENS", 3)
    texts = ["the cat and the hat sat", "a hat on the mat", "the cat again and again"] * 5
    for text in texts:
        assert own.encode([text]) == OWN.encode([text])


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError)):
        bpe.PrefixBpe(bpe.read_file(public_tokenizers.path("word_bpe_49k.json")))


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op7_bpe"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = LIBRARY.encode(texts[row.doc_id], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[row.doc_id]))


def test_rows_of_any_kind(spark):
    df = spark.createDataFrame([(1, None), (None, "a b"), (1, None), (2, "")], "doc_id bigint, text string").selectExpr("*", "1 AS ids")
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in bpe.encode_texts(df, PATH).collect()), key=str)
    assert got == sorted([(1, [], ""), (1, [], ""), (2, [], ""), (None, LIBRARY.encode("a b").ids, "a b")], key=str)
    assert bpe.encode_texts(df.limit(0), PATH).count() == 0


def test_nothing_of_the_texts_stays_after_the_task(spark):
    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([sum(map(len, (b.known, b.pairs, b.cache.young, b.cache.old))) for b in bpe._loaded.values()], pa.int64())], names=["n"]
            )

    docs = spark.createDataFrame([(i, f"some words of document {i}, and numbers {i * 7919}") for i in range(40)], "doc_id bigint, text string").coalesce(1)
    assert {r.doc_id: list(r.ids) for r in bpe.encode_texts(docs, PATH).collect()} == {r.doc_id: LIBRARY.encode(r.text).ids for r in docs.collect()}
    left = [r.n for _ in range(8) for r in docs.limit(1).mapInArrow(kept, "n bigint").collect()]  # by the same workers
    assert left and not any(left)


def test_a_task_keeps_few_units(monkeypatch):
    monkeypatch.setattr(bpe, "TASK_UNITS", 50)
    texts = [f"text {i} of {i * 7919} strange{i} words" for i in range(400)]
    with bpe.loaded(bpe.read_file(PATH)) as own:
        for text in texts:
            assert list(own.cache.texts([text])[0]) == list(b"".join(i.to_bytes(4, "little") for i in LIBRARY.encode(text).ids))
            assert len(own.known) + len(own.pairs) + len(own.cache.young) + len(own.cache.old) < 4 * 50
    assert own.cache.limit > 50 and not own.known
