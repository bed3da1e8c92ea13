"""The files against the library's ids, keyed access, and odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tollbridge.llm import token_store
from tollbridge.llm.bpe import read_file
from tollbridge.llm.queries import QUERIES

JSON = read_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_str(JSON)


def test_perfect_hash():
    rng = random.Random(1)
    for n in (1, 2, 3, 10, 1000):
        keys = [rng.randrange(-(2**62), 2**62) for _ in range(n)]
        index = token_store.PerfectHash.build(keys)
        assert sorted(map(index.slot, keys)) == list(range(n))


def test_query_equals_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op2_token_store"](spark, sf_dir).collect()}
    start = 0
    for doc_id, text in sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()):
        ids = LIBRARY.encode(text, add_special_tokens=False).ids + [0]
        assert (got[doc_id].start, got[doc_id].n_tokens) == (start, len(ids))
        assert got[doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(spark.read.parquet(f"{sf_dir}/documents.parquet").collect())


def test_lookup_and_odd_rows(spark, tmp_path):
    texts = {k: f"text number {k} " * (k % 7) for k in range(-20, 400, 3)}
    rows = [*texts.items(), (5, None), (7, ""), (None, "no key"), (None, None)] + [(1000, f"twice {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS shard")
    for size in (200, 1 << 20):
        path = str(tmp_path / f"store{size}")
        token_store.write_tokens(df, path, JSON, block_bytes=size)
        read = token_store.read_tokens(spark, path).collect()
        assert len(read) == len(rows) and sum(r.doc_id is None for r in read) == 2
        at = 0
        for r in sorted(read, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        keys = [r.doc_id for r in sorted(read, key=lambda r: r.start) if r.doc_id is not None]
        assert keys == sorted(keys)
        found = token_store.lookup(spark, path, [-20, 1, 5, 8, 1000, 2000]).collect()
        by_key = {}
        for r in found:
            by_key.setdefault(r.doc_id, []).append(LIBRARY.decode(r.ids[:-1], skip_special_tokens=False))
        assert by_key.pop(1000) and sorted(by_key) == [-20, 1, 5] and by_key[5] == [""]
        assert by_key[1] == [texts[1]] and by_key[-20] == [texts[-20]]
        assert len([r for r in found if r.doc_id == 1000]) == 30


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    token_store.write_tokens(df, str(tmp_path / "none"), JSON)
    assert token_store.read_tokens(spark, str(tmp_path / "none")).count() == 0
    assert token_store.lookup(spark, str(tmp_path / "none"), []).count() == 0
