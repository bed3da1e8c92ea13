"""Fingerprints and components against brute force, in small and cut buckets, and odd rows."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tollbridge.llm import simhash
from tollbridge.llm.components import components
from tollbridge.llm.queries import QUERIES


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius):
    label = dict(zip(ids, ids))
    fps = np.array(fps, np.uint64)
    near = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.nonzero(np.bitwise_count(fps ^ fps[i]) <= radius)[0]]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return label


def test_fingerprint():
    texts = [None, "", " \n", "One", "a B c", "a b c d", "a b c d e", "É é\x0bx\x0cy z", "b " * 40_000, "A-Z words, four! of them"]
    for text in texts:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = list(texts)
    fps = {i: plain_fingerprint(texts[i]) for i in ids[:200]}
    got = {r.doc_id: r for r in QUERIES["op3_simhash"](spark, sf_dir).collect()}
    assert all(got[i].fingerprint == f"{f:016x}" for i, f in fps.items())
    label = plain_components(ids, [int(got[i].fingerprint, 16) for i in ids], 4)
    assert {i: got[i].component_id for i in ids} == label


@pytest.mark.parametrize("tile", [3, 16, 1024])
def test_links_in_tiles(spark, tile):
    rng = random.Random(tile)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    fps = set(base)
    for f in base:
        for _ in range(12):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7)))
            fps.add(f)
    fps = sorted(fps, key=lambda f: rng.random())
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    df = spark.createDataFrame(signed, "fp bigint, rep bigint")
    found = {r.a: r.b for r in components(simhash.links(df, 4, tile)).collect()}
    label = plain_components(list(range(len(fps))), fps, 4)
    assert {i: found.get(i, i) for i in range(len(fps))} == label


def test_components_of_a_chain(spark):
    chain = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.b for r in components(chain).collect()} == {0} and components(chain).count() == 299
    assert components(chain.limit(0)).count() == 0


def test_odd_rows(spark):
    rows = [(9, None), (4, ""), (7, " \n"), (None, ""), (None, "quite another text with words"), (5, "a b c d"), (5, "a b c d"), (6, "A b C d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS _gone2")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.group_near(df).collect()), key=str)
    assert got == sorted([(9, 4), (4, 4), (7, 4), (None, 4), (None, None), (5, 5), (5, 5), (6, 5)], key=str)
    kept = simhash.drop_near(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [4, 5, 5, None, None]
    assert simhash.group_near(df.limit(0)).count() == 0
