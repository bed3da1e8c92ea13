"""The FM-index and the whole operator against brute force, and odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tollbridge.llm import passages
from tollbridge.llm.fm_index import FmIndex


def plain(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def test_index_equals_counting():
    rng = random.Random(1)
    for _ in range(150):
        window, letters = rng.choice([1, 2, 3, 5]), rng.choice([1, 2, 3, 10, 50])
        texts = [np.array([rng.randrange(letters) for _ in range(rng.randrange(1, 14))], np.uint64) for _ in range(rng.randrange(1, 12))]
        weights = [rng.choice([1, 1, 2]) for _ in texts]
        seen = Counter()
        for text, weight in zip(texts, weights):
            for i in range(len(text) - window + 1):
                seen[tuple(text[i : i + window])] += weight
        index = FmIndex(texts, weights)
        found = index.repeated(window)
        for text, first in zip(texts, index.first):
            wanted = [i + window <= len(text) and seen[tuple(text[i : i + window])] > 1 for i in range(len(text))]
            assert found[first : first + len(text)].tolist() == wanted and not found[first + len(text)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(10, 300))] for _ in range(30)]
    rows = []
    for i in range(150):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            own[rng.randrange(len(own))] = "é%d" % rng.randrange(1000)
        if rng.random() < 0.4:
            other = rng.choice(base)
            own[5:5] = other[: rng.randrange(20, 80)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(own)))
    rows += [(500, "again " * 300), (501, "a b c " * 40 + "end"), (None, None), (502, ""), (503, " \n"), (None, rows[0][1])]
    rows += [(504, "\x1f".join(f"u{i}\x85" for i in range(80))), (505, " ".join(f"long{i}" for i in range(30_000))), (506, "x" * 100_000)]
    return rows + [rows[7]] * 3


def test_equals_plain(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS k1", "2 AS first", "3 AS spans").repartition(5)
    for how in ({}, {"hot_anchor": 3}, {"shard_words": 500}, {"window": 6}, {"window": 6, "run": 2, "hot_anchor": 1, "shard_words": 1}):
        got = [tuple(r) for r in passages.dedup_passages(df, **how).collect()]
        assert sorted(got, key=str) == plain(rows, how.get("window", passages.WINDOW))


def test_without_broadcast(spark, rows, setting):
    setting("spark.tollbridge.broadcast.maxRows", 0)
    setting("spark.sql.autoBroadcastJoinThreshold", -1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in passages.dedup_passages(df).collect()), key=str) == plain(rows, passages.WINDOW)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert passages.dedup_passages(df).count() == 0
    assert passages.dedup_passages(spark.createDataFrame([(1, None)], df.schema)).count() == 1
