"""The trie against plain Python at several band heights, and odd rows."""

import hashlib
import random
import zlib

import pytest

from tollbridge.llm import prefix_trie


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0, key), (role, text)))
    turns = {c: [t for _, t in sorted(own[c])] for c in own}
    members, ends = {}, {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt = turns.get(c - c % 20, [])[:h] + turns[c][h:]
        for d in range(len(rebuilt) + 1):
            members.setdefault(tuple(rebuilt[:d]), []).append(c)
        ends.setdefault(tuple(rebuilt), []).append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].split()) for x in below if x)
        children = sum(len(x) == len(node) + 1 for x in below)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), children, len(leaves), saved, digest))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def got(df, **how):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **how).select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 65), 100, 101, 139, 400, 405]:
        for t in range(rng.randrange(1, 8)):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d e f"])))
    rows += [(200, t, "user", f"word {t}") for t in range(40)] + [(201, t, "user", f"word {t}") for t in range(30)]
    rows += [(None, 1, "user", "nobody")] + [rows[3]] * 3
    rng.shuffle(rows)
    return rows


def test_equals_plain(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS depth", "3 AS key", "4 AS base")
    wanted = plain_trie(rows)
    for band in (1, 5, 64):
        assert got(df.repartition(3), band=band) == wanted


def test_conversation_over_several_ranges(spark, setting):
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(20, t, "user", f"t {t % 7}") for t in range(300)] + [(21, t, "user", f"t {t % 7}") for t in range(250)] + [(22, 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == plain_trie(rows)


def test_many_members_in_order(spark):
    prefix_trie_blob = prefix_trie.BLOB_BYTES
    rows = [(20 * i, 0, "user", "the same") for i in range(5_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    ids = ",".join(str(20 * i) for i in range(5_000))
    assert prefix_trie_blob > 0
    assert (0, 1, 0, 5_000, 0, 1, 4_999 * 2, hashlib.sha256(ids.encode()).hexdigest()) in got(df)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert got(df) == []
    assert got(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
