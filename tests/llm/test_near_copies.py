"""Groups of near copies against brute force over all pairs, and odd rows."""

import itertools
import random

import numpy as np

import corpus_pipeline
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tollbridge.llm import near_copies, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """doc_id -> least doc_id, for one text a document."""
    sets, label = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}
    alike = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in alike:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def changed(words, rng, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return words


def test_groups_of_changed_texts(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    texts, at = {}, 0
    for size in (3, 5, 6, 9, 30, 120, 230, 400):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for n in (0, 0, *range(1, min(size, 14))):
            texts[at] = " ".join(changed(base, rng, n))
            at += 1
    rng.shuffle(order := list(texts))
    df = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id bigint, text string").repartition(5)
    wanted = plain_groups(texts)
    assert {r.doc_id: r.least for r in near_copies.group_copies(df).collect()} == {i: w for i, w in wanted.items() if w != i}
    # of the linked ones, the fingerprints at four bits miss some
    near = plain_components(order, [plain_fingerprint(texts[i]) for i in order], 4)
    assert {i for i in texts if near[i] == i} - {i for i in texts if wanted[i] == i}


def test_stage_of_the_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = plain_groups({r.doc_id: r.text for r in docs.collect()})
    kept = [r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, sf_dir).collect()]
    assert sorted(kept) == sorted(i for i, w in wanted.items() if w == i)


def test_odd_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(9, None), (4, ""), (7, " \n"), (None, ""), (None, a), (5, a), (5, a), (6, a.upper() + " end"), (3, b), (8, b), (8, a), (10, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS h", "2 AS least")
    kept = near_copies.drop_copies(df)
    assert kept.columns == df.columns  # 8 links 3 and 5
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [10, 3, 4, None, None]
    assert near_copies.drop_copies(df.limit(0)).count() == 0


def test_many_copies_make_few_pairs(spark, monkeypatch):
    """Pairs in proportion to the documents, not to their square; groups as of all pairs, in one round or more."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3_000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = {i: " ".join(changed(base, rng, rng.choice([0, 1, 1, 2, 3]))) for i in range(600)}
    texts |= {1_000 + i: " ".join(changed(base, rng, 4 + i)) for i in range(4)}  # hardly alike: these meet all that they may be alike to
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    counted = []
    pairs = near_copies._pairs

    def counting(*given):
        counted.append(pairs(*given).count())
        return pairs(*given)

    monkeypatch.setattr(near_copies, "_pairs", counting)
    wanted = {i: w for i, w in plain_groups(texts).items() if w != i}
    assert {r.doc_id: r.least for r in near_copies.group_copies(df).collect()} == wanted
    assert sum(counted) < 12 * len(texts)
    monkeypatch.setattr(near_copies, "PIVOT_ROUNDS", 0)
    assert {r.doc_id: r.least for r in near_copies.group_copies(df).collect()} == wanted
    assert counted[-1] > 100 * len(texts)


def test_fingerprints_link_first(spark, monkeypatch):
    """The stage links by SimHash fingerprints of five words; what they have linked meets no pivot any more."""
    rng = random.Random(11)
    texts = {}
    for g in range(20):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(300)]
        texts |= {20 * k + g: " ".join(changed(base, rng, min(k, 1))) for k in range(4)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    asked, met = [], []
    links, pairs = simhash.links, near_copies._pairs
    monkeypatch.setattr(simhash, "links", lambda distinct, radius: asked.append((radius, distinct.count())) or links(distinct, radius))
    monkeypatch.setattr(near_copies, "_pairs", lambda *given: met.append(pairs(*given).count()) or pairs(*given))
    near = {(r.a, r.b) for r in simhash.near_links(df, near_copies.WIDTH, near_copies.RADIUS).collect()}
    wanted = {i for i, w in plain_groups(texts).items() if w == i}
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, df, "").collect()} == wanted == set(range(20))
    assert asked[0] == asked[1] == (near_copies.RADIUS, len({simhash.fingerprint(t.encode(), 5) for t in texts.values()}))
    assert len(near) > 30 and all(a % 20 == b % 20 for a, b in near)
    assert sum(met) < 60 - 30  # without fingerprints each of the 60 copies meets a pivot


def test_wrong_links_do_not_count(spark):
    texts = {i: " ".join(f"t{i}w{k}" for k in range(50)) for i in range(4)} | {4: " ".join([*(f"t0w{k}" for k in range(50)), "more"])}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    near = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 3), (0, 4), (2, 2)], "a bigint, b bigint")
    for links in (near, near.limit(0), None):
        assert [tuple(r) for r in near_copies.group_copies(df, near=links).collect()] == [(4, 0)]


def test_counts_never_hide_a_pair():
    rng = np.random.default_rng(3)
    for size in (0, 1, 3, 4, 60, 900, 20_000):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
        for n in (0, 1, size // 9, size):
            y = np.unique(np.concatenate([x[n:], rng.integers(-(2**63), 2**63 - 1, n)]))
            differ = len(np.setxor1d(x, y))
            assert near_copies._differ(near_copies._counts(x), near_copies._counts(y)) <= differ
    assert near_copies._differ(near_copies._counts(x), near_copies._counts(y)) > len(x) / 4  # unlike ones are told apart
