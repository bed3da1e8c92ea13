"""Pigeonhole matching against full dynamic programming, and odd rows."""

import random

from hypothesis import given, settings, strategies as st

from tollbridge.llm import decontaminate as d


def best_distance(pattern, text):
    """The least edit distance of the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=70), st.lists(st.sampled_from("abcd"), max_size=90))
def test_bit_parallel_distance(pattern, text):
    distance, end = d.Pattern(pattern).best(text)
    assert distance == best_distance(pattern, text)
    assert distance == min(len(pattern), best_distance(pattern, text[:end]))


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice("vwxyz") * 3
        elif kind == 1:
            words.insert(at, "ins")
        elif len(words) > 1:
            del words[at]
    return words


def test_no_item_is_lost():
    rng = random.Random(3)
    vocabulary = [a + b for a in "bcdfg" for b in "aeiou"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(60)]
    items += [(100, ""), (101, None), (102, "One."), (103, items[5][1].upper() + "!")]
    matcher = d.Matcher(items)
    for _ in range(60):
        own = rng.choice(items[:60])
        words = own[1].split()
        text = rng.choices(vocabulary, k=30) + edited(words, rng.randrange(0, d.edit_budget(len(words)) + 2), rng) + rng.choices(vocabulary, k=30)
        found = {item: distance for item, distance, *_ in matcher.find(", ".join(text).capitalize())}
        for item, other in items:
            wanted = d.item_words(other)
            least = best_distance(wanted, text) if wanted else 99
            assert found.get(item) == (least if wanted and least <= d.edit_budget(len(wanted)) else None)


def test_places():
    found = d.Matcher([(7, "the quick brown fox jumps over dogs")]).find("So: the QUICK brown cat jumps; over dogs, he said")
    assert found == [(7, 1, 1, 8)]


def test_rows_and_passes(spark):
    docs = spark.createDataFrame(
        [(1, "x one two three four five y"), (1, "x one two three four five y"), (2, None), (3, ""), (None, "one two three four five"), (4, "one two"), (5, "w " * 50_000 + "one two three four six")],
        "doc_id bigint, text string",
    ).selectExpr("*", "1 AS item_id", "2 AS distance", "3 AS _leaked2")
    items = spark.createDataFrame([(10, "One two three, four five."), (11, None), (12, ""), (13, "one two three four five"), (14, "absent words here")], "item_id bigint, text string")
    wanted = sorted([(k, i, n, p) for i in (10, 13) for k, n, p in ((1, 0, 1), (1, 0, 1), (None, 0, 0), (5, 1, 50_000))], key=str)
    for size in (1, 2, 100):
        got = d.find_items(docs, items, items_per_pass=size).collect()
        assert sorted([(r.doc_id, r.item_id, r.distance, r.first_word) for r in got], key=str) == wanted
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 4, None]
    assert d.drop_contaminated(docs, items.limit(0)).count() == 7 and d.drop_contaminated(docs.limit(0), items).count() == 0
