"""Counts against plain Python, the certified cutoffs against scipy-free binomials, and odd rows."""

import math
import re
from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tollbridge.llm import quality


def expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [
    None, "", " \n\t", "one", "a b c d e", "a a a a a a", "a b c d e f a b c d e", "x\ny\nx\n\n \ny", "é #*& ß|<>\x0b\x0cé\r\n",
    "tick " * 3000, "# [x] ^ a\\b", "a b c d", "\U0001f600 & \U0001f600",
]


def measured(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    of = df.select("doc_id", quality.counts(F.col("text")).alias("of")).orderBy("doc_id").collect()
    return [tuple(r.of[c] for c in quality.COUNTS) for r in of]


def test_counts(spark):
    assert measured(spark, TEXTS) == [expected(t) for t in TEXTS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#|!", max_size=80), min_size=30, max_size=30))
def test_counts_of_any_text(spark, texts):
    assert measured(spark, texts) == [expected(t) for t in texts]


def test_binomial_tail(spark):
    cases = [(n, k, p) for n in (1, 5, 40, 2000) for k in (0, 1, 3) for p in (0.01, 0.3) if k <= n]
    for p in (0.01, 0.3):
        own = [(n, k) for n, k, q in cases if q == p]
        df = spark.createDataFrame(own, "n bigint, k bigint")
        got = df.select(quality.binomial_tail(F.col("n"), F.col("k"), p)).collect()
        for (n, k), (value,) in zip(own, got):
            exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
            assert math.isclose(value, exact, rel_tol=1e-9) if k < n * p else value == 1.0


GOOD = "the quick brown fox jumps over lazy dogs while clever cats watch birds gliding past tall {} trees"
BAD = "the# quick* brown$ fox% jumps& over lazy# dogs* while clever$ cats% watch& birds {} gliding# past*"


def corpus(spark, n=700):
    docs = [(i, GOOD.format(i), "en") for i in range(n)] + [(n + i, BAD.format(i), "en") for i in range(40)]
    docs += [(5000, "few words", "en"), (5001, None, None), (None, GOOD.format("x"), None), (5002, BAD.format("y"), "zz")]
    labels = [(i, 1) for i in range(n)] + [(n + i, 0) for i in range(20)] + [(None, 1), (3, None), (9999, 1)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int"),
    )


def test_bad_go_good_stay(spark):
    docs, labels = corpus(spark)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert set(range(700)) <= kept and not kept & set(range(700, 740))
    assert None in kept and 5002 in kept  # strata without labels lose nothing to the rules
    assert not kept & {5000, 5001}


def test_too_few_labels_certify_nothing(spark):
    docs, labels = corpus(spark)
    few = labels.where("doc_id < 50 OR doc_id >= 700")
    kept = {r.doc_id for r in quality.keep_good(docs, few).collect()}
    assert set(range(740)) <= kept


def test_labels_that_suffice(spark):
    """86 good labels without a false rejection certify each of four strata; 85 certify none."""
    docs, labels = corpus(spark, 86)
    four = docs.where("lang = 'en'").drop("lang").crossJoin(spark.createDataFrame([(k, f"l{k}") for k in range(4)], "k bigint, lang string"))
    four = four.selectExpr("10000 * k + doc_id AS doc_id", "text", "lang")
    own = labels.where("doc_id < 106").crossJoin(spark.range(4)).selectExpr("10000 * id + doc_id AS doc_id", "quality")
    kept = [r.doc_id for r in quality.keep_good(four, own).collect()]
    assert sorted(kept) == [10000 * k + i for k in range(4) for i in range(86)]
    assert quality.keep_good(four, own.where("doc_id % 10000 > 0")).count() == 4 * (86 + 40)


def test_false_rejections_are_limited(spark):
    """A rule that rejects a tenth of the good documents isn't certified at a risk of 5 %."""
    docs, labels = corpus(spark)
    noisy = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.lit(BAD)).otherwise(F.col("text")))
    lost = noisy.where("doc_id < 700").count() - quality.keep_good(noisy, labels).where("doc_id < 700").count()
    assert lost == 0


def test_empty_and_extra_columns(spark):
    docs, labels = corpus(spark)
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == 742
    wide = docs.selectExpr("*", "1 AS kept", "2 AS of", "3 AS row", "4 AS failed", "5 AS n_words", "6 AS `a.b`")
    out = quality.keep_good(wide.union(wide), labels)
    assert out.columns == wide.columns and out.count() == 2 * quality.keep_good(docs, labels).count()
