"""Line dedup against plain Python, streamed and decided from counts, and odd rows."""

import random

from tollbridge.llm import lines


def expected(docs, min_chars, min_docs):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    order = lambda d: (d is not None, d or 0)
    held = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if len(held.get(key(x), ())) < min_docs or doc == max(held[key(x)], key=order)]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    out = lines.dedup_lines(df, **more).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    return sorted(map(tuple, out), key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    pool = ["alpha line", "  ALPHA line\t", "beta line", "é long line", "É long line", "", "  ", "ab", "gamma line\r"]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(0, 6)))) for i in range(n)]
    docs += [(3, "alpha line\nown"), (3, "alpha line\nown"), (None, "alpha line\nbeta line"), (None, None), (70, None), (71, "")]
    return docs + [(72, "\n".join(["beta line", "only here"] * 200))]


def test_streamed_and_decided_alike(spark):
    for seed in (1, 2):
        docs = texts(seed)
        wanted = expected(docs, 4, 5)
        for limit in (1, 8, 1000):
            assert rows(spark, docs, min_chars=4, min_docs=5, stream_docs=limit) == wanted


def test_repeated_rows_are_one_document(spark):
    docs = [(1, "a line of some length")] * 9 + [(2, "a line of some length")] * 3
    for limit in (1, 1000):
        assert rows(spark, docs, min_chars=4, min_docs=3, stream_docs=limit) == expected(docs, 4, 3)
        assert rows(spark, docs, min_chars=4, min_docs=2, stream_docs=limit) == expected(docs, 4, 2)


def test_own_columns_stay(spark):
    long = "x" * 45
    df = spark.createDataFrame([(i, f"{long}\n{i}" if i else None, 9, 1, 2, 3) for i in range(7)],
                               "doc_id bigint, text string, n_chars bigint, kept int, row int, hash int")
    out = lines.drop_repeated_lines(df)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[0] == (None, 9) and got[6] == (f"{long}\n6", 9) and got[2] == ("2", 1)
    assert lines.drop_repeated_lines(df.limit(0)).count() == 0


def test_ranges_need_no_second_exchange(spark):
    df = spark.createDataFrame(texts(1), "doc_id bigint, text string").selectExpr("*", "xxhash64(text) AS _text_hash")
    plan = lines.dropped_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(hash" in plan and "hashpartitioning(hash" not in plan
