"""The whole operator against plain Python, and odd rows."""

import hashlib
import random
import re

from tollbridge.llm import fill_middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    whole = hashlib.sha256(text.encode()).hexdigest()
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, whole, whole)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc_id, n, form, len(p), len(m), hashlib.sha256(out.encode()).hexdigest(), whole)


def test_units():
    rng = random.Random(3)
    for text in ("", "a", " ", "ab1c", "[`{@Zz", *("".join(rng.choices("aZ @[`{1é\n😀ßK", k=40)) for _ in range(200))):
        at = [0, *fill_middle.unit_ends(text).tolist()]
        assert [text[i:j] for i, j in zip(at, at[1:])] == UNIT.findall(text)


def test_equals_plain(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices(["word ", "é", "1", "<", "S", ">", "P>", "\n", "Long", "<M"], k=rng.randrange(60)))) for i in range(300)]
    rows += [(None, "no id at all"), (None, None), (5, rows[5][1]), (7, "another text"), (1000, ""), (1001, "x" * 200_000), (1002, "ab 1" * 30_000)]
    rows += [(2000, "the same row")] * 40
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS pos", "2 AS n", "3 AS text_hash").repartition(3)
    for units in (3, fill_middle.PIECE_UNITS):
        got = [tuple(r) for r in fill_middle.fill_in_middle(df, units).collect()]
        assert sorted(got, key=str) == sorted((plain(*r) for r in rows), key=str)
    kept = fill_middle.fill_in_middle(df, 3, keep_text=True).select("doc_id", "restored").collect()
    assert sorted(map(tuple, kept), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    out = {hashlib.sha256(r.output.encode()).hexdigest() for r in fill_middle.output_text(df).collect()}
    assert out == {plain(*r)[5] for r in rows}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert fill_middle.fill_in_middle(df).count() == 0
