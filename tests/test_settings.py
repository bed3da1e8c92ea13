import random

import pytest
from pyspark.sql import functions as F

from tollbridge.operators.settings import overlay_layers, resolve_refs
from tollbridge.plans.settings import load_settings
from tollbridge.sources.assignments import read_assignments

SCHEMA = "env_id string, ord bigint, key string, raw string"
LINES = [
    ("e", 1, "LOG_HOST", "${GATE}"),
    ("e", 2, "GATE", "192.0.2.1"),
    ("e", 3, "A_HOST", '"${GATE}"'),
    ("e", 4, "A_PORT", "9001"),
    ("e", 5, "A_STOP", "$((${A_PORT} + 200))"),
    ("e", 6, "GATE", "192.0.2.2"),
    ("e", 7, "BASE", "${HOME_DIR}/x"),
    ("e", 8, "TOOLS", "${BASE}/bin"),
    ("e", 9, "A_HOST", "192.0.2.101"),
]

BOTH_WAYS = pytest.mark.parametrize("wide", [True, False], ids=["windows", "ranges"])


def limits(setting, wide):
    if not wide:
        setting("spark.tollbridge.order.maxGroupRows", 0)
        setting("spark.tollbridge.broadcast.maxRows", 0)


def fold(lines, externals):
    """The same rules, one line after the other."""
    import re

    out, known = {}, {}
    for env, ord_, key, raw in sorted(lines):
        single = len(raw) > 1 and raw[0] == raw[-1] == "'"
        if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "'\"":
            raw = raw[1:-1]
        sum_ = None if single else re.match(r"^\$\(\((\$\{\w+\}|-?\d+) \+ (-?\d+)\)\)$", raw)
        text = sum_.group(1) if sum_ else raw
        if not single:
            text = re.sub(r"\$\{(\w+)\}", lambda m: known.get((env, m.group(1)), externals.get(m.group(1), "")), text)
        if sum_:
            text = str((int(text) if re.match(r"^-?\d+$", text) else 0) + int(sum_.group(2)))
        known[env, key] = out[env, ord_] = text
    return out


@BOTH_WAYS
def test_references_mean_the_value_at_their_line(spark, setting, wide):
    limits(setting, wide)
    lines = spark.createDataFrame(LINES, SCHEMA)
    resolved = resolve_refs(lines, {"HOME_DIR": "/h"})
    assert resolved.columns == ["env_id", "ord", "key", "raw", "value"]
    at = {r["ord"]: r["value"] for r in resolved.collect()}
    assert at == {
        1: "", 2: "192.0.2.1", 3: "192.0.2.1", 4: "9001", 5: "9201",
        6: "192.0.2.2", 7: "/h/x", 8: "/h/x/bin", 9: "192.0.2.101",
    }
    last = {r["key"]: r["value"] for r in overlay_layers(resolved).collect()}
    assert last == {
        "LOG_HOST": "", "GATE": "192.0.2.2", "A_HOST": "192.0.2.101", "A_PORT": "9001",
        "A_STOP": "9201", "BASE": "/h/x", "TOOLS": "/h/x/bin",
    }


@BOTH_WAYS
def test_random_settings_equal_a_fold(spark, setting, wide):
    limits(setting, wide)
    rng = random.Random(5)
    shapes = [
        "v{n}", "{n}", "${{{a}}}", "${{{a}}}/${{{b}}}", "$((${{{a}}} + {n}))", "'${{{a}}}'",
        '"x${{{a}}}${{{a}}}y"', "${{OUT}}:${{{a}}}", "$(({n} + 1))", "",
    ]
    lines = []
    for env in ("p", "q", "r"):
        for ord_ in range(1, 90):
            key, a, b = (rng.choice("ABCDEF") for _ in range(3))
            # Text that quotes itself doubles with every line, so only "{a}" may be the key itself.
            raw = rng.choice(shapes)
            if raw.count("{a}") > 1 or "{b}" in raw:
                a, b, key = "A", "B", rng.choice("EF")
            elif key in "EF" or a in "EF":
                key, a = rng.choice("CD"), rng.choice("ABCD")
            lines.append((env, ord_, key, raw.format(n=rng.randint(-5, 9000), a=a, b=b)))
    got = resolve_refs(spark.createDataFrame(lines, SCHEMA), {"OUT": "o${A}"})
    assert {(r["env_id"], r["ord"]): r["value"] for r in got.collect()} == fold(lines, {"OUT": "o${A}"})


def test_long_chains_take_few_rounds(spark):
    lines = [("e", 0, "N", "5"), ("e", 1, "P", "/0")]
    for n in range(2, 130):
        lines.append(("e", n, "N", f"$((${{N}} + {n}))") if n % 2 else ("e", n, "P", f"${{P}}/{n}"))
    got = resolve_refs(spark.createDataFrame(lines, SCHEMA), max_rounds=8)
    assert {(r["env_id"], r["ord"]): r["value"] for r in got.collect()} == fold(lines, {})
    with pytest.raises(ValueError):
        resolve_refs(spark.createDataFrame(lines, SCHEMA), max_rounds=2)


def test_externals_by_environment(spark):
    lines = spark.createDataFrame([("p", 1, "A", "${X}"), ("q", 1, "A", "${X}")], SCHEMA)
    outside = spark.createDataFrame([("p", "X", "1")], "env_id string, key string, value string")
    assert {r["env_id"]: r["value"] for r in resolve_refs(lines, outside).collect()} == {"p": "1", "q": ""}


def test_files_are_read_in_layer_and_line_order(spark, tmp_path):
    base = tmp_path / "with space+%41"
    base.mkdir()
    (base / "one.sh").write_text(
        "#!/bin/bash\n# export NO=1\nexport A=1   # why\n\nexport B=\"x # y\"\nsource other.sh\n"
        "C='${A}'\nexport D=${A}/d\nalias z='a=b'\n"
    )
    (base / "two.conf").write_text("http-port=${A}\nA=2\n")
    layers = spark.createDataFrame(
        [("e", 1, str(base / "one.sh")), ("e", 2, str(base / "two.conf")),
         ("f", 1, "file://" + str(base / "two.conf").replace("%41", "%2541").replace(" ", "%20"))],
        "env_id string, layer_ord int, path string",
    )
    expected = [
        ("e", "A", "1", ""), ("e", "B", "x # y", '"'), ("e", "C", "${A}", "'"), ("e", "D", "${A}/d", ""),
        ("e", "http-port", "${A}", ""), ("e", "A", "2", ""), ("f", "http-port", "${A}", ""), ("f", "A", "2", ""),
    ]
    for how in (str(base), None):
        if how is None:
            layers = layers.filter("env_id = 'e'")
            expected = [r for r in expected if r[0] == "e"]
        read = read_assignments(spark, layers, how)
        assert [tuple(r) for r in read.orderBy("env_id", "ord").drop("ord").select("env_id", "key", "raw", "quote").collect()] == expected
    loaded = load_settings(spark, layers, {}, str(base))
    assert {(r["key"], r["value"]) for r in loaded.collect()} == {
        ("A", "2"), ("B", "x # y"), ("C", "${A}"), ("D", "1/d"), ("http-port", "1"),
    }


def test_a_split_file_keeps_its_line_order(spark, setting, tmp_path):
    setting("spark.sql.files.maxPartitionBytes", 600)
    setting("spark.sql.files.openCostInBytes", 1)
    setting("spark.tollbridge.broadcast.maxRows", 0)
    for f in range(3):
        (tmp_path / f"f{f}.sh").write_text("".join(f"# c\nexport K{f}={n}\n" for n in range(400)))
    layers = spark.createDataFrame(
        [("e", f, str(tmp_path / f"f{f}.sh")) for f in range(3)], "env_id string, layer_ord int, path string"
    )
    read = read_assignments(spark, layers)
    assert read.rdd.getNumPartitions() >= 1
    assert [int(r["raw"]) for r in read.orderBy("ord").collect()] == [n for _ in range(3) for n in range(400)]
    assert read.select(F.countDistinct("ord")).first()[0] == 1200


def test_many_folders_are_read_through_one(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("tollbridge.sources.assignments.MAX_FOLDERS", 2)
    for n in range(4):
        (tmp_path / "a" / f"d{n}").mkdir(parents=True)
        (tmp_path / "a" / f"d{n}" / "f.sh").write_text(f"export K={n}\n")
    (tmp_path / "a" / "other.sh").write_text("export K=9\n")
    layers = spark.createDataFrame([("e", n, str(tmp_path / "a" / f"d{n}" / "f.sh")) for n in range(4)], "env_id string, layer_ord int, path string")
    assert [r["raw"] for r in read_assignments(spark, layers).orderBy("ord").collect()] == ["0", "1", "2", "3"]


def test_layers_of_any_number(spark, tmp_path):
    """Numbers past 19 and 31 bits, negative ones, and two files of one layer."""
    numbers = [-5, 0, 524_287, 524_288, 1 << 31, 1 << 60]
    for n in numbers:
        (tmp_path / f"l{n}.sh").write_text(f"export K={n}\nexport L{n}=1\n")
    (tmp_path / "same.sh").write_text("export K=last\n")
    layers = [("e", n, str(tmp_path / f"l{n}.sh")) for n in numbers] + [("e", 1 << 60, str(tmp_path / "same.sh"))]
    df = spark.createDataFrame(layers, "env_id string, layer_ord bigint, path string")
    read = read_assignments(spark, df).filter("key = 'K'").orderBy("ord")
    assert [r["raw"] for r in read.collect()] == [*map(str, numbers), "last"]
    assert {r["key"]: r["value"] for r in load_settings(spark, df, {}).collect()}["K"] == "last"


def test_repeated_lines_are_refused(spark):
    lines = spark.createDataFrame([("e", 1, "A", "x"), ("e", 2, "B", "${A}1"), ("e", 2, "C", "${A}2")], SCHEMA)
    with pytest.raises(ValueError, match="ord 2"):
        resolve_refs(lines)


def test_sums_wrap_at_64_bits(spark):
    top = (1 << 63) - 1
    lines = [("e", 1, "A", str(top)), ("e", 2, "B", "$((${A} + 1))"), ("e", 3, "C", "$((${B} + 5))"),
             ("e", 4, "D", "$((${E} + 9223372036854775807))"), ("e", 5, "F", "$((${D} + 9223372036854775807))")]
    got = {r["key"]: r["value"] for r in resolve_refs(spark.createDataFrame(lines, SCHEMA)).collect()}
    assert got == {"A": str(top), "B": str(-top - 1), "C": str(-top + 4), "D": str(top), "F": "-2"}


def test_a_long_chain_of_texts(spark):
    """Its lines are as long as they end up, and no line is more than its own texts on the way."""
    n = 20_000
    lines = spark.range(n).select(
        F.lit("e").alias("env_id"), F.col("id").alias("ord"), F.lit("P").alias("key"), F.lit("<${P}>").alias("raw")
    )
    got = resolve_refs(lines, {"P": "x"}).select("ord", F.length("value").alias("n"), F.sha2("value", 256).alias("h"))
    assert got.filter("n <> 2 * ord + 3").count() == 0 and got.count() == n
    import hashlib

    last = got.filter(f"ord = {n - 1}").first()
    assert last["h"] == hashlib.sha256(("<" * n + "x" + ">" * n).encode()).hexdigest()


@BOTH_WAYS
def test_lines_that_wait_for_several(spark, setting, wide):
    limits(setting, wide)
    lines = [("e", 0, "A", "1"), ("e", 1, "B", "2")]
    for n in range(2, 60):
        lines.append(("e", n, "AB"[n % 2], ("${A}-" if n % 5 else "$((${B} + 1))")))
        lines.append(("e", n * 100, "C", "${A}:${B}:${A}"))
    lines += [("e", 9000, "D", "[${C}|${C}]"), ("e", 9001, "E", "${D}${NONE}${D}"), ("e", 9002, "F", "$((${E} + 4))")]
    got = resolve_refs(spark.createDataFrame(lines, SCHEMA))
    assert {(r["env_id"], r["ord"]): r["value"] for r in got.collect()} == fold(lines, {})


@BOTH_WAYS
def test_an_environment_may_be_null(spark, setting, wide):
    limits(setting, wide)
    lines = [(None, 1, "A", "x"), (None, 2, "B", "${A}y"), ("", 1, "A", "z"), ("", 2, "B", "${A}${B}"), (None, 3, "C", "${B}${A}"), ("e", 1, None, "${A}")]
    got = resolve_refs(spark.createDataFrame(lines, SCHEMA)).collect()
    assert {(r["env_id"], r["ord"]): r["value"] for r in got} == {
        (None, 1): "x", (None, 2): "xy", (None, 3): "xyx", ("", 1): "z", ("", 2): "z", ("e", 1): ""
    }
    with pytest.raises(ValueError, match="no ord"):
        resolve_refs(spark.createDataFrame([*lines, ("e", None, "Q", "1")], SCHEMA))


def test_loading_reads_the_files_once(spark, tmp_path):
    (tmp_path / "one.env").write_text("A=x\nB=${A}y\nC=${B}${A}z\n")
    layers = spark.createDataFrame([("e", 1, str(tmp_path / "one.env"))], "env_id string, layer_ord int, path string")
    loaded = load_settings(spark, layers, {}, str(tmp_path))
    assert {r["key"]: r["value"] for r in loaded.collect()} == {"A": "x", "B": "xy", "C": "xyxz"}
    assert "FileScan text" not in loaded._jdf.queryExecution().executedPlan().toString()
