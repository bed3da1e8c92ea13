"""Layered settings: references as of their line, and the last assignment winning."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tollbridge.operators.attach import attach, measure, within_limits
from tollbridge.operators.ordered import last_before
from tollbridge.session import cut_lineage

# The form of a reference, of a sum (what is added is its second group), and of a
# text with its quotes or as the base of a sum.
REFERENCE = r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}"
SUM = r'^"?\$\(\(\s*(\$\{[A-Za-z_][A-Za-z0-9_]*\}|-?\d+)\s*\+\s*(-?\d+)\s*\)\)"?$'
WRAPPED = r"""(?s)^(?:"?\$\(\(\s*(\$\{[A-Za-z_][A-Za-z0-9_]*\}|-?\d+)\s*\+\s*-?\d+\s*\)\)"?|"(.*)"|'(.*)')$"""

# A line is known by its environment, null included, and its number.
ENV = "_env"
LINE = [ENV, "ord"]

# A worked line has its value. One that waits for a single other has the texts before and after that
# one's value; one that waits for several keeps its own pieces.
FLAT = [*LINE, "plus", "pre", "ref", "post", "value"]


def overlay_layers(assignments: DataFrame) -> DataFrame:
    """The value of the last assignment (highest ``ord``) of each key of each environment."""
    value = "value" if "value" in assignments.columns else "raw"
    return assignments.groupBy("env_id", "key").agg(F.max_by(value, "ord").alias("value"))


def resolve_refs(
    assignments: DataFrame,
    externals: Mapping[str, str] | DataFrame | None = None,
    max_rounds: int | None = None,
) -> DataFrame:
    """Add ``value`` to assignments(env_id, ord, key, raw): ``${X}`` stands for the value X had at
    that line, else its external value, else nothing; ``$((${X} + n))`` is the sum.

    Which line a reference means depends only on names and line numbers, so it is settled first, in one
    ordered scan. A line that refers to one other is then a text before and a text after that one's
    value, or a sum over it. All such lines take over the line they refer to at once: the reach doubles
    with each round, a chain of n lines takes about log2(n) rounds, and a line never holds more than two
    texts, parts of its own value. A line that refers to several waits until they are settled but for
    one. Such lines one over the other, and texts over sums and sums over texts that take turns, take a
    round each. A base that is no integer counts as 0, and sums wrap at 64 bits, as in the shell. A line
    is known by ``env_id``, which may be null, and ``ord``: a repeated pair or a missing ``ord`` is an
    error. There is no limit unless ``max_rounds`` is set, and reaching that is an error.
    """
    lines = _read_lines(_unique_lines(assignments.withColumn(ENV, _env_key(assignments))))
    pieces = cut_lineage(_pieces(lines), "refs")
    named = pieces.filter("name is not null")
    defs = lines.select(ENV, F.col("key").alias("name"), "ord")
    meant = last_before(named, defs, [ENV, "name"], "ord", "ref")
    meant = _with_externals(meant, externals)
    plain = pieces.filter("name is null").withColumn("ref", F.lit(None).cast("bigint"))
    known = [*LINE, "plus", "pos", "lit", "ref"]
    begun = _own_parts(meant.select(*known).unionByName(plain.select(*known)))
    targets = meant.filter("ref is not null").select(ENV, F.col("ref").alias("ord")).distinct()
    settled = lines.filter("not open").join(targets, LINE, "left_semi").select(
        *LINE, F.lit(None).cast("bigint").alias("plus"), *_nothing("pre", "ref", "post"),
        _summed(F.coalesce("body", F.lit("")), F.col("plus")).alias("value"),
    )
    begun = cut_lineage(begun, "refs-begun")
    written, wide = cut_lineage(_flat(begun).unionByName(settled), "refs"), begun.filter("parts is not null")
    done, rows, size_bytes, rounds = None, 0, 0, 0
    while True:
        # Only lines that are still open are worked on and written again; settled ones stay where they are.
        own_rows, own_bytes, narrow = measure(written, F.count_if(F.col("value").isNull()))
        several = wide.count() if wide is not None else 0
        rows, size_bytes = rows + own_rows, size_bytes + own_bytes
        small = within_limits(written, rows, size_bytes)
        ready = written.filter("value is not null")
        done = ready if done is None else done.unionByName(ready)
        if not narrow and not several:
            break
        if max_rounds is not None and rounds == max_rounds:
            raise ValueError(f"references are still open after {max_rounds} rounds")
        still = written.filter("value is null")
        state = done.unionByName(still)
        taken = _take_over(still, state, small)
        wide = cut_lineage(_take_values(wide, done, small), "refs-wide") if several else None
        written = cut_lineage(taken.unionByName(_flat(wide)) if several else taken, "refs")
        wide = wide.filter("parts is not null") if several else None
        rounds += 1
    worked_out = done.select(*LINE, F.col("value").alias("_value"))
    plain_value = _summed(F.coalesce("body", F.lit("")), F.col("plus"))
    return attach(lines, worked_out, LINE, small).select(
        *assignments.columns, F.coalesce("_value", plain_value).alias("value")
    )


def _env_key(df: DataFrame) -> Column:
    """The environment as a text that is never null; the only one if the table has no ``env_id``."""
    if "env_id" not in df.columns:
        return F.lit("")
    return F.coalesce(F.concat(F.lit("="), F.col("env_id").cast("string")), F.lit(""))


def _nothing(*names: str) -> list[Column]:
    return [F.lit(None).cast("bigint" if n == "ref" else "string").alias(n) for n in names]


def _unique_lines(lines: DataFrame) -> DataFrame:
    odd = lines.groupBy(*LINE).count().filter("count > 1 or ord is null").first()
    if odd is not None:
        named = repr(odd[ENV][1:]) if odd[ENV] else "without a name"
        wrong = "a line has no ord" if odd["ord"] is None else f"two lines have ord {odd['ord']}"
        raise ValueError(f"in environment {named} {wrong}")
    return lines


def _read_lines(assignments: DataFrame) -> DataFrame:
    """Add to each line its text ``body`` without quotes, the added number ``plus`` of a sum, and
    whether it is ``open``, that is, refers to another.

    A ``quote`` column tells how the text was quoted; without one the quotes are in the text.
    Nothing is replaced in single quotes. Each of the three reads the raw text on its own, so a
    filter on one of them carries no other expression along.
    """
    raw = F.col("raw")
    # Few lines are sums; a failing cast is dear, so the empty text becomes null before it.
    plus = F.nullif(F.regexp_extract(raw, SUM, 2), F.lit("")).try_cast("bigint")
    refers = F.coalesce(raw.rlike(REFERENCE), F.lit(False))
    if "quote" in assignments.columns:
        literal = F.coalesce(F.col("quote") == "'", F.lit(False))
        return assignments.withColumns({
            "body": F.when(literal, raw).otherwise(F.regexp_replace(raw, SUM, "$1")),
            "plus": F.when(~literal, plus),
            "open": refers & ~literal,
        })
    literal = F.coalesce(raw.rlike("(?s)^'.*'$"), F.lit(False))
    return assignments.withColumns({
        "body": F.regexp_replace(raw, WRAPPED, "$1$2$3"), "plus": plus, "open": refers & ~literal
    })


def _pieces(lines: DataFrame) -> DataFrame:
    """One row per literal text and the reference that follows it; ``name`` is null at the end."""
    texts = F.split("body", REFERENCE)
    names = F.regexp_extract_all("body", F.lit(REFERENCE), F.lit(1))
    split = lines.filter("open").select(*LINE, "plus", texts.alias("_texts"), names.alias("_names"))
    return (
        split.select(*LINE, "plus", "_names", F.posexplode_outer("_texts").alias("pos", "lit"))
        .select(*LINE, "plus", "pos", "lit", F.get("_names", F.col("pos")).alias("name"))
        .filter("lit <> '' or name is not null")
    )


def _with_externals(meant: DataFrame, externals: Mapping[str, str] | DataFrame | None) -> DataFrame:
    if externals is None:
        return meant
    if not isinstance(externals, DataFrame):
        externals = meant.sparkSession.createDataFrame(list(externals.items()), "key string, value string")
    on = [*([ENV] if "env_id" in externals.columns else []), "name"]
    values = externals.withColumn(ENV, _env_key(externals)).withColumnRenamed("key", "name")
    values = values.groupBy(*on).agg(F.max("value").alias("_outside"))
    found = attach(meant, values, on)
    outside = F.concat("lit", F.coalesce("_outside", F.lit("")))
    return found.withColumn("lit", F.when(F.col("ref").isNull(), outside).otherwise(F.col("lit"))).drop("_outside")


def _own_parts(rows: DataFrame) -> DataFrame:
    """One row per line from its (pos, lit, ref) rows, with ``pre``, ``ref`` and ``post`` if one reference
    is open, ``value`` if none is, ``parts`` if several are; only one line's own rows are ever gathered."""
    grouped = rows.groupBy(*LINE).agg(
        F.max("plus").alias("plus"),
        F.count("ref").alias("_open"),
        F.array_sort(F.collect_list(F.struct("pos", "lit", "ref"))).alias("_rows"),
    )
    at = F.array_position(F.transform("_rows", lambda r: r["ref"].isNotNull()), True).cast("int")
    text = lambda first, length: F.array_join(F.slice("_rows", first, length)["lit"], "")
    one, none = F.col("_open") == 1, F.col("_open") == 0
    parts = F.transform("_rows", lambda r: F.struct(r["lit"].alias("lit"), r["ref"].alias("ref")))
    return grouped.select(
        *LINE,
        F.when(~none, F.col("plus")).alias("plus"),
        F.when(one, text(F.lit(1), at)).alias("pre"),
        F.when(one, F.element_at("_rows", at)["ref"]).alias("ref"),
        F.when(one, text(at + 1, F.size("_rows"))).alias("post"),
        F.when(none, _summed(text(F.lit(1), F.size("_rows")), F.col("plus"))).alias("value"),
        F.when(F.col("_open") > 1, parts).alias("parts"),
    )


def _flat(lines: DataFrame) -> DataFrame:
    return lines.filter("parts is null").select(*FLAT)


def _take_over(still: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """One round of lines that wait for one other: they take its value, or what it waits for."""
    defs = state.select(
        ENV, F.col("ord").alias("ref"), F.col("pre").alias("_pre"), F.col("ref").alias("_ref"), F.col("post").alias("_post"),
        F.col("plus").alias("_plus"), F.col("value").alias("_value"),
    )
    met = attach(still, defs, [ENV, "ref"], small)
    bare = F.col("plus").isNotNull() & (F.col("pre") == "") & (F.col("post") == "")
    # A text over an open sum waits for its value; a sum over nothing but a sum is one sum. A line that
    # isn't among the state yet waits for several.
    moves = F.col("_value").isNull() & F.col("_ref").isNotNull() & (F.col("_plus").isNull() | bare)
    both = F.when(F.col("_plus").isNull(), F.col("plus")).otherwise(_wrapped_sum(F.col("plus"), F.col("_plus")))
    open_ = lambda c: F.when(F.col("_value").isNull(), c)
    return met.select(
        *LINE,
        open_(F.when(moves, both).otherwise(F.col("plus"))).alias("plus"),
        open_(F.when(moves, F.concat("pre", "_pre")).otherwise(F.col("pre"))).alias("pre"),
        open_(F.when(moves, F.col("_ref")).otherwise(F.col("ref"))).alias("ref"),
        open_(F.when(moves, F.concat("_post", "post")).otherwise(F.col("post"))).alias("post"),
        F.when(F.col("_value").isNotNull(), _summed(F.concat("pre", "_value", "post"), F.col("plus"))).alias("value"),
    )


def _take_values(wide: DataFrame, done: DataFrame, small: bool) -> DataFrame:
    """One round of lines that wait for several others: values that are there take their places."""
    uses = wide.select(*LINE, "plus", F.posexplode("parts").alias("pos", "_part")).select(*LINE, "plus", "pos", "_part.lit", "_part.ref")
    defs = done.select(ENV, F.col("ord").alias("ref"), F.col("value").alias("_value"))
    met = attach(uses, defs, [ENV, "ref"], small)
    return _own_parts(met.select(
        *LINE, "plus", "pos", F.concat("lit", F.coalesce("_value", F.lit(""))).alias("lit"),
        F.when(F.col("_value").isNull(), F.col("ref")).alias("ref"),
    ))


def _summed(text: Column, plus: Column) -> Column:
    total = _wrapped_sum(F.coalesce(F.trim(text).try_cast("bigint"), F.lit(0).cast("bigint")), plus)
    return F.when(plus.isNull(), text).otherwise(total.cast("string"))


def _wrapped_sum(a: Column, b: Column) -> Column:
    """The sum as the shell makes it: past 64 bits it goes on from the other end."""
    half, whole = F.lit(Decimal(1 << 63)), F.lit(Decimal(1 << 64))
    wide = F.pmod(a.cast("decimal(20,0)") + b.cast("decimal(20,0)") + half, whole) - half
    return F.coalesce(F.try_add(a, b), wide.cast("bigint"))
