"""Line deduplication over documents, in DataFrame functions only.

Each document gives its line hashes once. The hashes are range-partitioned and, within a range, sorted
by document and position, the last document first; streaming through a hash, its first document keeps
the line and the others lose it, if enough documents hold it. A hash held by more than ``stream_docs``
documents would be a large group in one task: such hashes are counted beforehand with map-side
aggregation and decided from their count and last document, wherever their rows lie. What comes out is
no text but, per document, the dropped positions as runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tollbridge.llm.base import SPACE_CHARS, ascii_lower, join_small, let
from tollbridge.session import cut_lineage

MIN_CHARS = 40
MIN_DOCS = 5
#: A hash of more documents is decided from its count instead of streamed; the result is the same.
STREAM_DOCS = 1_000
ROW = ("doc_id", "_text_hash")


def split_lines(text: Column) -> Column:
    """The lines between line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(lines: Column, min_chars: int = MIN_CHARS) -> Column:
    """The 128-bit hash of each line's key, null for keys that are too short."""

    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(SPACE_CHARS))
        return F.when(F.length(key) >= min_chars, F.md5(ascii_lower(key).cast("binary")))

    return F.transform(lines, hashed)


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per line with a key: hash, the document, its position, and whether it is the hash's first there."""

    def places(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("pos")))
        return let(F.sort_array(F.filter(pairs, lambda p: p["hash"].isNotNull())), flagged)

    def flagged(pairs: Column) -> Column:
        return F.transform(
            pairs,
            lambda p, i: F.struct(
                F.unhex(p["hash"]).alias("hash"), p["pos"].alias("pos"),
                F.coalesce(F.get(pairs, i - 1)["hash"] != p["hash"], F.lit(True)).alias("first"),
            ),
        )

    placed = let(line_hashes(split_lines(F.col("text")), min_chars), places)
    return docs.select(*ROW, F.inline(placed))


def _large_hashes(once: DataFrame, stream_docs: int) -> DataFrame:
    """The hashes of more rows than are streamed, with their exact number of documents and last document."""
    often = once.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > stream_docs)
    often = cut_lineage(often, "line-hashes-often").select("hash")
    held = join_small(once, often, "hash", "left_semi").select("hash", "doc_id").distinct()
    return cut_lineage(held.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last")), "line-hashes-large")


def _runs(at: Column) -> Column:
    """Sorted positions as runs of (start, length)."""
    starts = F.filter(at, lambda p, i: F.coalesce(F.get(at, i - 1) != p - 1, F.lit(True)))
    ends = F.filter(at, lambda p, i: F.coalesce(F.get(at, i + 1) != p + 1, F.lit(True)))
    return let(ends, lambda e: F.transform(starts, lambda s, i: F.struct(s.alias("start"), (F.get(e, i) - s + 1).alias("length"))))


def dropped_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, stream_docs: int = STREAM_DOCS
) -> DataFrame:
    """doc_id, _text_hash and ``drops``, the runs of dropped lines, for the documents that lose any.

    ``docs`` has doc_id, text and _text_hash. Rows of one doc_id count as one document; a null doc_id
    comes before all others.
    """
    lines = cut_lineage(_occurrences(docs, min_chars), "line-hashes")
    large = _large_hashes(lines.where("first"), stream_docs)
    placed = join_small(lines.drop("first"), large, "hash")
    decided = placed.where((F.col("docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("last")))

    stream = Window.partitionBy("hash").orderBy(F.col("doc_id").desc(), "pos")
    rank = F.dense_rank().over(Window.partitionBy("hash").orderBy(F.col("doc_id").desc()))
    streamed = (
        placed.where("docs IS NULL").select("hash", *ROW, "pos").repartitionByRange("hash")
        .withColumns({"rank": rank, "keeper": F.first("doc_id").over(stream)})
        .withColumn("docs", F.max("rank").over(Window.partitionBy("hash")))
        .where((F.col("docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    )
    drops = decided.select(*ROW, "pos").union(streamed.select(*ROW, "pos"))
    at = F.array_sort(F.collect_set("pos")).alias("at")
    return drops.groupBy(*ROW).agg(at).select(*ROW, let(F.col("at"), _runs).alias("drops"))


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, stream_docs: int = STREAM_DOCS
) -> DataFrame:
    """``docs`` (doc_id, text and any more) as ``row``, with n_lines, n_dropped and the text ``kept``.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of
    at least ``min_chars`` code points that at least ``min_docs`` documents hold lose their lines in
    all but the largest doc_id. A null or empty text is one empty line, which stays. Repeated rows all
    keep or lose the same lines.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), "text", row)
    drops = dropped_lines(hashed.drop("row"), min_chars, min_docs, stream_docs)
    drops = drops.select(F.col("doc_id").alias("_id"), F.col("_text_hash").alias("_hash"), "drops")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    lines = split_lines(F.col("text"))

    def without(own: Column) -> Column:
        gone = F.flatten(F.transform("drops", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
        stays = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), gone)
        return F.array_join(F.transform(stays, lambda i: F.get(own, i)), "\n")

    n_dropped = F.coalesce(F.aggregate("drops", F.lit(0), lambda n, r: n + r["length"]), F.lit(0))
    return hashed.select("doc_id", "_text_hash", "text", "row").join(drops, same, "left").select(
        "row",
        F.size(lines).cast("bigint").alias("n_lines"),
        n_dropped.cast("bigint").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(let(lines, without)).alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines taken out of ``text``, and ``n_chars``, where there is one, counted anew.

    A text that loses no line stays as it is, null included.
    """
    out = dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    own = {c: F.col("row")[c] for c in docs.columns}
    own["text"] = F.when(changed, F.col("kept")).otherwise(own["text"])
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(changed, F.length("kept").cast(kind)).otherwise(own["n_chars"])
    return out.select(*[c.alias(n) for n, c in own.items()])
