"""Near copies by the Jaccard similarity of their word shingles: every pair at or above a bound, no other.

A text is the set of its shingles' hashes. Two sets of similarity t share at least one of the first
n - ceil(t * n) + 1 hashes of each, whatever order all hashes are put into. So each set is laid out by
those hashes only, sets that share one are candidates, and candidates are compared in full. Equal sets are
taken together first. The order has shingles that are frequent in a sample of the documents last: that
keeps candidates few, and the links are the same with any order.

Most copies are found before that: links of near fingerprints (simhash.py) are compared in full, and what
they bring together is one group from then on. Copies may differ in more bits than any radius has; the
shared hashes find those, and only between documents that are not in one group.

A group of copies shares its hashes, and its pairs grow with its square. So each hash first has one
document, its pivot, compared with all others that have the hash; what a pivot has brought together needs
no further comparison there. Some rounds of pivots leave, for a group of copies, few documents outside; only
pairs of documents that are still apart are then compared one with the other. No link between groups is
lost: a pair is left out only if both are in one group already.

Whole sets are sent only for pairs that may be alike by how many shingles fall into each part of the range
of hashes: the sets differ in no less than these numbers do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tollbridge.llm import simhash
from tollbridge.llm.base import join_small, slices
from tollbridge.llm.components import components
from tollbridge.operators.attach import fits_broadcast
from tollbridge.session import cut_lineage

WIDTH = 5
#: The similarity from which on texts are copies, as a fraction of whole numbers: compared without rounding.
ALIKE = (4, 5)
SEED = 42
#: Rounds in which a hash's documents are compared with one of them.
PIVOT_ROUNDS = 2
#: Bits in which the fingerprints of linked documents may differ.
RADIUS = 6
#: Pairs of one document that are compared in one piece.
PIECE = 1_000
#: About so many documents are sampled for frequent shingles, and at most so many shingles are held.
SAMPLE, FREQUENT = 20_000, 500_000


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's word shingles, each once, ascending; a short text is one shingle, no word none."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.array([], np.int64)
    spaced = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]][: max(1, len(words) - width + 1)]
    stops = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(spaced[s : e - 1], SEED) for s, e in zip(starts, stops)], np.uint64).view(np.int64))


def _counts(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes are in each part of their range, 255 at most; about four to a part."""
    bits = min(12, (len(hashes) // 4).bit_length())
    parts = (hashes.view(np.uint64) >> np.uint64(52)).astype(np.int64) >> (12 - bits)
    return np.minimum(np.bincount(parts, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """In how many hashes two sets differ at least, by their counts."""
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (x, y))
    n = min(len(x), len(y))
    return int(np.abs(x.reshape(n, -1).sum(axis=1) - y.reshape(n, -1).sum(axis=1)).sum())


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, n, counts) of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [shingles(t or b"", width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([xxhash.xxh128_digest(h.tobytes()) for h in own], pa.binary()),
                    pa.array([len(h) for h in own], pa.int32()), pa.array([_counts(h) for h in own], pa.binary()),
                ],
                names=["doc_id", "digest", "n", "counts"],
            )

    return docs.mapInArrow(run, "doc_id bigint, digest binary, n int, counts binary")


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of two or more sampled documents, ascending, and in how many each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [shingles(t or b"", width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own or [np.array([], np.int64)]))], names=["h"])

    every = max(1, docs.count() // SAMPLE)
    held = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = held.where("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = (top.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(h)
    return h[order], n[order].astype(np.int32)


def _prefixes(docs: DataFrame, width: int, alike: tuple[int, int], frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, doc_id, label, n, at): the first hashes of each set of ``docs`` (doc_id, label, text) in the common
    order, with their place, and the set's size."""
    up, down = alike
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in slices(batches):
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "label"))
            own = []
            for text in batch.column("text").to_pylist():
                hashes = shingles(text or b"", width)
                rank = np.zeros(len(hashes), np.int32)
                if len(known) and len(hashes):
                    found = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    rank = np.where(known[found] == hashes, counts[found], 0)
                n = len(hashes)
                own.append((hashes[np.lexsort((hashes, rank))][: n - -(-up * n // down) + 1 if n else 0], n))
            sizes = [len(h) for h, _ in own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([h for h, _ in own] or [np.array([], np.int64)])), pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(labels, sizes)),
                    pa.array(np.repeat(np.array([n for _, n in own], np.int32), sizes)),
                    pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes] or [np.array([], np.int32)])),
                ],
                names=["h", "doc_id", "label", "n", "at"],
            )

    return docs.mapInArrow(run, "h bigint, doc_id bigint, label bigint, n int, at int")


def _may_be_alike(pairs: DataFrame, own: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """``pairs`` (a, b) without those that can't be alike by the counts of their sets."""
    up, down = alike

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both, x, y = (batch.column(c).to_pylist() for c in ("both", "x", "y"))
            good = [(up + down) * (n - _differ(p, q)) >= 2 * up * n for n, p, q in zip(both, x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("n").alias("m"), F.col("counts").alias("x")), "a")
    two = one.join(own.select(F.col("doc_id").alias("b"), "n", F.col("counts").alias("y")), "b")
    return two.select("a", "b", (F.col("m") + F.col("n")).alias("both"), "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def _alike(pairs: DataFrame, own: DataFrame, texts: DataFrame, width: int, alike: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are alike.

    A pair is compared where its document with more pairs is, that one's set being sent once for a piece
    of its pairs: sets are shuffled once, one for each pair and one for each piece.
    """
    up, down = alike

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known, own = {}, []  # the rows of one document follow each other
            for text in batch.column("text").to_pylist():
                if text not in known:
                    known = {text: shingles(text or b"", width).tobytes()}
                own.append(known[text])
            yield batch.select(["hub", "piece", "other"]).append_column("set", pa.array(own, pa.binary()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []  # a document has a set for each of its texts

        def linked(x: np.ndarray) -> bool:
            both = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for y in hubs]
            return any(down * b >= up * (n - b) for b, n in both)

        for batch in slices(batches, 64):
            good = []
            for hub, piece, other, own in zip(*(batch.column(c).to_pylist() for c in ("hub", "piece", "other", "set"))):
                if (hub, piece) != at:
                    at, hubs = (hub, piece), []
                own = np.frombuffer(own, np.int64)
                if other is None:
                    hubs.append(own)
                good.append(other is not None and linked(own))
            yield batch.select(["hub", "other"]).filter(pa.array(good, pa.bool_()))

    near = cut_lineage(_may_be_alike(pairs, own, alike), "near-possible")
    many = cut_lineage(near.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("many")), "near-many")
    sized = join_small(near, many.select(F.col("doc_id").alias("a"), F.col("many").alias("of_a")), "a", "inner")
    sized = join_small(sized, many.select(F.col("doc_id").alias("b"), F.col("many").alias("of_b")), "b", "inner")
    hub = F.when(F.col("of_a") > F.col("of_b"), F.col("a")).otherwise(F.col("b"))
    other = F.when(F.col("of_a") > F.col("of_b"), F.col("b")).otherwise(F.col("a"))
    piece = F.pmod(F.xxhash64(other), F.ceil(F.greatest("of_a", "of_b") / PIECE)).cast("int")
    placed = cut_lineage(sized.select(hub.alias("hub"), piece.alias("piece"), other.alias("other")), "near-placed")
    none = F.lit(None).cast("bigint").alias("other")
    needed = placed.select(F.col("other").alias("doc_id"), "*").union(placed.select(F.col("hub").alias("doc_id"), "hub", "piece", none).distinct())
    sets = _join_measured(texts, cut_lineage(needed, "near-needed"), "doc_id", "inner").select("hub", "piece", "other", "text")
    sets = sets.mapInArrow(encode, "hub bigint, piece int, other bigint, set binary")
    sets = sets.repartition("hub", "piece").sortWithinPartitions("hub", "piece", "other")  # the hub's own come first
    found = sets.mapInArrow(compare, "hub bigint, other bigint")
    return found.select(F.greatest("hub", "other").alias("a"), F.least("hub", "other").alias("b")).distinct()


def _join_measured(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    """Join a written table: broadcast while its rows and bytes measure small, else by shuffle."""
    return left.join(F.broadcast(right) if fits_broadcast(right) else right, on, how)


def group_copies(docs: DataFrame, width: int = WIDTH, alike: tuple[int, int] = ALIKE, near: DataFrame | None = None) -> DataFrame:
    """(doc_id, least) for documents of ``docs`` (doc_id, text) that aren't the least of their group.

    Documents are linked if the similarity of their sets is at least ``alike``, and if both have no word.
    Links of ``near`` (a, b) are tried first, and count if they are alike; the result is the same without.
    A null doc_id links nothing. Rows of one doc_id are one document, linked by each of its texts.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    own = cut_lineage(_sets(texts, width), "near-sets")
    held = cut_lineage(own.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "near-equal")
    equal = join_small(own.select("doc_id", "digest"), held, "digest", "inner")
    equal = cut_lineage(equal.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "near-same")

    # a document is left out of the search only if all its texts are some other document's
    several = own.groupBy("doc_id").agg(F.count_distinct("digest").alias("k")).where("k > 1").select("doc_id")
    other = cut_lineage(equal.select(F.col("a").alias("doc_id")).distinct().join(several, "doc_id", "left_anti"), "near-others")
    searched = _join_measured(texts, other, "doc_id", "left_anti")
    least = components(equal)
    if near is not None:
        of = {c: least.select(F.col("a").alias(c), F.col("b").alias(f"of_{c}")) for c in ("a", "b")}
        named = _join_measured(_join_measured(near.select("a", "b"), of["a"], "a", "left"), of["b"], "b", "left")
        x, y = F.coalesce("of_a", "a"), F.coalesce("of_b", "b")
        tried = named.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b").distinct()
        found = cut_lineage(_alike(cut_lineage(tried, "near-pairs"), own, texts, width, alike), "near-links")
        least = components(least.union(found))

    # the hashes are made twice, which takes less than to write them all: few are of documents of several groups
    labels = least.select(F.col("a").alias("doc_id"), F.col("b").alias("label"))
    labelled = _join_measured(searched, labels, "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("label"), "text")
    rows = _prefixes(labelled, width, alike, _frequent(texts, width))
    several = rows.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h")
    several = cut_lineage(several, "near-several")
    rows = cut_lineage(_join_measured(rows, several, "h", "left_semi"), "near-shared")
    apart = rows
    for k in range(PIVOT_ROUNDS + 1):
        if apart.isEmpty():
            break
        pairs = cut_lineage(_pairs(apart, alike, k if k < PIVOT_ROUNDS else None), "near-pairs")
        found = cut_lineage(_alike(pairs, own, texts, width, alike), "near-links")
        least = components(least.union(found))
        if k < PIVOT_ROUNDS:
            apart = cut_lineage(_apart(rows, least), "near-apart")
    return least.select(F.col("a").alias("doc_id"), F.col("b").alias("least"))


def _pairs(rows: DataFrame, alike: tuple[int, int], round_: int | None) -> DataFrame:
    """(a, b), a > b: candidates that share a hash and may be alike by size and place. In a round of pivots
    only those with the hash's pivot, which is of its group with the most documents and another one each
    round; hashes with the same documents have the same pivot. Without a round all that are apart."""
    up, down = alike
    x, y = rows.alias("x"), rows.alias("y")
    if round_ is not None:
        # what comes before a shared hash is rarer: the copy with the least of it was changed least
        rarer = F.col("at") if round_ == 0 else F.lit(0)
        first = F.min(F.struct(rarer.alias("rarer"), F.xxhash64(F.lit(round_), "doc_id").alias("order"), "doc_id", "n", "at")).alias("own")
        groups = rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("many"), first)
        best = F.min(F.struct((-F.col("many")).alias("fewer"), "own", "label")).alias("best")
        y = groups.groupBy("h").agg(best).select("h", "best.label", "best.own.doc_id", "best.own.n", "best.own.at").alias("y")
    # no more can be shared than this hash and what follows it on the side that has less left
    follow = F.least(F.expr("x.n - x.at"), F.expr("y.n - y.at"))
    fits = F.expr(f"{down} * x.n >= {up} * y.n AND {down} * y.n >= {up} * x.n") & ((up + down) * follow >= up * F.expr("x.n + y.n"))
    wanted = F.expr("x.label <> y.label AND x.doc_id <> y.doc_id") if round_ is not None else F.expr("x.label > y.label")
    high, low = F.greatest("x.doc_id", "y.doc_id").alias("a"), F.least("x.doc_id", "y.doc_id").alias("b")
    return x.join(y, "h").where(wanted & fits).select(high, low).distinct()


def _apart(rows: DataFrame, least: DataFrame) -> DataFrame:
    """The rows with their document's group as ``label``, of hashes whose documents aren't all in one group."""
    labels = least.select(F.col("a").alias("doc_id"), F.col("b").alias("label"))
    named = cut_lineage(rows.drop("label").join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "near-labels")
    several = named.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h")
    return named.join(several, "h", "left_semi")


def drop_copies(docs: DataFrame, width: int = WIDTH, alike: tuple[int, int] = ALIKE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; rows of one doc_id are one document.

    Fingerprints that differ in at most ``radius`` bits link documents to be compared. Rows without doc_id stay.
    """
    near = simhash.near_links(docs, width, radius)
    gone = cut_lineage(group_copies(docs, width, alike, near).select(F.col("doc_id").alias("_gone")), "near-gone")
    return docs.join(F.broadcast(gone) if fits_broadcast(gone) else gone, docs["doc_id"] == gone["_gone"], "left_anti")
