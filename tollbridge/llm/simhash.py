"""SimHash near-duplicates by tiled exact comparison.

Two fingerprints that differ in at most r bits agree in at least one of r + 1 bit blocks. So the
fingerprints are laid out by block and block value, and within such a bucket all are compared: by
population count, then in tiles, exclusive-or and bit counts of whole tiles at a time. Fingerprints
whose population counts differ beyond the radius can't be neighbours: tile pairs of that kind are
skipped. A bucket of more than a tile's fingerprints is cut into tiles of equal population count, and
each pair of tiles within the radius is a piece of work of its own, so that no task gets a large
bucket. Out of a piece come the links to the least of each connected group, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tollbridge.llm.base import join_small, slices
from tollbridge.llm.components import components
from tollbridge.session import cut_lineage

WIDTH = 4
RADIUS = 4
SEED = 42
TILE = 1024


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without a word."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    spaced = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]][: max(1, len(words) - width + 1)]
    stops = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(spaced[s : e - 1], SEED) for s, e in zip(starts, stops)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) for every row of ``docs`` (doc_id, text); fp is the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = np.array([fingerprint(t or b"", width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _group(fps: np.ndarray, ids: np.ndarray, radius: int, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links from each of a piece's fingerprints to the least id of its group, without those that are least."""
    bits = np.bitwise_count(fps)
    order = np.argsort(bits, kind="stable")
    fps, ids, bits = fps[order], ids[order], bits[order].astype(np.int64)
    left, right = [], []
    for at in range(0, len(fps), tile):
        own = fps[at : at + tile]
        stop = np.searchsorted(bits, bits[min(at + tile, len(fps)) - 1] + radius, "right")  # tiles beyond it are skipped
        near = np.bitwise_count(own[:, None] ^ fps[None, at:stop]) <= radius
        u, v = np.nonzero(near)
        later = v > u
        left.append(u[later] + at)
        right.append(v[later] + at)
    u, v = np.concatenate(left), np.concatenate(right)
    if not len(u):
        return ids[:0], ids[:0]
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    by_rank = np.sort(ids, kind="stable")
    label = np.arange(len(ids))
    u, v = rank[u], rank[v]
    while True:
        before = label.copy()
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.nonzero(label != np.arange(len(ids)))[0]
    return by_rank[moved], by_rank[label[moved]]


def _compare(pieces: DataFrame, radius: int) -> DataFrame:
    """``pieces`` (piece, fp, rep), sorted by piece in each partition, to links (a, b) of reps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(fps: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            out = [_group(fps[s:e], ids[s:e], radius) for s, e in zip(cuts[:-1], cuts[1:]) if e - s > 1]
            a = np.concatenate([x for x, _ in out] or [ids[:0]])
            b = np.concatenate([y for _, y in out] or [ids[:0]])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        keys, fps, ids = np.array([], object), np.array([], np.uint64), np.array([], np.int64)
        for batch in batches:
            keys = np.concatenate([keys, np.array(batch.column("piece").to_pylist(), object)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            ids = np.concatenate([ids, batch.column("rep").to_numpy(zero_copy_only=False)])
            cuts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1])
            yield links(fps, ids, cuts)  # the last piece may go on in the next batch
            keys, fps, ids = keys[cuts[-1] :], fps[cuts[-1] :], ids[cuts[-1] :]
        if len(keys):
            yield links(fps, ids, np.array([0, len(keys)]))

    return pieces.mapInArrow(run, "a bigint, b bigint")


def bucket_rows(distinct: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint once for each of its radius + 1 blocks: (bucket, bits, fp, rep)."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]

    def value(low: int, high: int) -> Column:
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("bigint"))

    blocks = [F.concat_ws(":", F.lit(k), value(low, high)) for k, (low, high) in enumerate(zip(edges, edges[1:]))]
    return distinct.select(F.explode(F.array(*blocks)).alias("bucket"), F.bit_count("fp").alias("bits"), "fp", "rep")


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the reps of ``distinct`` (fp, rep) that hold all groups within the radius together."""
    rows = bucket_rows(distinct.where("rep IS NOT NULL"), radius)
    cells = rows.groupBy("bucket", "bits").agg(F.count(F.lit(1)).alias("n"))
    large = cells.groupBy("bucket").agg(F.sum("n").alias("all")).where(F.col("all") > tile).select("bucket")
    large = cut_lineage(large, "simhash-large")
    small = join_small(rows, large, "bucket", "left_anti").select(F.col("bucket").alias("piece"), "fp", "rep")

    # tiles of large buckets: one population count each, and as many parts of it as it takes
    parts = join_small(cells, large, "bucket", "left_semi").withColumn("parts", F.ceil(F.col("n") / tile).cast("int"))
    parts = cut_lineage(parts.select("bucket", "bits", "parts"), "simhash-tiles")
    tiles = parts.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = tiles.select("bucket", F.col("bits").alias("bits2"), F.col("part").alias("part2"))
    before = (F.col("bits2") > F.col("bits")) | ((F.col("bits2") == F.col("bits")) & (F.col("part2") >= F.col("part")))
    pairs = tiles.join(other, "bucket").where(before & (F.col("bits2") - F.col("bits") <= radius))
    piece = F.concat_ws("/", "bucket", "bits", "part", "bits2", "part2").alias("piece")
    sides = pairs.select("bucket", "bits", "part", piece).union(
        pairs.where("bits2 <> bits OR part2 <> part").select("bucket", F.col("bits2"), F.col("part2"), piece)
    )
    placed = join_small(rows, parts, ["bucket", "bits"], "inner").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    sides = cut_lineage(sides, "simhash-pairs")
    cut = join_small(placed, sides, ["bucket", "bits", "part"], "inner").select("piece", "fp", "rep")

    pieces = small.union(cut).repartition("piece").sortWithinPartitions("piece")
    return _compare(pieces, radius)


def group_near(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row of ``docs`` (doc_id, text).

    Documents are linked if their fingerprints differ in at most ``radius`` bits; component_id is the
    smallest doc_id that can be reached. A null or empty text, or one of white space, has fingerprint 0.
    A null doc_id links nothing; its component is that of its fingerprint, null if no other row has it.
    """
    own = cut_lineage(fingerprints(docs, width), "simhash")
    held = own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    held = cut_lineage(held, "simhash-distinct")
    found = components(links(held, radius, tile).distinct())
    found = found.select(F.col("a").alias("rep"), F.col("b").alias("least"))
    shared = join_small(held, found, "rep").where("n > 1 OR least IS NOT NULL")
    shared = cut_lineage(shared.select("fp", F.coalesce("least", "rep").alias("component_id")), "simhash-groups")
    return join_small(own, shared, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def near_links(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between documents of ``docs`` (doc_id, text) that hold all groups within the radius together.

    A document is linked to the least one of its own fingerprint, and that one to others. A null doc_id links nothing.
    """
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    own = cut_lineage(fingerprints(named, width), "simhash")
    held = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    shared = cut_lineage(held.where("n > 1").select("fp", "rep"), "simhash-shared")
    same = join_small(own, shared, "fp", "inner").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return cut_lineage(links(held, radius).union(same).distinct(), "simhash-links")


def drop_near(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; rows of one doc_id are one document.

    Rows without doc_id stay.
    """
    gone = group_near(docs, width, radius).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = cut_lineage(gone, "simhash-gone")
    few = gone.limit(10_001).count() <= 10_000
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti")
