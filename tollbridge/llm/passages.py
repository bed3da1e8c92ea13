"""Substring dedup: words covered by a window that also starts elsewhere in the corpus.

A window is known by its anchor, the least hash among its runs of a few words; equal windows have equal
anchors, at the same place in them. Neighbouring windows with one anchor are a piece of text. Anchors that
are in one place only can't repeat, and their pieces are left out. The other pieces are dealt out by
anchor to shards. A shard is a compressed FM-index of its pieces, each text once with its number, and the
pieces are streamed against it by backward search; what is reported are the intervals of words whose
matches are long enough and found again. So each shard sees all places of its windows, and no document
meets a shard with which it shares no anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tollbridge.llm.base import slices
from tollbridge.llm.fm_index import FmIndex
from tollbridge.operators.attach import fits_broadcast
from tollbridge.session import cut_lineage

WINDOW = 35
#: Words of the runs whose hashes are anchors.
ANCHOR_WORDS = 8
#: Anchors of more pieces are split further, down to single windows.
HOT_ANCHOR = 20_000
#: Words of an index, unless one anchor has more; at most those of HOT_ANCHOR pieces of two windows' length.
SHARD_WORDS = 2_000_000
#: Bytes of pieces that a map task holds to send equal ones once.
HELD_BYTES = 32 << 20
CACHED_WORDS = 400_000
KEY = ["k1", "k2"]
PLACE = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("at", "<i4")])
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def word_hashes(text: bytes) -> np.ndarray:
    """The hash of each word between ASCII white space."""
    words = text.split()  # of bytes: ASCII white space only
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def anchored(words: np.ndarray, window: int = WINDOW, run: int = ANCHOR_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each piece; the leftmost of equal hashes is the anchor."""
    run = min(run, window)
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = words[: len(words) - run + 1].copy()
    for j in range(1, run):
        mixed = mixed * _MULTIPLY + words[j : len(words) - run + 1 + j]
        mixed ^= mixed >> np.uint64(29)
    mixed = mixed * _MIX
    mixed ^= mixed >> np.uint64(32)
    among = np.lib.stride_tricks.sliding_window_view(mixed, window - run + 1)
    at = among.argmin(axis=1) + np.arange(len(among))
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return mixed[at[first]].view(np.int64), first, np.diff(np.append(first, len(at)))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text as bytes, and a key of both: equal rows share it."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))


def _pieces(keyed: DataFrame, window: int, run: int) -> DataFrame:
    """(k1, k2, anchor, first, n) of every piece of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [anchored(word_hashes(t), window, run) for t in batch.column("text").to_pylist()]
            sizes = [len(a) for a, _, _ in own]
            k1, k2 = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes) for c in KEY)
            anchor, first, n = (np.concatenate([x[i] for x in own]) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1), pa.array(k2), pa.array(anchor), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=[*KEY, "anchor", "first", "n"],
            )

    return keyed.mapInArrow(read, "k1 bigint, k2 bigint, anchor bigint, first int, n int")


def _sent(found: DataFrame, window: int) -> DataFrame:
    """(route, words, n, copies, places): the texts of the pieces in ``runs``, with where they are.

    A task sends equal texts once as long as it holds them, so that even a piece of many documents is few
    rows. Pieces of hot anchors are cut into single windows, routed by all their words.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        size = 0

        def batch_of(items: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([route for (route, _), _ in items], pa.int64()), pa.array([words for (_, words), _ in items], pa.binary()),
                    pa.array([own[0] for _, own in items], pa.int64()), pa.array([bytes(own[1]) for _, own in items], pa.binary()),
                ],
                names=["route", "words", "copies", "places"],
            )

        def flushed() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            for k in range(0, len(items), 2_000):
                yield batch_of(items[k : k + 2_000])

        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("text", *KEY, "runs")]
            for text, k1, k2, runs in zip(*columns):
                words = word_hashes(text)
                for r in runs:
                    first, n = r["first"], r["n"]
                    parts = [(first, n, r["anchor"])]
                    if r["hot"]:
                        parts = [(i, 1, xxhash.xxh64_intdigest(words[i : i + window].tobytes()) - (1 << 63)) for i in range(first, first + n)]
                    for i, many, route in parts:
                        own = words[i : i + many + window - 1].tobytes()
                        entry = held.get((route, own))
                        if entry is None:
                            entry = held[route, own] = [0, bytearray()]
                            size += len(own) + 200
                        entry[0] += 1
                        entry[1] += np.array([(k1, k2, i)], PLACE).tobytes()
                        size += PLACE.itemsize
            if size > HELD_BYTES:
                yield from flushed()
                held.clear()
                size = 0
        yield from flushed()

    return found.mapInArrow(read, "route bigint, words binary, copies bigint, places binary")


def _repeated(sent: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(k1, k2, first, n): intervals of n words, from word ``first`` on, whose windows all repeat."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[bytes, list] = {}
        size, last = 0, None

        def shard() -> Iterator[pa.RecordBatch]:
            index = FmIndex([np.frombuffer(t, np.uint64) for t in texts], [copies for copies, _ in texts.values()])
            found = index.repeated(window)
            before = np.append(False, found[:-1])
            starts = np.flatnonzero(found & ~before)
            stops = np.flatnonzero(before & ~found)
            owner = np.searchsorted(index.first, starts, "right") - 1
            places = [np.frombuffer(b"".join(p), PLACE) for _, p in texts.values()]
            out, rows = [], 0
            for piece, start, stop in zip(owner.tolist(), starts.tolist(), stops.tolist()):
                own = places[piece]
                out.append((own["k1"], own["k2"], own["at"] + np.int32(start - index.first[piece]), np.full(len(own), stop - start + window - 1, np.int32)))
                rows += len(own)
                if rows > 100_000:
                    yield table(out)
                    out, rows = [], 0
            if out:
                yield table(out)

        def table(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(4)], names=[*KEY, "first", "n"])

        for batch in slices(batches, 2_000):
            for route, words, copies, places in zip(*[c.to_pylist() for c in batch.columns]):
                if route != last and size > shard_words:
                    yield from shard()
                    texts.clear()
                    size = 0
                last = route
                entry = texts.get(words)
                if entry is None:
                    entry = texts[words] = [0, []]
                    size += len(words) // 8
                entry[0] += copies
                entry[1].append(places)
        if texts:
            yield from shard()

    dealt = sent.repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(search, "k1 bigint, k2 bigint, first int, n int")


def _with_spans(docs: DataFrame, window: int, run: int, hot_anchor: int, shard_words: int) -> DataFrame:
    """The keyed rows with ``spans``, the intervals of repeated words; null where there are none."""
    keyed = _keyed(docs)
    pieces = cut_lineage(_pieces(keyed, window, run), "passage-pieces")
    shared = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = cut_lineage(shared.select("anchor", (F.col("many") > hot_anchor).alias("hot")), "passage-anchors")
    found = pieces.join(F.broadcast(shared) if fits_broadcast(shared) else shared, "anchor")
    runs = found.groupBy(*KEY).agg(F.collect_set(F.struct("anchor", "first", "n", "hot")).alias("runs"))
    met = keyed.join(runs, KEY).select("doc_id", "text", *KEY, "runs")
    spans = _repeated(_sent(met, window), window, shard_words)
    by_row = spans.groupBy(*KEY).agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    return keyed.join(by_row, KEY, "left")


def dedup_passages(
    docs: DataFrame, window: int = WINDOW, run: int = ANCHOR_WORDS, hot_anchor: int = HOT_ANCHOR, shard_words: int = SHARD_WORDS,
    keep_text: bool = True,
) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text and any more): doc_id, n_words, n_removed, kept_sha256 and,
    with ``keep_text``, the ``kept`` words joined by one space.

    A word goes if it is in a window of ``window`` words whose words also start anywhere else, in the same
    text too. A null or empty text has no word. Rows of one doc_id are documents of their own, and equal
    rows repeat each other. Texts shorter than a window lose nothing; texts of any length count as a
    whole. An empty table gives no rows; further columns are ignored. Words are compared by 64-bit hashes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, digests, kept = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.split()
                stays = np.ones(len(words), bool)
                for s in spans or ():
                    stays[s["first"] : s["first"] + s["n"]] = False
                own = b" ".join([w for w, s in zip(words, stays.tolist()) if s] if spans else words)
                n_words.append(len(words))
                n_removed.append(len(words) - int(stays.sum()))
                digests.append(hashlib.sha256(own).hexdigest())
                kept.append(own.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    spanned = _with_spans(docs, window, run, hot_anchor, shard_words).select("doc_id", "text", "spans")
    out = spanned.mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return out if keep_text else out.drop("kept")
