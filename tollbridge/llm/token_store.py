"""Token ids of documents in a binary file format with a minimal perfect hash index.

The documents are range-partitioned by key and sorted; each partition is a shard, written as blocks of
some megabytes, one table row each:

    shard, block, first_key, last_key, n_docs, n_ids
    keys      int64 of each document in ascending order; the first n_null have none
    offsets   uint64 of each document's first id in the payload, and the end
    seeds     int32 of each hash bucket: a seed, or -(slot + 1) for a bucket of one key
    slots     uint32 triples of each distinct key: fingerprint, first document, documents
    payload   the ids, uint32; all numbers are little-endian

A key's bucket gives a seed, the seed its slot, and the slot's fingerprint says whether the key is
there; so a key is found without a search. As Spark writes the blocks, a lost task leaves none.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tollbridge.llm.base import join_small, slices
from tollbridge.llm.units import UnitCache, special_tokens

BLOCK_BYTES = 8 << 20
#: The letter of the space in a byte-level vocabulary (fixed value), and a unit with its space.
SPACE_LETTER = "Ġ"
UNIT = re.compile(r" \S[^ ]*\Z")
MASK = (1 << 64) - 1
SCHEMA = (
    "shard int, block int, first_key bigint, last_key bigint, n_null int, n_docs int, n_ids bigint, "
    "keys binary, offsets binary, seeds binary, slots binary, payload binary"
)


def mix(key: int, seed: int) -> int:
    """A 64-bit hash of key and seed (the finaliser of splitmix64)."""
    x = (key + (seed + 1) * 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


class PerfectHash:
    """A minimal perfect hash of distinct integers: each has a slot of its own from 0 to n - 1."""

    FINGERPRINT = 1 << 40

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, keys: list[int]) -> PerfectHash:
        """Large buckets first look for a seed that sends all their keys to free slots; single keys take what is left."""
        n = len(keys)
        buckets: list[list[int]] = [[] for _ in range((n + 1) // 2)]
        for key in keys:
            buckets[mix(key, 0) % len(buckets)].append(key)
        seeds, taken = np.zeros(len(buckets), "<i4"), bytearray(n)
        single = []
        for b in sorted(range(len(buckets)), key=lambda i: -len(buckets[i])):
            own = buckets[b]
            if len(own) == 1:
                single.append(b)
            seed = 0
            while len(own) > 1:
                seed += 1
                slots = {mix(key, seed) % n for key in own}
                if len(slots) == len(own) and not any(taken[s] for s in slots):
                    for s in slots:
                        taken[s] = 1
                    seeds[b] = seed
                    break
        free = (s for s in range(n) if not taken[s])
        for b in single:
            seeds[b] = -next(free) - 1
        return cls(seeds, n)

    def slot(self, key: int) -> int:
        seed = int(self.seeds[mix(key, 0) % len(self.seeds)])
        return -seed - 1 if seed < 0 else mix(key, seed) % self.n

    @classmethod
    def fingerprint(cls, key: int) -> int:
        return mix(key, cls.FINGERPRINT) >> 32


def pack_block(keys: list[int | None], ids: list[bytes]) -> dict:
    """The index and payload of one block; ``keys`` ascend, those without a value come first."""
    n_null = sum(k is None for k in keys)
    known = keys[n_null:]
    distinct = list(dict.fromkeys(known))
    index = PerfectHash.build(distinct)
    slots = np.zeros((len(distinct), 3), "<u4")
    first, count = {}, {}
    for at, key in enumerate(known, n_null):
        first.setdefault(key, at)
        count[key] = count.get(key, 0) + 1
    for key in distinct:
        slots[index.slot(key)] = PerfectHash.fingerprint(key), first[key], count[key]
    offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]).astype("<u8")
    return {
        "first_key": known[0] if known else None, "last_key": known[-1] if known else None, "n_null": n_null, "n_docs": len(keys),
        "n_ids": int(offsets[-1]), "keys": np.array([k or 0 for k in keys], "<i8").tobytes(), "offsets": offsets.tobytes(),
        "seeds": index.seeds.tobytes(), "slots": slots.tobytes(), "payload": b"".join(ids),
    }


class Block:
    """A block read back."""

    def __init__(self, row: dict):
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.n_null = row["n_null"]
        self.offsets = np.frombuffer(row["offsets"], "<u8").astype(np.int64)
        self.slots = np.frombuffer(row["slots"], "<u4").reshape(-1, 3)
        self.index = PerfectHash(np.frombuffer(row["seeds"], "<i4"), len(self.slots))
        self.payload = memoryview(row["payload"])

    def find(self, key: int) -> range:
        """The documents of a key; none if the fingerprint in its slot is another's."""
        if not len(self.slots):
            return range(0)
        fingerprint, first, count = self.slots[self.index.slot(key)].tolist()
        return range(first, first + count) if fingerprint == PerfectHash.fingerprint(key) else range(0)

    def ids(self, doc: int) -> memoryview:
        return self.payload[4 * self.offsets[doc] : 4 * self.offsets[doc + 1]]

    def documents(self) -> Iterator[tuple[int | None, int]]:
        """Each document's key and place, the places of keys by the index."""
        yield from ((None, doc) for doc in range(self.n_null))
        for key in dict.fromkeys(self.keys[self.n_null :].tolist()):
            yield from ((key, doc) for doc in self.find(key))


_cache: dict[str, UnitCache] = {}


def library_cache(tokenizer_json: str) -> UnitCache:
    """The tokenizers library behind a cache of units, one file per Python worker."""
    if tokenizer_json not in _cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        if json.loads(tokenizer_json)["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a byte-level tokenizer file")
        specials = special_tokens(tokenizer_json)
        if any(" " in s for s in specials):
            raise ValueError("an added token holds a space")
        starts = np.zeros(1 + max(tokenizer.get_vocab().values()), bool)
        starts[[i for token, i in tokenizer.get_vocab().items() if token.startswith(SPACE_LETTER)]] = True

        def encode(units: list[str]) -> list[bytes]:
            """Units are one text for the library: a token begins with the space's letter just where a unit begins."""
            if not units or not all(map(UNIT.match, units)):
                whole = tokenizer.encode_batch_fast(units, add_special_tokens=False)
                return [np.array(e.ids, "<u4").tobytes() for e in whole]
            ids = np.array(tokenizer.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.append(np.flatnonzero(starts[ids]), len(ids))).tolist()
            packed = ids.tobytes()
            return [packed[a:b] for a, b in zip(ends, ends[1:])]

        _cache.clear()
        _cache[tokenizer_json] = UnitCache(encode, {s: np.array([i], "<u4").tobytes() for s, i in specials.items()})
    return _cache[tokenizer_json]


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 0, block_bytes: int = BLOCK_BYTES) -> None:
    """Write the ids of ``docs`` (doc_id, an integer, and text) to ``path``, ``end_id`` after each document.

    Documents come in ascending doc_id, those without one first; rows of one doc_id by their texts'
    hashes, so that even a key with most of the rows is dealt over many shards. A null text is empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shard, number = library_cache(sent.value), TaskContext.get().partitionId(), 0
        keys, ids, size = [], [], 0

        def block() -> pa.RecordBatch:
            row = {"shard": shard, "block": number} | pack_block(keys, ids)
            return pa.RecordBatch.from_pylist([row], schema=arrow_schema)

        for batch in slices(batches):
            own = cache.texts([t or "" for t in batch.column("text").to_pylist()])
            for key, encoded in zip(batch.column("doc_id").to_pylist(), own):
                keys.append(key)
                ids.append(encoded + end)
                size += len(encoded) + 4
                if size >= block_bytes:
                    yield block()
                    keys, ids, size, number = [], [], 0, number + 1
        if keys:
            yield block()

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    arrow_schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and the crc32 of its ids, as they stand in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            block, out = Block(row), []
            for key, doc in block.documents():
                ids = block.ids(doc)
                out.append((row["shard"], row["block"], key, int(block.offsets[doc]), len(ids) // 4, zlib.crc32(ids)))
            columns = zip(*out)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"]
            )

    blocks = spark.read.schema(SCHEMA).parquet(path)
    found = blocks.mapInArrow(run, "shard int, block int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    joined = join_small(found, block_starts(blocks), ["shard", "block"], "inner")
    return joined.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def block_starts(blocks: DataFrame) -> DataFrame:
    """The ids before each block: those of earlier shards, and of earlier blocks of its shard."""
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    shards = shards.select("shard", before(Window.orderBy("shard")).alias("shard_start"))
    own = blocks.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("block_start"))
    return own.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("start"))


def lookup(spark: SparkSession, path: str, keys: Iterable[int]) -> DataFrame:
    """The ids of the documents with these keys, a list held by the driver; unknown keys have no row.

    Only blocks whose range holds a key are opened.
    """
    wanted = np.unique(np.array(list(keys), dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            low, high = np.searchsorted(wanted, row["first_key"]), np.searchsorted(wanted, row["last_key"], "right")
            if low < high:
                block = Block(row)
                out = [(key, np.frombuffer(block.ids(d), "<u4").tolist()) for key in wanted[low:high].tolist() for d in block.find(key)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in out], pa.int64()), pa.array([i for _, i in out], pa.list_(pa.int64()))], names=["doc_id", "ids"]
                )

    blocks = spark.read.schema(SCHEMA).parquet(path).where("first_key IS NOT NULL")
    if len(wanted):
        blocks = blocks.where((F.col("first_key") <= int(wanted[-1])) & (F.col("last_key") >= int(wanted[0])))
    return blocks.mapInArrow(run, "doc_id bigint, ids array<bigint>")
