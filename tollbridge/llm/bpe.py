"""Byte-level BPE by dynamic programming over prefixes.

Encoding a pretoken by merges in order of rank has, for every prefix, a result of its own, and that
result ends in one certain token. For each prefix a suffix automaton of the vocabulary (a trie with
links to the longest proper suffix, Aho-Corasick) gives the tokens that end there; the last token is
the one that is compatible with the last token of the prefix before it. Following these tokens back
from the end gives the ids.

Two neighbouring tokens are compatible if merging their bytes gives just these two. Merges happen in
order of rank, so at the time of a rank the token at the right edge of the left one is known (its
right spine), as is the token at the left edge of the right one. A merge across the boundary happens
if a pair from the two spines has a rank that comes while both are there.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tollbridge.llm.base import slices
from tollbridge.llm.units import UnitCache, special_tokens

#: White space and the split of texts into pretokens, as the byte-level pretokenizer defines them (fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"
PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
NEVER = 1 << 60
#: Pretokens and pairs kept per Python worker.
CACHED_PRETOKENS = 400_000
CACHED_PAIRS = 1_000_000
#: Units, and pretokens and pairs, kept where the encoder is one stage of several in the same Python workers.
TASK_UNITS = 100_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: visible bytes as they are, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixBpe:
    """A byte-level BPE tokenizer file, encoded by the method above."""

    def __init__(self, tokenizer_json: str):
        file = json.loads(tokenizer_json)
        model, before = file["model"], file["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or file["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_letters()
        spelled = {token: bytes(map(letters.__getitem__, token)) for token in model["vocab"] if all(c in letters for c in token)}
        self.specials = special_tokens(tokenizer_json)
        vocab = {token: i for token, i in model["vocab"].items() if token not in self.specials}
        self.bytes_of = {i: spelled[token] for token, i in vocab.items()} | {i: s.encode() for s, i in self.specials.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in merges}
        if len(parts) != len(merges):
            raise ValueError("a token is made by two merges")
        # spines: the tokens at an edge from the whole to the byte, each with the rank of the merge that ends it
        self.right, self.left = {}, {}
        for token in sorted(vocab.values(), key=lambda t: self.rank.get(parts.get(t), -1)):
            a_b = parts.get(token)
            r = self.rank.get(a_b, NEVER)
            self.right[token] = [(token, NEVER)] + ([(a_b[1], r), *self.right[a_b[1]][1:]] if a_b else [])
            self.left[token] = [(token, NEVER)] + ([(a_b[0], r), *self.left[a_b[0]][1:]] if a_b else [])
        self.automaton = ahocorasick.Automaton()
        usable = set()
        for token in sorted(vocab.values(), key=lambda t: self.rank.get(parts.get(t), -1)):
            a_b = parts.get(token)
            if a_b is None or (a_b[0] in usable and a_b[1] in usable and not self._merges_across(*a_b, inner=True)):
                usable.add(token)
                word = self.bytes_of[token]
                self.automaton.add_word(word.decode("latin-1"), (token, len(word)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.cache = UnitCache(self.units, {s: struct.pack("<I", i) for s, i in self.specials.items()})

    def _merges_across(self, a: int, b: int, inner: bool = False) -> bool:
        """Whether a merge crosses the boundary of a|b before they are whole; ``inner`` allows the merge of a and b."""
        for x, x_ends in self.right[a]:
            for y, y_ends in self.left[b]:
                r = self.rank.get((x, y))
                if r is not None and r < x_ends and r <= y_ends and not (inner and x == a and y == b):
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > min(CACHED_PAIRS, self.cache.limit):
                self.pairs.clear()
            known = self.pairs[a, b] = not self._merges_across(a, b)
        return known

    def encode_pretoken(self, word: bytes) -> list[int]:
        """The ids of one pretoken: the last token of every prefix, then back from the end."""
        last, size, pairs = [-1] * (len(word) + 1), [0] * (len(word) + 1), self.pairs
        for end, (token, length) in self.automaton.iter(word.decode("latin-1")):
            at = end + 1
            if size[at]:
                continue
            before = last[at - length]
            if at == length:
                fits = True
            else:
                fits = pairs.get((before, token))
                if fits is None:
                    fits = self.compatible(before, token)
            if fits:
                last[at], size[at] = token, length
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def units(self, units: list[str]) -> list[bytes]:
        if len(self.known) > min(CACHED_PRETOKENS, self.cache.limit):
            self.known.clear()
        known, out = self.known, []
        for unit in units:
            ids = []
            for pretoken in PRETOKEN.findall(unit):
                own = known.get(pretoken)
                if own is None:
                    tokens = self.encode_pretoken(pretoken.encode())
                    own = known[pretoken] = struct.pack(f"<{len(tokens)}I", *tokens)
                ids.append(own)
            out.append(b"".join(ids))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.texts(texts)

    def forget(self) -> None:
        """Drop what is kept of the texts; the tokenizer's own tables stay."""
        self.pairs, self.known = {}, {}
        self.cache.clear()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


_loaded: dict[str, PrefixBpe] = {}


def load(tokenizer_json: str) -> PrefixBpe:
    """The tokenizer of this Python worker; one file at a time."""
    if tokenizer_json not in _loaded:
        _loaded.clear()
        _loaded[tokenizer_json] = PrefixBpe(tokenizer_json)
    return _loaded[tokenizer_json]


@contextmanager
def loaded(tokenizer_json: str) -> Iterator[PrefixBpe]:
    """The tokenizer for one task. What it keeps of the texts is little and ends with the task: the Python
    worker goes on to other stages, beside which it would stay in memory."""
    bpe = load(tokenizer_json)
    usual, bpe.cache.limit = bpe.cache.limit, min(bpe.cache.limit, TASK_UNITS)
    try:
        yield bpe
    finally:
        bpe.cache.limit = usual
        bpe.forget()


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its ids, and the text decoded from them.

    A null or empty text has no ids and decodes to the empty text. The tokenizer file at ``path`` is read
    once on the driver and sent to the tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with loaded(sent.value) as bpe:
            for batch in slices(batches):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in bpe.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digest_texts(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_texts``, but digests in place of ids and text: they are made where the ids are."""
    sent = docs.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(sent.value)
        decimal = {i: str(i) for i in bpe.bytes_of}
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, of_ids, of_text = [], [], []
            for encoded in bpe.encode(texts):
                ids = struct.unpack(f"<{len(encoded) // 4}I", encoded)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
