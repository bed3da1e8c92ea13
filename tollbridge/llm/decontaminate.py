"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as sequences of words, in lower case and without punctuation. A test item may be
found with up to k word edits, k a share of its words. Cut into k + 1 pieces, at least one piece of it
is then found exactly: an Aho-Corasick automaton of all pieces reads each document once. Each hit says
where the item would stand; Myers' bit-parallel edit distance over that stretch decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tollbridge.llm.base import join_small, slices
from tollbridge.session import cut_lineage

#: Share of an item's words that may be edited.
EDITS = 0.2
#: Items searched for in one pass over the documents; more take more passes.
ITEMS_PER_PASS = 20_000
_WORDS = re.compile(r"[^\W_]+")


def item_words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def edit_budget(words: int, edits: float = EDITS) -> int:
    return int(words * edits)


def pieces(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """budget + 1 pieces of nearly equal length, each with its place."""
    cuts = [len(words) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """A sequence of words, for Myers' bit-parallel distance to any stretch of a text."""

    def __init__(self, words: list[str]):
        self.size = len(words)
        self.at: dict[str, int] = {}
        for k, word in enumerate(words):
            self.at[word] = self.at.get(word, 0) | 1 << k

    def best(self, text: list[str]) -> tuple[int, int]:
        """The least distance to a stretch of ``text`` and the end of the first such stretch."""
        ones, top, at = (1 << self.size) - 1, 1 << (self.size - 1), self.at
        plus, minus, score = ones, 0, self.size
        best, end = self.size, 0
        for j, word in enumerate(text, 1):
            equal = at.get(word, 0)
            across = (((equal & plus) + plus) ^ plus) | equal | minus
            up, down = minus | (~(across | plus) & ones), plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = up << 1 & ones
            down = down << 1 & ones
            plus, minus = down | (~(equal | minus | up) & ones), up & (equal | minus)
            if score < best:
                best, end = score, j
        return best, end


class Matcher:
    """All items of one pass."""

    def __init__(self, items: list[tuple], edits: float = EDITS):
        self.items, by_piece = [], {}
        for item_id, text in items:
            words = item_words(text)
            if not words:
                continue
            budget = edit_budget(len(words), edits)
            number = len(self.items)
            self.items.append((item_id, Pattern(words), Pattern(words[::-1]), budget))
            for at, piece in pieces(words, budget):
                by_piece.setdefault(" ".join(piece), []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            self.automaton.add_word(f" {piece} ", (len(piece) + 2, places))
        if by_piece:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple]:
        """(item_id, distance, first word, end word) of each item in a text, at its best place."""
        words = item_words(text)
        if not words or not self.items:
            return []
        spaced = f" {' '.join(words)} "
        best: dict[int, tuple[int, int, int]] = {}
        tried = set()
        word_at, done = 0, 0
        hits = sorted((end - size + 1, places) for end, (size, places) in self.automaton.iter(spaced))
        for start, places in hits:
            word_at += spaced.count(" ", done, start)  # words before the piece
            done = start
            for number, at in places:
                item_id, pattern, _, budget = self.items[number]
                begin = word_at - at
                if (number, begin) in tried:
                    continue
                tried.add((number, begin))
                low = max(0, begin - budget)
                distance, end = pattern.best(words[low : begin + pattern.size + budget])
                if distance <= budget and (number not in best or distance < best[number][0]):
                    best[number] = (distance, low, low + end)
        out = []
        for number, (distance, low, end) in sorted(best.items()):
            item_id, _, reverse, _ = self.items[number]
            _, back = reverse.best(words[low:end][::-1])
            out.append((item_id, distance, end - back, end))
        return out


def find_items(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """A row (doc_id, item_id, distance, first_word, end_word) per row of ``docs`` and item found in it.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. The distance is in words, the place in
    words of the text, the end exclusive; of several places the first of the least distance. Items and
    texts that are null or without a word are in nothing. Items with the same text are all reported.
    The items are a stated set: they are numbered, and each pass over the documents searches for a
    block of them, which bounds what a task holds.
    """
    kinds = {"doc_id": docs.schema["doc_id"].dataType, "item_id": benchmark.schema["item_id"].dataType}
    schema = f"doc_id {kinds['doc_id'].simpleString()}, item_id {kinds['item_id'].simpleString()}, distance int, first_word int, end_word int"
    spark = docs.sparkSession
    texts = benchmark.select("item_id", "text")
    passes = max(1, -(-texts.count() // items_per_pass))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    found = None
    for number in range(passes):
        items = texts.where(block == number).collect() if passes > 1 else texts.collect()
        sent = spark.sparkContext.broadcast([tuple(row) for row in items])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, edits)
            for batch in slices(batches):
                ids, places = [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    own = matcher.find(text)
                    ids += [doc_id] * len(own)
                    places += own
                if ids:
                    item, distance, first, end = map(list, zip(*places))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, batch.schema.field("doc_id").type), pa.array(item, item_kind)]
                        + [pa.array(x, pa.int32()) for x in (distance, first, end)],
                        names=["doc_id", "item_id", "distance", "first_word", "end_word"],
                    )

        item_kind = pa.string() if kinds["item_id"].simpleString() == "string" else {"int": pa.int32()}.get(kinds["item_id"].simpleString(), pa.int64())
        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` in whose document no item was found; rows without doc_id stay."""
    leaked = find_items(docs, benchmark, edits).select(F.col("doc_id").alias("_leaked")).where("_leaked IS NOT NULL").distinct()
    leaked = cut_lineage(leaked, "leaked")
    few = leaked.limit(10_001).count() <= 10_000
    return docs.join(F.broadcast(leaked) if few else leaked, docs["doc_id"] == leaked["_leaked"], "left_anti")
