"""Secret scans: fixed patterns, and two character Markov models against each other.

One model is of random strings, one of ordinary identifiers; each is a table of character pairs.
A run of key characters is a secret if its log-likelihood ratio per character is above the threshold of
its kind: of letters alone or with digits, and of its length. Both are trained from samples that the fixed
patterns label: the values they find are random strings, all other runs of the texts are ordinary. The pair
counts are sums over all documents but a fifth; the runs of that fifth set the thresholds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tollbridge.llm.base import slices

#: Kinds of spans in the order of the report; the last is the models' own.
BASE_KINDS = ("assign", "access", "hex")
MODEL_KIND = "random"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Characters of the models; all others end a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET)
#: Runs that the models judge: of so many characters, a letter among them. Shorter ones say too little.
MIN_RUN = 8
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: Lengths at which the kinds of runs part; each is a kind with digits and one without.
BANDS = (12, 16, 24)
KINDS = 2 * (len(BANDS) + 1)
#: Ordinary runs of a kind that may be taken for random, of the fifth that is held out.
FALSE_PART = 1e-5
#: Mean log-likelihood ratio per character pair that a secret has at least.
FLOOR = 2.0
#: Part of the held-out random values of a kind that its threshold may miss, if there are so many of them.
MISSED_PART, LEAST_VALUES = 0.1, 50
#: Scores are counted in steps of this size between -LIMIT and LIMIT.
STEP, LIMIT = 0.05, 20
#: Pseudo-counts of each character's row, spread as the classes of characters follow each other.
PRIOR = 20.0
_CLASS = np.array([0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in ALPHABET])

_CODE = np.full(256, SIZE, np.int32)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(SIZE)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of the kind, end, kind) of the fixed patterns' spans, leftmost and non-overlapping per kind."""
    spans = []
    low = text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans)


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("latin-1", "replace").replace(b"?", b" "), np.uint8)]


def _pairs(codes: np.ndarray) -> np.ndarray:
    return np.bincount(codes[:-1] * (SIZE + 1) + codes[1:], minlength=(SIZE + 1) ** 2)


def values(text: str) -> list[str]:
    """The random part of each base span, the assigned value or all of it; none twice."""
    out, done = [], -1
    for start, rank, end, _ in base_spans(text):
        if rank == 0:
            start += _ASSIGN.match(text[start:end]).start(2)
        if start > done:
            out.append(text[start:end])
        done = max(done, end - 1)
    return out


def count_pairs(docs: DataFrame) -> DataFrame:
    """(random, pair, n): how often each pair of characters stands in random and in ordinary runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, random = np.zeros((SIZE + 1) ** 2, np.int64), np.zeros((SIZE + 1) ** 2, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    whole += _pairs(_codes(text))
                    for value in values(text):
                        random += _pairs(_codes(value))
        for flag, counts in ((True, random), (False, np.maximum(whole - random, 0))):
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([flag] * len(at), pa.bool_()), pa.array(at, pa.int64()), pa.array(counts[at])], names=["random", "pair", "n"]
            )

    counted = docs.select("text").mapInArrow(run, "random boolean, pair bigint, n bigint")
    return counted.groupBy("random", "pair").agg(F.sum("n").alias("n"))


def _model(counts: np.ndarray) -> np.ndarray:
    """The logarithms of the chances of each character after each, smoothed by those of its class."""
    member = np.eye(4)[_CLASS]
    classes = member.T @ counts @ member + 1.0
    classes /= classes.sum(axis=1, keepdims=True)
    smooth = counts + PRIOR * (member @ (classes / member.sum(axis=0)) @ member.T)
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


class Model(NamedTuple):
    """The log-likelihood ratio of each character pair, random against ordinary; a threshold for each kind of run."""

    ratio: np.ndarray
    thresholds: np.ndarray


def _held_out() -> Column:
    return F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame) -> Model:
    """The models and thresholds from all of ``docs`` (text).

    The tables have a fixed size. Without samples both models are alike and no run is a secret.
    """
    tables = {flag: np.zeros((SIZE, SIZE)) for flag in (True, False)}
    for flag, pair, n in count_pairs(docs.where(~_held_out())).collect():  # at most two rows per pair of characters
        a, b = divmod(pair, SIZE + 1)
        if a < SIZE and b < SIZE:
            tables[flag][a, b] = n
    ratio = _model(tables[True]) - _model(tables[False])
    symbols = _CLASS == 3  # they join words and parts of keys alike
    ratio[symbols] = ratio[:, symbols] = 0.0
    return Model(ratio, _thresholds(count_scores(docs.where(_held_out()), ratio)))


def scored_runs(text: str, ratio: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, score) of each run that the models judge."""
    codes = _codes(text)
    whole = np.zeros((SIZE + 1, SIZE + 1))
    whole[:SIZE, :SIZE] = ratio
    before = np.concatenate([[0.0, 0.0], np.cumsum(whole[codes[:-1], codes[1:]])]) if len(codes) > 1 else np.zeros(2)
    out = []
    for m in _RUN.finditer(text):
        start, end = m.span()
        if _LETTER.search(text, start, end):
            kind = sum(end - start >= b for b in BANDS) * 2 + (_DIGIT.search(text, start, end) is not None)
            out.append((start, end, kind, (before[end] - before[start + 1]) / (end - start - 1)))
    return out


def count_scores(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(random, kind, step, n): how many values and ordinary runs have a score of each step."""
    sent, steps = docs.sparkSession.sparkContext.broadcast(ratio), int(2 * LIMIT / STEP) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, KINDS, steps), np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                own = [(False, r) for r in scored_runs(text, sent.value) if not any(b[0] < r[1] and r[0] < b[2] for b in base)]
                own += [(True, r) for value in values(text) for r in scored_runs(value, sent.value)]
                for random, (_, _, kind, score) in own:
                    counts[int(random), kind, int((min(max(score, -LIMIT), LIMIT) + LIMIT) / STEP)] += 1
        random, kind, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(random.astype(bool)), pa.array(kind), pa.array(step), pa.array(counts[random, kind, step])], names=["random", "kind", "step", "n"]
        )

    counted = docs.select("text").mapInArrow(run, "random boolean, kind bigint, step bigint, n bigint")
    return counted.groupBy("random", "kind", "step").agg(F.sum("n").alias("n"))


def _thresholds(scores: DataFrame) -> np.ndarray:
    """The least score above FLOOR that few enough ordinary runs of the kind reach, or, where that would miss
    too many known values of the kind, the score that misses as many as allowed."""
    steps = int(2 * LIMIT / STEP) + 1
    counts = np.zeros((2, KINDS, steps))
    for random, kind, step, n in scores.collect():  # at most a row per kind and step
        counts[int(random), kind, step] = n
    out = np.full(KINDS, FLOOR)
    for kind in range(KINDS):
        at_least = np.append(np.cumsum(counts[0, kind][::-1])[::-1], 0)
        fits = int(np.argmax(at_least <= FALSE_PART * at_least[0])) * STEP - LIMIT
        known = np.cumsum(counts[1, kind])
        if known[-1] >= LEAST_VALUES:
            fits = min(fits, int(np.searchsorted(known, MISSED_PART * known[-1], "right")) * STEP - LIMIT)
        out[kind] = max(FLOOR, fits)
    return out


def model_spans(text: str, model: Model) -> list[tuple[int, int, int, str]]:
    """Runs that are likelier random than ordinary."""
    return [
        (start, len(BASE_KINDS), end, MODEL_KIND)
        for start, end, kind, score in scored_runs(text, model.ratio) if score > model.thresholds[kind]
    ]


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text), the model fitted on them if none is given.

    ``spans`` is an array of (kind, start, end) by start and kind, in code points, the end exclusive; the
    models' spans that a base span covers are left out. A null or empty text has none. Repeated rows
    come out each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs) if model is None else model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def of(text: str) -> list[dict]:
        base = base_spans(text)
        own = [s for s in model_spans(text, sent.value) if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]
        return [{"kind": kind, "start": start, "end": end} for start, _, end, kind in sorted(base + own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [of(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
