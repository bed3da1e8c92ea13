"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is the vector of its hashed letter n-grams (one to three bytes of its lower-case letters, one
space between words), each count as 1 + log, times the inverse document frequency over all training
documents, scaled to length one. The vectors of a bounded sample of each language are clustered
(spherical k-means); a text gets the language of the centroid with the highest cosine. Below the
cosine that nearly all of the centroid's own documents reach, it is rejected: the language is then a guess.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tollbridge.llm.base import slices

BINS = 1 << 13
CENTROIDS = 4
ROUNDS = 12
#: Documents per language that are clustered, by the hash of their doc_id; about so many if there are more.
SAMPLE = 800
#: The model grows with the languages and is sent to all tasks; more are an error.
MAX_LANGUAGES = 1_000
#: Share of a centroid's own documents that lie farther away than texts that are accepted.
REJECTED_SHARE = 0.005
UNKNOWN = "und"
_CHUNK = 1 << 20
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram stands in the text."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    total = np.zeros(BINS, np.int64)
    for at in range(0, len(data), _CHUNK):
        one = np.frombuffer(data[at : at + _CHUNK + 2], np.uint8).astype(np.uint32)
        grams = [one[:_CHUNK], one[:-1] << np.uint32(8) | one[1:]]
        grams.append(grams[1][:-1] << np.uint32(8) | one[2:])
        grams[1] = grams[1][:_CHUNK]
        for n, gram in enumerate(grams):
            mixed = (gram + np.uint32(n << 24)) * np.uint32(2654435761)
            total += np.bincount(mixed >> np.uint32(19), minlength=BINS)
    return total


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    tf = counts(text)
    weights = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    length = np.linalg.norm(weights)
    return (weights / length if length else weights).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """The idf of each bin over all of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BINS + 1, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                if has_letter(text):
                    seen[:BINS] += counts(text) > 0
                    seen[BINS] += 1
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], names=["bin", "n"])

    rows = texts.select("text").mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(BINS + 1)
    for number, n in rows:  # one row per bin
        seen[number] = n
    return np.log((seen[BINS] + 1) / (seen[:BINS] + 1)) + 1


def cluster(vectors: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Up to k centroids of length one, and the cosine that all but a small share of each one's documents reach."""
    mean = vectors.mean(axis=0)
    centres = [mean / (np.linalg.norm(mean) or 1)]
    while len(centres) < min(k, len(vectors)):
        nearest = (vectors @ np.stack(centres).T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        centres.append(vectors[nearest.argmin()])
    centres = np.stack(centres)
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(axis=1)
        centres = np.stack([vectors[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    cosines = vectors @ centres.T
    own = cosines.argmax(axis=1)
    used = [c for c in range(len(centres)) if (own == c).any()]
    reach = [np.quantile(cosines[own == c, c], REJECTED_SHARE) for c in used]
    return centres[used].astype(np.float32), np.array(reach)


def fit(docs: DataFrame) -> dict:
    """The model from ``docs`` (doc_id, text, lang): held-out documents and those without lang teach nothing."""
    training = _training(docs)
    idf = inverse_frequencies(training)
    sizes = {lang: n for lang, n in training.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    if not sizes:
        return {"idf": idf, "langs": [], "centres": np.zeros((0, BINS), np.float32), "reach": np.zeros(0)}
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, SAMPLE / n)]), F.col("lang"))
    chosen = training.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(lang, vector(t, idf).tobytes()) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.binary())], names=["lang", "v"])

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        made, reach = cluster(np.stack([np.frombuffer(v, np.float32) for v in group["v"].sort_values()]))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "k": range(len(made)), "v": [c.tobytes() for c in made], "reach": reach})

    sampled = chosen.select("lang", "text").mapInArrow(vectors, "lang string, v binary")
    rows = sampled.groupBy("lang").applyInPandas(centres, "lang string, k int, v binary, reach double").orderBy("lang", "k").collect()
    return {
        "idf": idf, "langs": [r.lang for r in rows], "reach": np.array([r.reach for r in rows]),
        "centres": np.stack([np.frombuffer(r.v, np.float32) for r in rows]) if rows else np.zeros((0, BINS), np.float32),
    }


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 to 1) and rejected for every row of ``docs`` (doc_id, text).

    Texts that are null or without a letter, and all texts if nothing was learned, are ``und`` with score
    0, rejected. Of equal cosines the first language wins. Repeated rows come out each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches):
            langs, scores, rejected = [], [], []
            for text in batch.column("text").to_pylist():
                if not model["langs"] or not has_letter(text):
                    langs.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                cosines = model["centres"] @ vector(text, model["idf"])
                best = int(cosines.argmax())
                langs.append(model["langs"][best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
                rejected.append(bool(cosines[best] < model["reach"][best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
