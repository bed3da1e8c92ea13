"""Fill-in-the-middle transformation by secondary sort.

A map task cuts each text into units, chooses the two cuts, and emits the output as pieces of some units,
keyed by document and output position. Documents are dealt over the partitions by key and sorted by
output position there, so that a task streams the pieces through incremental digests and holds one batch
of them. Reading that output back, it finds the markers, knows from them which part of the text a piece
is, and hands it on with its place in the text. A second sort inside the same partitions, without a
shuffle, brings the pieces into the order of the text, which is digested, or put together, as it comes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tollbridge.llm.base import slices

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: The place of each part in the text.
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
FIM_PERCENT = 90
SPM_PERCENT = 20
#: Units of text in one piece at most.
PIECE_UNITS = 1_000
SPLIT_MARKERS = re.compile("(<[PSM]>)")
KEY = ["doc_id", "text_hash"]
END = 1 << 30


def unit_ends(text: str) -> np.ndarray:
    """Where each unit ends, in code points: a run of A-Z and a-z, or any other single character."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    lower = points | 32
    letter = (lower >= 97) & (lower <= 122) & (points < 128)
    inside = letter[:-1] & letter[1:]
    return np.append(np.flatnonzero(~inside) + 1, len(points)) if len(points) else np.zeros(0, np.int64)


def choose(doc_id, text: str, n: int) -> tuple[str, int, int]:
    """Form, and the units after which prefix and middle end; a null id hashes like an empty one."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= FIM_PERCENT:
        return "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < SPM_PERCENT else "psm"), a, b


def pieces(doc_id, text: str, piece_units: int = PIECE_UNITS) -> tuple[dict, list[str]]:
    """What is known of a document, and its output in pieces; a marker stands at the start of a piece."""
    ends = unit_ends(text)
    n = len(ends)
    form, a, b = choose(doc_id, text, n)
    at = np.append(0, ends)

    def cut(first: int, last: int) -> list[str]:
        marks = at[[*range(first, last, piece_units), last]].tolist()
        return [text[i:j] for i, j in zip(marks, marks[1:])]

    if form == "plain":
        return {"n": n, "form": form, "prefix_chars": None, "middle_chars": None}, cut(0, n) or [""]
    parts = {PREFIX: cut(0, a), MIDDLE: cut(a, b), SUFFIX: cut(b, n)}
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    out = []
    for marker in order:
        own = parts[marker] or [""]
        out += [marker + own[0], *own[1:]]
    return {"n": n, "form": form, "prefix_chars": int(at[a]), "middle_chars": int(at[b] - at[a])}, out


PIECE = pa.schema([
    ("text_hash", pa.string()), ("pos", pa.int32()), ("copies", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
    ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("piece", pa.string()),
])
PLACED = pa.schema([
    ("text_hash", pa.string()), ("pos", pa.int64()), ("copies", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
    ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("piece", pa.string()), ("output_sha256", pa.string()),
])
DONE = pa.schema([
    ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("restored", pa.string()),
])
KINDS = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint"}
HEAD = ("n", "form", "prefix_chars", "middle_chars")


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {KINDS[f.type]}" for f in schema)


def _batch(ids: list, rows: list[tuple], id_type: pa.DataType, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    arrays = [pa.array(ids, id_type)] + [pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema([("doc_id", id_type), *schema]))


def output_pieces(docs: DataFrame, piece_units: int = PIECE_UNITS) -> DataFrame:
    """The output of each row of ``docs`` (doc_id, text) as pieces in the positions ``pos``.

    A null text is empty; an empty one is a single empty piece. Equal rows of one batch are one row's
    pieces with their number in ``copies``, so that even many equal rows are few pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id")
            seen: dict[tuple, list[int]] = {}
            for i in range(batch.num_rows):
                digest = hashlib.md5((texts[i].as_py() or "").encode()).hexdigest()
                seen.setdefault((doc_ids[i].as_py(), digest), []).append(i)
            ids, rows, size = [], [], 0
            for (doc_id, digest), at in seen.items():
                known, out = pieces(doc_id, texts[at[0]].as_py() or "", piece_units)
                head = tuple(known[c] for c in HEAD)
                for pos, piece in enumerate(out):
                    ids.append(doc_id)
                    rows.append((digest, pos, len(at), *head, piece))
                    size += len(piece)
                    if size > 4 << 20:
                        yield _batch(ids, rows, doc_ids.type, PIECE)
                        ids, rows, size = [], [], 0
            if rows:
                yield _batch(ids, rows, doc_ids.type, PIECE)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_ddl(PIECE)}")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in slices(batches, 1_000):
        yield from zip(*[column.to_pylist() for column in batch.columns])


def _without_copies(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted pieces, those of equal rows once; the first piece of a document counts the rows."""
    held = None
    for row in rows:
        if held is not None and row[:3] == held[:3]:
            held = (*held[:3], held[3] + row[3], *held[4:])
            continue
        if held is not None:
            yield held
        held = row
    if held is not None:
        yield held


def digest_output(sorted_pieces: DataFrame) -> DataFrame:
    """Streams pieces in output order: hands each on with its place in the text, then the output's digest."""
    kind = sorted_pieces.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        id_type = first.schema.field("doc_id").type
        ids, rows, size = [], [], 0

        def put(doc_id, row):
            nonlocal size
            ids.append(doc_id)
            rows.append(row)
            size += len(row[7] or "")

        def chained():
            yield first
            yield from batches

        key, sha, last, place, at = None, None, None, 0, 0
        for row in _without_copies(_rows(chained())):
            doc_id, digest, _, copies, n, form, prefix, middle, piece = row
            if (doc_id, digest) != key:
                if key is not None:
                    put(last[0], (*last[1], sha.hexdigest()))
                key, sha, place, at = (doc_id, digest), hashlib.sha256(), 0, 0
                last = (doc_id, (digest, END * 3, copies, n, form, prefix, middle, None))
            sha.update(piece.encode())
            for part in [piece] if form == "plain" else SPLIT_MARKERS.split(piece):
                if form != "plain" and part in PLACE:
                    place = PLACE[part]
                elif part:
                    put(doc_id, (digest, END * place + at, None, None, None, None, None, part, None))
                    at += 1
            if size > 4 << 20:
                yield _batch(ids, rows, id_type, PLACED)
                ids.clear(), rows.clear()
                size = 0
        if key is not None:
            put(last[0], (*last[1], sha.hexdigest()))
        yield _batch(ids, rows, id_type, PLACED)

    return sorted_pieces.mapInArrow(run, f"doc_id {kind}, {_ddl(PLACED)}")


def digest_restored(placed: DataFrame, keep_text: bool = False) -> DataFrame:
    """Streams pieces in the order of the text; a document's row comes with its last entry."""
    kind = placed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, id_type, sha, text = [], [], None, hashlib.sha256(), []
        for batch in slices(batches, 1_000):
            id_type = batch.schema.field("doc_id").type
            for doc_id, _, _, copies, *head, piece, output in zip(*[c.to_pylist() for c in batch.columns]):
                if piece is not None:
                    sha.update(piece.encode())
                    if keep_text:
                        text.append(piece)
                    continue
                row = (*head, output, sha.hexdigest(), "".join(text) if keep_text else None)
                for _ in range(copies):
                    ids.append(doc_id)
                    rows.append(row)
                    if len(rows) >= 1_000:
                        yield _batch(ids, rows, id_type, DONE)
                        ids, rows = [], []
                sha, text = hashlib.sha256(), []
        if rows:
            yield _batch(ids, rows, id_type, DONE)

    done = placed.mapInArrow(run, f"doc_id {kind}, {_ddl(DONE)}")
    return done if keep_text else done.drop("restored")


def fill_in_middle(docs: DataFrame, piece_units: int = PIECE_UNITS, keep_text: bool = False) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text and any more): n, form, prefix_chars, middle_chars, and the
    digests of the output and of the text restored from output and form; ``keep_text`` adds that text.

    A null text is empty and plain. Rows of one doc_id are documents of their own; equal ones give equal
    rows. A text of any length is streamed in pieces, only a single unit is never cut. An empty table
    gives no rows; further columns are ignored.
    """
    placed = output_pieces(docs, piece_units).repartition(*KEY)
    read = digest_output(placed.sortWithinPartitions(*KEY, "pos"))
    return digest_restored(read.sortWithinPartitions(*KEY, "pos"), keep_text)


def output_text(docs: DataFrame, piece_units: int = PIECE_UNITS) -> DataFrame:
    """doc_id and the whole ``output``, one row per row of ``docs``: for tables whose single outputs fit a row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            out = ["".join(pieces(i, t or "", piece_units)[1]) for i, t in zip(ids.to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], names=["doc_id", "output"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, output string")
