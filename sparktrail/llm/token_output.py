"""Packed token ids: best-fit-decreasing packing and a binary matrix sink.

Texts are encoded with a public byte-pair vocabulary (its path is a
parameter), each document ends with one end token, and documents longer
than a row are split into consecutive pieces without loss.  The pieces of a
chunk (some four million tokens) are packed by best fit decreasing: a
segment tree over the remaining capacities finds the fullest open row that
still has room.  A row keeps its ids, the cumulative lengths of its
segments, where positions restart, and which document piece each segment is.
"""

from __future__ import annotations

import base64
import io
import json
import uuid
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import qualified, shared_dir, table, tune, written
from .warc import _file_system

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
ROW_LENGTH = 2048
CHUNK_TOKENS = 4_000_000
#: Fixed value: the pattern that parts text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts whose ids a worker remembers; the memory is emptied when it is full.
CACHE = 300_000


class Encoder:
    """Ids of a text as little-endian integers; parts that came before are looked up."""

    def __init__(self, ranks: bytes, dtype: str):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})._core_bpe

        class Known(dict):
            def __missing__(self, part: str) -> bytes:
                if len(self) >= CACHE:
                    self.clear()
                ids = self[part] = np.array(core.encode_single_piece(part.encode()), dtype).tobytes()
                return ids

        self.known, self.parts, self.dtype = Known(), regex.compile(PATTERN).findall, dtype

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.parts(text))), self.dtype)


class Capacities:
    """Segment tree over remaining capacities 0..size; a node counts the open rows below it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._change(capacity, 1)

    def best(self, need: int) -> tuple[int, int] | None:
        """Takes out the open row with the least capacity of at least ``need``: (capacity, row)."""
        tree, i = self.tree, need + self.leaves
        if not tree[i]:
            while i & 1 or not tree[i + 1]:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._change(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of piece numbers. Longest pieces first (ties in order), each into the fullest row with room."""
    open_rows, rows = Capacities(size), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[piece]
        found = open_rows.best(n) if n < size else None
        if found:
            capacity, row = found
            rows[row].append(piece)
        else:
            capacity, row = size, len(rows)
            rows.append([piece])
        if capacity > n:
            open_rows.put(capacity - n, row)
    return rows


PACKED = "part int, row long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_nos array<long>, doc_ids array<long>, doc_offsets array<long>"
_PACKED = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_nos", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64()))])


def pack_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, row_length: int = ROW_LENGTH) -> DataFrame:
    """Packed rows of all documents, padded with ``end`` to ``row_length`` ids.

    ``input_ids`` holds ``row_length`` unsigned little-endian integers (two
    bytes while the vocabulary allows, else four).  Segment j of a row is
    input_ids[cu_seqlens[j]:cu_seqlens[j+1]], the piece of document
    doc_ids[j] (number doc_nos[j] of its part) that starts at its token
    doc_offsets[j]; positions restart at position_resets.  Null and empty
    texts are one end token, repeated rows are documents of their own, a null
    id stays null, an empty table gives no rows.
    """
    tune(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        ranks = f.read()
    top = max([end, *(int(line.split()[1]) for line in ranks.splitlines() if line)])
    dtype = "<u2" if top < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(ranks, dtype), TaskContext.get().partitionId()
        pieces, held, done, seen = [], 0, 0, 0

        def flush():
            nonlocal pieces, held, done
            rows = best_fit_decreasing([len(p[3]) for p in pieces], row_length)
            for start in range(0, len(rows), 256):
                out = []
                for r, row in enumerate(rows[start : start + 256], start + done):
                    chosen = [pieces[i] for i in row]
                    ids = np.concatenate([p[3] for p in chosen])
                    ends = np.cumsum([0] + [len(p[3]) for p in chosen])
                    full = np.full(row_length, end, dtype)
                    full[: len(ids)] = ids
                    out.append((part, r, len(ids), full.tobytes(), ends, ends[:-1], [p[0] for p in chosen], [p[1] for p in chosen], [p[2] for p in chosen]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _PACKED, strict=True)], schema=_PACKED)
            done += len(rows)
            pieces, held = [], 0

        last = np.array([end], dtype)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate((encoder.encode(text or ""), last))
                for offset in range(0, len(ids), row_length):
                    pieces.append((seen, doc_id, offset, ids[offset : offset + row_length]))
                seen += 1
                held += len(ids)
                if held >= CHUNK_TOKENS:
                    yield from flush()
        if pieces:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED)


def position_ids(row_length: int, resets: list[int]) -> np.ndarray:
    """Positions of a row: counting from 0 again at every reset."""
    starts = np.zeros(row_length, np.int64)
    starts[resets] = resets
    return np.arange(row_length) - np.maximum.accumulate(starts)


def unpack_tokens(packed: DataFrame, row_length: int = ROW_LENGTH) -> DataFrame:
    """(part, doc_no, doc_id, ids array<int>) of every document, end token included: the exact inverse of packing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["input_ids"], "<u2" if len(row["input_ids"]) == 2 * row_length else "<u4")
                for j, (no, doc_id, offset) in enumerate(zip(row["doc_nos"], row["doc_ids"], row["doc_offsets"], strict=True)):
                    out.append((row["part"], no, doc_id, offset, ids[row["cu_seqlens"][j] : row["cu_seqlens"][j + 1]].astype(np.int32)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["part", "doc_no", "doc_id", "offset", "ids"])

    pieces = packed.mapInArrow(run, "part int, doc_no long, doc_id long, offset long, ids array<int>")
    whole = pieces.groupBy("part", "doc_no", "doc_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("part", "doc_no", "doc_id", F.flatten(F.col("p.ids")).alias("ids"))


#: Columns of a row that go to the index: the others follow from them and the matrix.
_INDEX = ["part", "row", "cu_seqlens", "position_resets", "doc_nos", "doc_ids", "doc_offsets"]


def write_matrices(packed: DataFrame, folder: str, row_length: int = ROW_LENGTH) -> DataFrame:
    """Write rows as raw matrices ``<name>.ids`` with a ``<name>.json`` beside each; returns the manifest of finished files.

    The index has one line per row (cumulative lengths, resets, and where its
    pieces come from), written as the rows come; the whole file is one JSON
    object.  Files that a failed task left behind are not in the manifest.
    """
    tune(packed.sparkSession)
    folder = qualified(packed.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        name, rows = "", 0
        with ExitStack() as files:
            for batch in batches:
                index = zip(*(batch.column(c).to_pylist() for c in _INDEX), strict=True)
                for ids, (part, row, cu, resets, *pieces) in zip(batch.column("input_ids").to_pylist(), index, strict=True):
                    if not name:
                        name = f"{path}/{uuid.uuid4().hex}"
                        matrix, lines = (files.enter_context(system.open_output_stream(f"{name}.{kind}", compression=None)) for kind in ("ids", "json"))
                        lines.write(json.dumps({"row_length": row_length, "id_bytes": len(ids) // row_length})[:-1].encode() + b', "segments": [\n')
                    matrix.write(ids)
                    lines.write((b",\n" if rows else b"") + json.dumps([cu, resets, *pieces, part, row], separators=(",", ":")).encode())
                    rows += 1
            if name:
                lines.write(b'\n], "rows": %d}\n' % rows)
        if name:
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}.ids"]), pa.array([rows], pa.int64())], names=["path", "rows"])

    return written(packed.mapInArrow(run, "path string, rows long"), "matrix-manifest")


class MatrixError(ValueError):
    """A matrix and its index or manifest differ."""


def read_matrices(manifest: DataFrame, folder: str) -> DataFrame:
    """The rows of all matrices in ``manifest``, as ``pack_tokens`` made them; one line of the index is held at a time."""
    tune(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)

        def flush(out):
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _PACKED, strict=True)], schema=_PACKED)

        for batch in batches:
            for name, expected in zip(batch.column("path").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                out, seen = [], 0
                with system.open_input_stream(name, compression=None) as matrix, system.open_input_stream(f"{name.removesuffix('.ids')}.json", compression=None) as source:
                    lines = io.BufferedReader(source, 1 << 20)
                    head = json.loads(lines.readline().rstrip()[:-1] + b"[]}")
                    width = head["row_length"] * head["id_bytes"]
                    for line in lines:
                        if line.startswith(b"]"):
                            tail = json.loads(b"{" + line.lstrip(b"], "))
                            break
                        cu, resets, nos, ids, offsets, part, row = json.loads(line.rstrip(b",\n"))
                        raw = matrix.read(width)
                        if len(raw) != width:
                            raise MatrixError(f"{name}: row {seen} is cut off")
                        out.append((part, row, cu[-1], raw, cu, resets, nos, ids, offsets))
                        seen += 1
                        if len(out) >= 256:
                            yield flush(out)
                            out = []
                    else:
                        raise MatrixError(f"{name}: the index is cut off")
                    if seen != expected or tail["rows"] != expected or matrix.read(1):
                        raise MatrixError(f"{name}: {seen} rows, the manifest has {expected}")
                if out:
                    yield flush(out)

    spread = manifest.repartition(max(1, min(10_000, manifest.count())), "path")
    return spread.mapInArrow(run, PACKED)


def op8_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` as rows of 2,048 ids, into matrices in the shared folder and back."""
    folder = f"{shared_dir(spark)}/matrices-{uuid.uuid4().hex}"
    return read_matrices(write_matrices(pack_tokens(table(spark, sf_dir, "documents")), folder), folder)


QUERIES = {"op8_packed_tokens": op8_packed_tokens}
ORACLES: dict[str, str] = {}
