"""Document scoring by prediction by partial matching (PPM).

The model is a trie of byte contexts up to five bytes, counted over every
training document.  The next byte is predicted from the longest known
context; an unseen byte escapes to the context one byte shorter, from which
the bytes already ruled out are excluded (escape method D: n symbols, d of
them different, leave d/2n to the escape).  Texts are lower-cased (A-Z),
start after five boundary symbols and end with one.

The trie is pretrained and frozen, so a byte's code length is a function of
its six-gram.  That keeps everything distributed: no model is broadcast.

1. Texts are dealt, in pieces of some megabytes that end between words, into
   batches of some 8 MB.  A batch keeps its pieces and lists its distinct
   six-grams and words, with their training counts, by buckets: a six-gram by
   its last three context bytes, a word by its hash.  There is a bucket for
   every ``BUCKET_BYTES`` of text.
2. A bucket adds up the counts of all batches.  It then holds all of the trie
   under its three-byte contexts, at most 257^3 six-grams under each.  The
   counts of two-byte contexts are summed over all buckets (at most 257 for
   each of 257^2 contexts) and those that a bucket needs are joined to it.
   Orders one and zero come from a table of 257 x 257 counts.  With these each
   six-gram's code length is fixed.
3. The lists stream past their bucket's code lengths, and each batch gets
   back the values of just the keys it listed, and scores its pieces with
   them.  A bucket whose lists are larger than ``PART_BYTES`` is split, and
   only its code lengths are repeated for each part, so what is shuffled
   stays in proportion to the input.

Words and their counts (for the unigram baseline) travel the same way, as
63-bit hashes.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, discard, id_crc, mix64, table, text_bytes, tune, written
from .minhash import word_hashes

ORDER = 5
SYMBOLS, BITS = 257, 9
BOUNDARY = 256
LONGEST, SHORTER = 0.3, 0.5
BATCH_BYTES, SLICE_BYTES, PIECE_BYTES = 8 << 20, 1 << 20, 2 << 20
#: Text for each bucket, and bytes of lists that one task adds up or answers.
BUCKET_BYTES, PART_BYTES = 32 << 20, 64 << 20
#: Listed keys that are merged at once, and lists that are always added up in one task.
MERGED, FAN_IN = 1 << 20, 16
WORD_FLAG = np.uint64(1 << 63)
END = np.uint64(2**64 - 1)


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (BITS * (order + 1))) - 1)


SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Piece(NamedTuple):
    """Part of a text that ends between words: the bytes, up to five bytes before them, and whether the text ends here."""

    text: bytes
    head: bytes = b""
    last: bool = True


def pieces_of(text: bytes) -> Iterator[Piece]:
    """The text in pieces of about ``PIECE_BYTES``; only a word that is longer makes a piece longer."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        gap = SPACE.search(text, at + PIECE_BYTES)
        if not gap:
            break
        yield Piece(text[at : gap.end()], text[max(0, at - ORDER) : at], False)
        at = gap.end()
    yield Piece(text[at:], text[max(0, at - ORDER) : at])


def grams(pieces: list[Piece]) -> np.ndarray:
    """The packed six-gram of every byte and of the end of each text, piece after piece."""
    sizes = np.array([len(p.text) for p in pieces], np.int64)
    blocks = sizes + ORDER + np.array([p.last for p in pieces], np.int64)
    begin = np.cumsum(blocks) - blocks
    symbols = np.full(int(blocks.sum()), BOUNDARY, np.uint64)
    data = np.frombuffer(b"".join(p.text for p in pieces).translate(LOWER), np.uint8)
    symbols[np.arange(len(data)) + np.repeat(begin + ORDER - (np.cumsum(sizes) - sizes), sizes)] = data
    for at, p in zip(begin.tolist(), pieces, strict=True):
        if p.head:
            symbols[at + ORDER - len(p.head) : at + ORDER] = np.frombuffer(p.head.translate(LOWER), np.uint8)
    out = np.zeros(max(0, len(symbols) - ORDER), np.uint64)
    for j in range(ORDER + 1):
        out |= symbols[j : len(symbols) - ORDER + j] << np.uint64(BITS * (ORDER - j))
    keep = np.ones(len(out), bool)
    for k in range(ORDER):  # what stands before a piece is not predicted
        keep[begin[1:] + k - ORDER] = False
    return out[keep]


def _slices(pieces: list[Piece]) -> Iterator[slice]:
    start, size = 0, 0
    for i, p in enumerate(pieces):
        if i > start and size + len(p.text) > SLICE_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += len(p.text)
    if pieces:
        yield slice(start, len(pieces))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = pc.value_counts(pa.array(keys))
    return found.field("values").to_numpy(zero_copy_only=False), found.field("counts").to_numpy(zero_copy_only=False)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every, weight = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)


class Sum:
    """Sorted keys and summed counts of lists that come one by one; no more than ``MERGED`` listed keys wait to be merged."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > max(MERGED, len(self.keys[0])):
            keys, counts = self.result()
            self.keys, self.counts, self.waiting = [keys], [counts], 0

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return merged(self.keys, self.counts)


def text_keys(pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Six-grams of all pieces, word keys with an end token after each text, and the number of tokens of each piece."""
    words, first = word_hashes([p.text for p in pieces])
    ends = np.array([p.last for p in pieces], np.int64)
    n = np.diff(first)
    tokens = np.full(len(words) + int(ends.sum()), END, np.uint64)
    tokens[np.arange(len(words)) + np.repeat(np.cumsum(ends) - ends, n)] = words | WORD_FLAG
    return grams(pieces), tokens, n + ends


def batch_keys(pieces: list[Piece], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a batch with their counts in its training texts."""
    total = Sum()
    for part in _slices(pieces):
        chosen = train[part]
        g, w, n = text_keys(pieces[part])
        sizes = np.array([len(p.text) + p.last for p in pieces[part]])
        for values, flags in ((g, np.repeat(chosen, sizes)), (w, np.repeat(chosen, n))):
            for flag in (True, False):
                k, c = _counted(values[flags == flag])
                total.add(k, c.astype(np.int64) if flag else np.zeros(len(k), np.int64))
    return total.result()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    context = (keys >> np.uint64(BITS)) & np.uint64((1 << 3 * BITS) - 1)
    return (mix64(np.where(keys >= WORD_FLAG, keys, context)) % np.uint64(buckets)).astype(np.int64)


_packer, _unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, byte plane after byte plane."""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return _packer.compress(planes.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacker.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _squeeze(values: np.ndarray) -> bytes:
    return _packer.compress(values.tobytes())


def _values(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(_unpacker.decompress(blob), kind)


def _find(table_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table_keys):
        return np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(table_keys, keys), len(table_keys) - 1)
    return np.where(table_keys[at] == keys, values[at], 0)


class _Level:
    """One order of the trie: symbols under their contexts, as sorted packed keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        contexts = keys >> np.uint64(BITS)
        self.first = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.contexts = contexts[self.first]
        self.total = np.add.reduceat(counts, self.first) if len(keys) else np.zeros(0, np.int64)
        self.kinds = np.diff(np.append(self.first, len(keys)))


def code_lengths(keys: np.ndarray, counts: np.ndarray, triples: tuple[np.ndarray, np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each six-gram's last symbol.

    ``keys``: all six-grams whose last three context bytes are in this
    bucket, counts 0 where no training text has them.  ``triples``: the
    order-two trie under the keys' last two context bytes, as sorted keys and
    counts, and ``pairs``: 257 x 257 counts of the order-one trie, both of
    the whole training corpus.
    """
    log = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    known = counts > 0
    above: _Level | None = None
    order_one = np.flatnonzero(pairs.ravel())
    for order in range(ORDER, -1, -1):
        if order >= 3:
            level = _Level(*merged([keys[known] & _mask(order)], [counts[known]]))
        elif order == 2:
            level = _Level(*triples)
        elif order == 1:
            level = _Level(((order_one // SYMBOLS << BITS) | order_one % SYMBOLS).astype(np.uint64), pairs.ravel()[order_one])
        else:
            zero = pairs.sum(axis=0)
            level = _Level(np.flatnonzero(zero).astype(np.uint64), zero[zero > 0])
        symbol = keys & _mask(order)
        context = symbol >> np.uint64(BITS)
        n = _find(level.keys, level.counts, symbol).astype(float)
        total = _find(level.contexts, level.total, context).astype(float)
        kinds = _find(level.contexts, level.kinds, context).astype(float)
        if above is not None and len(above.keys):  # exclusion: what the longer context has can't come any more
            shorter = _find(level.keys, level.counts, above.keys & _mask(order))
            out = np.add.reduceat(shorter, above.first)
            longer = (keys & _mask(order + 1)) >> np.uint64(BITS)
            total -= _find(above.contexts, out, longer)
            kinds -= _find(above.contexts, above.kinds, longer)
        hit = open_ & (n > 0)
        discount = LONGEST if order == ORDER else SHORTER
        log[hit] += np.log10((n[hit] - discount) / total[hit])
        escape = open_ & ~hit & (kinds > 0)
        log[escape] += np.log10(kinds[escape] * discount / total[escape])
        open_ &= ~hit
        above = level
    log[open_] -= np.log10(SYMBOLS - len(above.keys))
    return log


LISTED = "kind int, batch string, bucket int, n long, one binary, two binary"
_LISTED = pa.schema([("kind", pa.int32()), ("batch", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("one", pa.binary()), ("two", pa.binary())])
_STORED = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("text", pa.binary()), ("head", pa.binary()), ("last", pa.bool_())])


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _list(buckets: int):
    """Kind 0: the pieces of a batch. Kind 1: keys and counts of a batch in a bucket."""

    def finish(rows):
        name = uuid.uuid4().hex
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, _STORED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(_batch(_STORED, [(row, i, t, p.text, p.head, p.last) for row, i, t, p in rows]))
        keys, counts = batch_keys([p for *_, p in rows], np.array([t for _, _, t, _ in rows], bool))
        yield _batch(_LISTED, [(0, name, -1, len(rows), sink.getvalue(), None)])
        bucket = bucket_of(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(cut)).tolist():
            at = order[cut[b] : cut[b + 1]]
            out.append((1, name, b, len(at), _pack(keys[at]), _squeeze(counts[at])))
            if len(out) == 64:
                yield _batch(_LISTED, out)
                out = []
        if out:
            yield _batch(_LISTED, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, rows, size = uuid.uuid4().hex, 0, [], 0
        for batch in batches:
            for i, t, x in zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), text_bytes(batch.column("text")), strict=True):
                number += 1
                for piece in pieces_of(x):
                    rows.append((f"{task}:{number}", i, bool(t), piece))
                    size += len(piece.text)
                    if size >= BATCH_BYTES:
                        yield from finish(rows)
                        rows, size = [], 0
        if rows:
            yield from finish(rows)

    return run


LISTS = "bucket int, one binary, two binary"
_LISTS = pa.schema([("bucket", pa.int32()), ("one", pa.binary()), ("two", pa.binary())])
TOTALS = "bucket int, one binary, two binary, tokens long, kinds long"
_TOTALS = pa.schema([*_LISTS, ("tokens", pa.int64()), ("kinds", pa.int64())])
TRIPLES = "bucket int, triple int, n long"
_ANSWERS = pa.schema([("batch", pa.string()), ("bucket", pa.int32()), ("values", pa.binary()), ("counts", pa.binary())])


def _added(group: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    total = Sum()
    for one, two in zip(group.column("one"), group.column("two"), strict=True):
        total.add(_unpack(one.as_py()), _values(two.as_py(), np.int64))
    return group.column("bucket")[0].as_py(), *total.result()


def _add(group: pa.Table) -> pa.Table:
    bucket, keys, counts = _added(group)
    return _table(_LISTS, [(bucket, _pack(keys), _squeeze(counts))])


def _total(group: pa.Table) -> pa.Table:
    bucket, keys, counts = _added(group)
    words = counts[int(np.searchsorted(keys, WORD_FLAG)) :]
    return _table(_TOTALS, [(bucket, _pack(keys), _squeeze(counts), int(words.sum()), int((words > 0).sum()))])


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The order-two counts of each bucket's six-grams, 0 where no training text has them."""
    for batch in batches:
        for b, one, two in zip(batch.column("bucket").to_pylist(), batch.column("one"), batch.column("two"), strict=True):
            keys, counts = _unpack(one.as_py()), _values(two.as_py(), np.int64)
            split = int(np.searchsorted(keys, WORD_FLAG))
            triples, n = merged([keys[:split] & _mask(2)], [counts[:split]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), b, np.int32)), pa.array(triples.astype(np.int32)), pa.array(n)], names=["bucket", "triple", "n"])


def _code(pairs: np.ndarray):
    def run(totals: pa.Table, contexts: pa.Table) -> pa.Table:
        """Code lengths in place of a bucket's six-gram counts; the words' counts stay."""
        rows = []
        if totals.num_rows:
            keys, counts = _unpack(totals.column("one")[0].as_py()), _values(totals.column("two")[0].as_py(), np.int64)
            split = int(np.searchsorted(keys, WORD_FLAG))
            under = contexts.column("under").combine_chunks().flatten()
            triples = merged([under.field("triple").to_numpy(zero_copy_only=False).astype(np.uint64)], [under.field("n").to_numpy(zero_copy_only=False).astype(np.int64)])
            values = code_lengths(keys[:split], counts[:split], triples, pairs).astype(np.float32)
            rows.append((totals.column("bucket")[0].as_py(), _pack(keys), _squeeze(values), _squeeze(counts[split:])))
        return _table(_CODED, rows)

    return run


CODED = "bucket int, one binary, two binary, three binary"
_CODED = pa.schema([*_LISTS, ("three", pa.binary())])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and part, the bucket's values first: a list is answered as it passes, and only one bucket's values are held."""
    keys = values = counts = None
    for batch in batches:
        rows, size = [], 0
        cols = [batch.column(c) for c in ("batch", "bucket", "one", "two", "three")]
        for name, bucket, one, two, three in zip(*cols, strict=True):
            own = _unpack(one.as_py())
            if not name.is_valid:
                keys, values, counts = own, _values(two.as_py(), np.float32), _values(three.as_py(), np.int64)
                continue
            cut, split = int(np.searchsorted(own, WORD_FLAG)), len(values)
            rows.append((name.as_py(), bucket.as_py(), _squeeze(values[np.searchsorted(keys, own[:cut])]), _squeeze(counts[np.searchsorted(keys, own[cut:]) - split])))
            size += len(rows[-1][2])
            if size > SLICE_BYTES:
                yield _batch(_ANSWERS, rows)
                rows, size = [], 0
        if rows:
            yield _batch(_ANSWERS, rows)


SCORES = "row string, doc_id long, n_tokens long, n_known long, logs double, score double"
_SCORES = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])


def _per_piece(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), values, len(sizes))


def _score(buckets: int):
    def run(stored: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for blob in stored.column("one").to_pylist():
            docs = pa.ipc.open_stream(blob).read_all()
            pieces = [Piece(*p) for p in zip(docs.column("text").to_pylist(), docs.column("head").to_pylist(), docs.column("last").to_pylist(), strict=True)]
            keys, _ = batch_keys(pieces, docs.column("train").to_numpy())
            bucket = bucket_of(keys, buckets)
            split = int(np.searchsorted(keys, WORD_FLAG))
            values, counts = np.zeros(split, np.float32), np.zeros(len(keys) - split, np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            got = 0
            for b, v, c in zip(answers.column("bucket").to_pylist(), answers.column("values"), answers.column("counts"), strict=True):
                at = order[cut[b] : cut[b + 1]]
                values[at[at < split]] = _values(v.as_py(), np.float32)
                counts[at[at >= split] - split] = _values(c.as_py(), np.int64)
                got += len(at)
            if got != len(keys):
                raise ValueError(f"{got} of {len(keys)} keys were answered")
            logs = np.log10(counts + 0.1)

            def look(wanted: np.ndarray, offset: int, table: np.ndarray) -> np.ndarray:
                coded = pa.array(wanted).dictionary_encode()
                at = np.searchsorted(keys, coded.dictionary.to_numpy(zero_copy_only=False)) - offset
                return table[at][coded.indices.to_numpy(zero_copy_only=False)]

            for part in _slices(pieces):
                g, w, n = text_keys(pieces[part])
                sizes = np.array([len(p.text) + p.last for p in pieces[part]])
                found = look(w, split, np.arange(len(counts)))
                out.append((_per_piece(counts[found] > 0, n).astype(np.int64), _per_piece(logs[found], n), _per_piece(look(g, 0, values).astype(np.float64), sizes), n))
            known, logs, score, tokens = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.Table.from_arrays([docs.column("row").combine_chunks(), docs.column("doc_id").combine_chunks(), pa.array(tokens), pa.array(known), pa.array(logs), pa.array(score)], schema=_SCORES)
        return _table(_SCORES, [])

    return run


def _hot(lists: DataFrame) -> DataFrame:
    """Buckets of more than ``PART_BYTES`` of lists, with the number of parts they make."""
    sizes = lists.groupBy("bucket").agg(F.sum(F.octet_length("one") + F.octet_length("two")).alias("size"), F.count(F.lit(1)).alias("lists"))
    return sizes.where((F.col("size") > PART_BYTES) & (F.col("lists") > FAN_IN)).select("bucket", F.least(F.ceil(F.col("size") / PART_BYTES), F.ceil(F.col("lists") / FAN_IN)).cast("int").alias("parts"))


def _part(name: str) -> Column:
    return F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(name), F.col("parts")).cast("int"))


def score_documents(docs: DataFrame, train) -> DataFrame:
    """Per row of ``docs``: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a boolean column: the rows the model learns from.  Null and
    empty texts have one token, the end.  Long texts are scored in pieces
    that know the bytes before them, so only a single word of many megabytes
    is held with its arrays at once.  Without training rows every symbol
    has probability 1/257 and the baseline 1.  Repeated rows are counted and
    scored each; a null doc_id stays null; an empty table gives no rows.
    Only doc_id and text are read.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    listed = written(rows.mapInArrow(_list(buckets), LISTED), "ppm-lists")
    lists = listed.where("kind = 1").select("batch", "bucket", "one", "two")

    hot = written(_hot(lists), "ppm-hot")
    level, busy, made = lists.select("bucket", "one", "two", "batch"), hot, []
    while not busy.isEmpty():  # a hot bucket's lists are added part by part, until a few are left
        parts = level.join(busy, "bucket").withColumn("part", _part("batch"))
        sums = parts.groupBy("bucket", "part").applyInArrow(_add, LISTS).withColumn("batch", F.expr("uuid()"))
        level = written(level.join(busy, "bucket", "left_anti").unionByName(sums), "ppm-sums")
        made.append(level)
        busy = written(_hot(level), "ppm-hot")
        made.append(busy)
    totals = written(level.select("bucket", "one", "two").groupBy("bucket").applyInArrow(_total, TOTALS), "ppm-totals")
    discard(*made)

    triples = written(totals.select("bucket", "one", "two").mapInArrow(_triples, TRIPLES), "ppm-triples")
    sums = triples.groupBy("triple").agg(F.sum("n").alias("n")).where("n > 0")
    pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    symbol, before = F.col("triple").bitwiseAND((1 << BITS) - 1), F.shiftright("triple", BITS)
    for r in sums.groupBy((before.bitwiseAND((1 << BITS) - 1) * SYMBOLS + symbol).alias("pair")).agg(F.sum("n").alias("n")).collect():  # 257 x 257 rows at most
        pairs[r["pair"]] = r["n"]
    under = sums.groupBy(before.alias("context")).agg(F.collect_list(F.struct("triple", "n")).alias("under"))  # 257 at most
    contexts = triples.select("bucket", before.alias("context")).distinct().join(under, "context").select("bucket", "under")
    coded = written(totals.select("bucket", "one", "two").groupBy("bucket").cogroup(contexts.groupBy("bucket")).applyInArrow(_code(pairs.reshape(SYMBOLS, SYMBOLS)), CODED), "ppm-trie")
    n = totals.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    n_train, kinds = n["tokens"] or 0, n["kinds"] or 0
    discard(totals, triples)

    values = coded.join(hot, "bucket", "left").select(F.lit(None).cast("string").alias("batch"), "bucket", "one", "two", "three", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("part"))
    asked = lists.join(hot, "bucket", "left").select("batch", "bucket", "one", F.lit(None).cast("binary").alias("two"), F.lit(None).cast("binary").alias("three"), _part("batch").alias("part"))
    passing = values.unionByName(asked).repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.col("batch").asc_nulls_first())
    answers = written(passing.select("batch", "bucket", "one", "two", "three").mapInArrow(_answer, "batch string, bucket int, values binary, counts binary"), "ppm-answers")
    discard(coded)
    stored = listed.where("kind = 0").select("batch", "one")
    scored = stored.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(buckets), SCORES)
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(n_train + 0.1 * (kinds + 1))))
    whole = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "score")])
    return whole.select("doc_id", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op2_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, learning from the ids whose crc32 mod 10 is not 0."""
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, id_crc("doc_id") % 10 != 0)
    return out.select("doc_id", (id_crc("doc_id") % 10 == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op2_ppm_scoring": op2_ppm_scoring}
ORACLES: dict[str, str] = {}
