"""Near-duplicate detection by b-bit MinHash.

Sets are the distinct five-word shingles of whole texts (64-bit hashes).
The first 128 of 768 minima per set give 32 band keys of four minima each,
and the low two bits of every minimum are packed into a 192-byte signature.  Documents that
share a band key are compared by counting equal two-bit fields; the count
is corrected for fields that agree by chance.  What this estimate lets
through is confirmed on the full sets, and the confirmed links' components
are found by contraction.

Skew.  Documents with the same word sequence are one class from the start.
In a band's bucket every member is compared with at most 64 pivots (members
that are not very close to a pivot become pivots while there is room) and
paired with the best; of a member's pairs in all bands the best one is
confirmed, so there is at most one pair per document.
Buckets of more than ``HOT`` members are split by salt and the parts' pivots
compared in the same way, in as many passes as it takes.  Afterwards the members of a bucket that are
still in different components are compared with each other, each pair in the
first band that both share, best estimates first, until no unconfirmed pair
is left, so of the pairs that bands and estimates let through no link that
decides a component is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, discard, mix64, table, text_bytes, tune, written

SHINGLE = 5
HASHES, BANDS, ROWS, BITS = 768, 32, 4, 2
SIMILARITY = 75  # per cent
#: Estimates below this are not confirmed: 4.3 standard deviations (0.0188 at similarity 0.75) under 0.75, which loses one
#: in 100,000 pairs of exactly that similarity and far fewer above it; bands miss 5 in a million of such pairs.
ESTIMATE = 0.669
#: Pivots of a bucket; a member whose best estimate is under CLOSE becomes one while there is room.
PIVOTS, CLOSE = 64, 0.85
#: Members of a bucket's part in the search for pivots, and in the pass between components.
HOT, VISITED = 512, 16_384
#: Pairs between components that are confirmed in one task, and bytes of the sets that it holds.
TOGETHER, SETS = 20_000, 64 << 20
#: Links that one task contracts in memory; more are contracted by star rounds on the cluster first.
LOCAL_LINKS = 1_000_000
#: Bytes of text whose arrays are built at once.
CHUNK = 1 << 20

_rng = np.random.default_rng(1234567)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_MULTIPLY = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and the first word of each text (one more at the end)."""
    data = np.frombuffer(b" ".join(texts).translate(LOWER) + b" ", np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), dtype=np.uint64)))
    back = _powers(_BACK, len(data) + 1)
    words = mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return words, np.concatenate(([0], np.searchsorted(starts, ends_of_texts)))


def shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text, and the first one of each text (one more at the end). A text of one to four words is one shingle."""
    q = _powers(_STEP, SHINGLE + 1)
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(at[-1], np.uint64)
    if len(words) >= SHINGLE:
        every = np.full(len(words) - SHINGLE + 1, SHINGLE, np.uint64)
        for j in range(SHINGLE):
            every += words[j : len(words) - SHINGLE + 1 + j] * q[j + 1]
        text = np.repeat(np.arange(len(n)), n)
        whole = text[: len(every)] == text[SHINGLE - 1 :]
        long = np.repeat(n >= SHINGLE, count)
        out[long] = every[whole]
    for t in np.flatnonzero((n > 0) & (n < SHINGLE)):
        w = words[first[t] : first[t + 1]]
        out[at[t]] = np.uint64(len(w)) + (w * q[1 : len(w) + 1]).sum(dtype=np.uint64)
    return mix64(out), at


def minima(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The minima of each text's shingles; texts without any are left out."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat((hashes * _MULTIPLY[j] + _ADD[j]).view(np.uint32)[1::2], starts) if len(starts) else 0
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    out = np.empty((len(mins), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(mins), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix64(key * _STEP + mins[:, b * ROWS + r])
        out[:, b] = key
    return out.view(np.int64)


def packed(mins: np.ndarray) -> np.ndarray:
    """The low bits of all minima, as uint64 words: first the lowest bits, then the next."""
    planes = [np.packbits(((mins >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=1) for b in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.uint64)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of one packed signature to many."""
    half = many.shape[1] // BITS
    differ = np.zeros((len(many), half), np.uint64)
    for b in range(BITS):
        differ |= many[:, b * half : (b + 1) * half] ^ one[b * half : (b + 1) * half]
    same = 1 - np.bitwise_count(differ).sum(axis=1, dtype=np.int64) / HASHES
    chance = 0.5**BITS
    return (same - chance) / (1 - chance)


def _chunks(texts: list[bytes]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


SIGNATURE = "doc_id long, key binary, n_shingles long, bands array<long>, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for part in _chunks(texts):
            words, first = word_hashes(texts[part])
            hashes, at = shingles(words, first)
            mins = minima(hashes, at)
            bands, sigs = band_keys(mins), packed(mins)
            keys, sizes, k = [], [], 0
            band_rows, sig_rows = [], []
            for t in range(len(first) - 1):
                n = len(np.unique(hashes[at[t] : at[t + 1]]))
                sizes.append(n)
                if n:
                    keys.append(hashlib.blake2b(words[first[t] : first[t + 1]].tobytes(), digest_size=16).digest())
                    band_rows.append(bands[k])
                    sig_rows.append(sigs[k].tobytes())
                    k += 1
                else:
                    keys.append(None)
                    band_rows.append(None)
                    sig_rows.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[part.start : part.stop].cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(band_rows, pa.list_(pa.int64())), pa.array(sig_rows, pa.binary())],
                names=["doc_id", "key", "n_shingles", "bands", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for part in _chunks(texts):
            hashes, at = shingles(*word_hashes(texts[part]))
            rows = [np.unique(hashes[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part.start : part.stop].cast(pa.int64()), pa.array(rows, pa.binary())], names=["id", "grams"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            one, two = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            if 100 * min(len(one), len(two)) < SIMILARITY * max(len(one), len(two)):
                keep.append(False)
                continue
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(100 * both >= SIMILARITY * (len(one) + len(two) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "link"])


def near(sig: np.ndarray, n: int, sigs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Estimates of one signature to many, 0 where the sizes alone rule the similarity out."""
    fits = 100 * np.minimum(sizes, n) >= SIMILARITY * np.maximum(sizes, n)
    out = np.zeros(len(sigs))
    if fits.any():
        out[fits] = estimate(sig, sigs[fits])
    return out


def _buckets(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[tuple[tuple[int, ...], bool, list[np.ndarray]]]:
    """Runs of equal (bucket, salt) of a sorted partition, batch by batch: (key, whether it goes on from the batch before, columns)."""
    last = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "salt", "id", *extra)]
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            if s < e:
                key = (int(cols[0][s]), int(cols[1][s]))
                yield key, key == last, [sigs[s:e], *[c[s:e] for c in cols[2:]]]
                last = key


STAR = "kind int, bucket long, a long, b long, n long, sig binary, near double"


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a pair (pivot, member) to confirm. Kind 1: a pivot of a salted bucket.

    Only the pivots of the bucket at hand are held.
    """
    width = HASHES * BITS // 64
    pivots, sizes, ids = np.zeros((PIVOTS, width), np.uint64), np.zeros(PIVOTS, np.int64), []
    out: list[tuple] = []
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64())

    def flush():
        nonlocal out
        cols, out = list(zip(*out, strict=True)), []
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["kind", "bucket", "a", "b", "n", "sig", "near"])

    def hold(member: int, n: int, sig: np.ndarray) -> None:
        pivots[len(ids)], sizes[len(ids)] = sig, n
        ids.append(member)

    for (bucket, salt), goes_on, (sigs, members, counts) in _buckets(batches, ["n"]):
        if not goes_on:
            ids = []
        for member, n, sig in zip(members.tolist(), counts.tolist(), sigs, strict=True):
            at = near(sig, n, pivots[: len(ids)], sizes[: len(ids)]) if ids else np.zeros(0)
            best = int(at.argmax()) if len(at) else -1
            if best >= 0 and at[best] >= ESTIMATE and ids[best] != member:
                out.append((0, bucket, min(ids[best], member), max(ids[best], member), None, None, float(at[best])))
            if len(ids) < PIVOTS and (best < 0 or at[best] < CLOSE):
                hold(member, n, sig)
                if salt >= 0:
                    out.append((1, bucket, member, member, n, sig.tobytes(), None))
        if len(out) >= 10_000:
            yield flush()
    if out:
        yield flush()


PAIR = "a long, b long, bucket long, w long"


def _rest(first: int, last: int | None):
    """Pairs of a bucket's members in different components: for each minor member those whose estimates rank from ``first`` to before ``last``; a pair (-1, -1) tells that some rank later.

    Ranks and minor members are those of the first round in every round, so each pair comes in one round only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        here = [0]  # the bucket of what is held

        def pairs() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sigs, ids, sizes, start, comps, minor, main, bands, band = (np.concatenate(c) for c in zip(*held, strict=True))
            found, more = set(), False
            bucket = here[0]
            place = np.flatnonzero(main)  # rows that are here as partners; minor ones may be here as visitors only
            for i in np.flatnonzero(minor):
                at = near(sigs[i], int(sizes[i]), sigs[place], sizes[place])
                ok = np.flatnonzero((at >= ESTIMATE) & (start[place] != start[i]))
                if len(ok) and band[i]:  # only in the first band that both share
                    ok = ok[~(bands[place[ok], : band[i]] == bands[i, : band[i]]).any(axis=1)]
                if first or (last is not None and len(ok) > last):
                    more = more or (last is not None and len(ok) > last)
                    ok = ok[np.lexsort((ids[place[ok]], -at[ok]))[first:last]]
                ok = ok[comps[place[ok]] != comps[i]]
                own, size = int(ids[i]), int(sizes[i])
                found.update((min(x, own), max(x, own), bucket, n + size) for x, n in zip(ids[place[ok]].tolist(), sizes[place[ok]].tolist(), strict=True))
                if len(found) > 100_000:
                    yield emit(found)
                    found = set()
            if more:
                found.add((-1, -1, bucket, 0))
            if found:
                yield emit(found)

        def emit(found):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], names=["a", "b", "bucket", "w"])

        for key, goes_on, cols in _buckets(batches, ["n", "start", "comp", "minor", "main", "bands", "band"]):
            if not goes_on:
                yield from pairs()
                held = []
            here[0] = key[0]
            held.append([*cols[:7], np.stack(cols[7]), cols[8]])
        yield from pairs()

    return run


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links; gives (node, smallest node of its set)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    rows = [(x, root(x)) for x in list(parent)]
    if rows:
        u, v = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(links: DataFrame, label: str = "components", local: int = LOCAL_LINKS) -> DataFrame:
    """(id, comp) of every id in ``links`` (a, b): comp is the smallest id it reaches.

    At most ``local`` links are contracted by union-find in one task.  More
    are first contracted ``local`` at a time, and then by alternating
    large-star and small-star rounds until nothing changes: each round is one
    pass, written to the shared folder, and nothing but a count and a
    checksum comes to the driver.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    n = edges.count()
    if n <= local:
        edges = written(edges.coalesce(1).mapInArrow(_contract, "u long, v long"), label)
    else:
        edges = written(edges.repartition(-(-n // local)).mapInArrow(_contract, "u long, v long").distinct(), label)
        mark = None
        while True:
            both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
            edges = written(small.where("u <> v").distinct(), label)
            now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
            if now == mark:
                break
            mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _sorted_buckets(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "id")


def link_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key and n_shingles of all rows, classes (key, rep), components (id, comp) of linked class representatives).

    Joins whose sides both grow with the table are sort-merge joins at every
    size; what is dealt by band key and joined with components are ids, and
    signatures follow only where they are compared.  Folders are deleted as
    soon as what was made of them is written.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(docs.mapInArrow(_sign, SIGNATURE), "signatures")
    sizes = written(signed.select("doc_id", "key", "n_shingles"), "sizes")
    ids = signed.where("doc_id is not null and key is not null")
    # equal keys mean equal words, so any row of a class has its signature
    classes = written(ids.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    discard(signed)
    reps = written(classes.select("key", F.col("id").alias("rep")), "representatives")

    rows = classes.select(F.explode("bands").alias("bucket"), "id")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = written(rows.join(shared.hint("merge"), "bucket"), "members")
    sets = written(_shingle_sets(docs, members.select("id")), "sets")

    pairs, level = [], members.join(classes.select("id", "n", "sig").hint("merge"), "id")
    room = HOT
    while True:  # the pivots of a hot bucket's parts are compared in the same way, in larger parts, so passes end
        found = written(_sorted_buckets(level.withColumn("salt", _salt(room))).mapInArrow(_stars, STAR), "stars")
        room *= 4
        pairs.append(found.where("kind = 0").select("a", "b", "near"))
        pivots = found.where("kind = 1").select("bucket", F.col("a").alias("id"), "n", "sig")
        if pivots.isEmpty():
            break
        level = pivots.join(pivots.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).hint("merge"), "bucket")
    # over all bands, one pair for each member: that with its best pivot
    best = reduce(DataFrame.unionAll, pairs).groupBy("b").agg(F.max_by("a", F.struct("near", -F.col("a"))).alias("a")).select("a", "b")

    checked = confirm(sets, best)
    start = comps = components(checked.where("link").select("a", "b"))
    discard(found)
    for first, last in ((0, 64), (64, None)):
        rest = written(_unresolved(members, classes, start, comps, first, last), "rest")
        fresh = rest.where("a >= 0").groupBy("a", "b").agg(F.min("bucket").alias("bucket"), F.max("w").alias("w")).join(checked.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        fresh = written(fresh, "fresh")
        if not fresh.isEmpty():
            new = confirm_together(sets, fresh)
            checked = checked.unionAll(new)
            if not new.where("link").isEmpty():
                comps = components(checked.where("link").select("a", "b"))
        done = rest.where("a < 0").isEmpty()
        discard(rest, fresh)
        if done:
            break
    discard(sets, members, classes)
    return sizes, reps, comps


def _shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The full shingle sets (id, grams) of the documents that share a bucket with another."""
    ids = ids.select(F.col("id").alias("doc_id")).distinct()
    return docs.join(ids.hint("merge"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "id long, grams binary")


def _salt(room: int) -> Column:
    """The part of a bucket of ``k`` members that an id is in; -1 where the bucket is whole."""
    return F.when(F.col("k") > room, F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / room)).cast("int")).otherwise(-1)


def _unresolved(members: DataFrame, classes: DataFrame, start: DataFrame, comps: DataFrame, first: int, last: int | None) -> DataFrame:
    """Candidate pairs between components that share a bucket. Members outside a bucket's largest component visit every part of the bucket."""
    rows = members.select("bucket", "id").join(start.withColumnRenamed("comp", "start").hint("merge"), "id", "left").withColumn("start", F.coalesce("start", "id"))
    sizes = rows.groupBy("bucket", "start").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("start", F.struct("k", "start")).alias("largest"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = mixed.select("bucket", "largest", F.ceil(F.col("k") / VISITED).cast("int").alias("salts"))
    rows = rows.join(mixed.hint("merge"), "bucket").withColumn("minor", F.col("start") != F.col("largest")).withColumn("home", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    rows = rows.join(comps.hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    rows = rows.join(classes.select("id", "n", "sig", "bands").hint("merge"), "id").withColumn("band", F.array_position("bands", F.col("bucket")).cast("int") - 1)
    placed = rows.withColumn("salt", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array("home"))))
    placed = placed.select("bucket", "salt", "id", "n", "sig", "start", "comp", "minor", (F.col("salt") == F.col("home")).alias("main"), "bands", "band")
    return _sorted_buckets(placed).mapInArrow(_rest(first, last), PAIR)


def confirm(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Decide each pair (a, b) of ids on their full shingle sets: (a, b, link)."""
    one = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(_confirm, "a long, b long, link boolean").groupBy("a", "b").agg(F.max("link").alias("link")), "checked")


def _confirm_group(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    held = {i: np.frombuffer(g, np.uint64) for i, g in zip(sets.column("id").to_pylist(), sets.column("grams").to_pylist(), strict=True)}
    a, b, keep = pairs.column("a"), pairs.column("b"), []
    for i, j in zip(a.to_pylist(), b.to_pylist(), strict=True):
        one, two = held[i], held[j]
        both = len(np.intersect1d(one, two, assume_unique=True))
        keep.append(100 * both >= SIMILARITY * (len(one) + len(two) - both))
    return pa.Table.from_arrays([a, b, pa.chunked_array([pa.array(keep, pa.bool_())])], names=["a", "b", "link"])


def confirm_together(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """As ``confirm``, for pairs (a, b, bucket, w) of which many share documents: w is the size of both sets.

    Pairs of one bucket go to the same part (a large bucket's in chunks by
    their smaller id), and a part gets each set once.  The number of parts
    follows from the number of pairs and the sizes of their sets, so a part
    holds about ``TOGETHER`` pairs or ``SETS`` bytes of sets.
    """
    sizes = pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("s"))
    total = sizes.agg(F.sum("k").alias("k"), F.sum("s").alias("s")).first()
    parts = max(1, -(-total["k"] // TOGETHER), -(-total["s"] * 8 // SETS))
    chunks = F.greatest(F.ceil(F.col("k") / TOGETHER), F.ceil(F.col("s") * 8 / SETS))
    dealt = pairs.join(sizes.hint("merge"), "bucket").select("a", "b", F.pmod(F.xxhash64("bucket", F.pmod(F.xxhash64("a"), chunks)), F.lit(parts)).cast("int").alias("part"))
    dealt = written(dealt, "dealt")
    place = F.col("part").alias("place")
    needed = dealt.select(place, F.col("a").alias("id")).unionAll(dealt.select(place, F.col("b").alias("id"))).distinct()
    shipped = needed.join(sets.hint("merge"), "id")
    out = written(dealt.groupBy("part").cogroup(shipped.groupBy("place")).applyInArrow(_confirm_group, "a long, b long, link boolean"), "checked")
    discard(dealt)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles, are linked with nothing and kept.
    A null doc_id takes no part in linking; its component_id and kept are
    null.  Repeated rows are the same node.  An empty table gives no rows.
    Only doc_id and text are read.
    """
    sizes, reps, comps = link_documents(docs)
    out = sizes.join(reps.hint("merge"), "key", "left").join(comps.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id, with all columns of ``docs``.

    Rows without an id stay.  Where the smallest id's row is itself repeated,
    one of the repeats stays, of different ones that whose columns, written
    as JSON, come first (repeated rows without words are no near-duplicates
    and all stay).  An empty table gives no rows.
    """
    result = written(near_duplicates(docs), "near-duplicates")
    key = "__near_duplicate_id"
    kept = result.where("kept").groupBy(F.col("doc_id").alias(key)).agg(F.sum(F.when(F.col("n_shingles") > 0, 1).otherwise(0)).alias("__near_duplicate_n"))
    kept = written(kept, "kept")
    discard(result)
    on = docs["doc_id"] == F.col(key)
    once = docs.join(kept.where("__near_duplicate_n < 2").hint("merge"), on, "left_semi").unionAll(docs.where(docs["doc_id"].isNull()))
    again = kept.where("__near_duplicate_n > 1")
    if again.isEmpty():
        return once
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = docs.join(again.hint("merge"), on, "left_semi").select(F.col("doc_id").alias(key), F.col("text").alias("__near_duplicate_text"), row.alias("__near_duplicate_row"))
    first = repeated.groupBy(key, "__near_duplicate_text").agg(F.min_by("__near_duplicate_row", F.to_json("__near_duplicate_row")).alias("__near_duplicate_row"))
    return once.unionAll(first.select(*[F.col("__near_duplicate_row")[c].alias(c) for c in docs.columns]))


def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_bbit_minhash": op9_bbit_minhash}
ORACLES = {
    "op9_bbit_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
}
