"""Benchmark decontamination with an Aho-Corasick automaton.

All benchmark windows (13 consecutive normalised words, or a whole shorter
item) go into one automaton over word ids; each document is scanned once
and the hit words are mapped back to the offsets of the original text.

The benchmark's bytes are counted before anything is shipped.  Up to
``PART_BYTES`` its windows are broadcast as one automaton and the corpus is
scanned once, without a shuffle.  A larger benchmark is dealt by a hash of
its items into parts of about that size; the corpus is scanned once for each
part, which alone is held then, and the places hit are united by row.  So no
broadcast is larger than a part (or the largest single item), and nothing is
dropped.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes, tune, written

WINDOW = 13
#: Bytes of benchmark text whose windows are shipped at once (a window of 13 words for each word: some 300 MB in a worker at most).
PART_BYTES = 2 << 20

#: Bytes of words are digits, a-z and everything above 127; A-Z is lowered, the rest parts words.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HIT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Windows:
    """The windows of a benchmark, and the scan of one document. Pickled as plain lists; each worker builds its automaton once."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                self.windows.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.shortest = min(map(len, self.windows), default=0)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for ids, items in self.windows.items():
                self._automaton.add_word(ids, (len(ids), items))
            self._automaton.make_automaton()
        return self._automaton

    def scan(self, text: bytes) -> tuple[int, np.ndarray | None, set]:
        """Number of words, a flag for each hit word (None: no hit), the items found."""
        words = words_of(text)
        if not self.windows or len(words) < self.shortest:
            return len(words), None, set()
        ids = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(0)), np.int64, len(words))
        # Only runs of benchmark words at least as long as the shortest window can hold one.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0]))))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        found, change = set(), None
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            run = tuple(ids[s:e].tolist())
            for last, (n, items) in self.automaton().iter(run):
                if change is None:
                    change = np.zeros(len(words) + 1, np.int64)
                change[s + last - n + 1] += 1
                change[s + last + 1] -= 1
                found |= items
        return len(words), None if change is None else np.cumsum(change)[:-1] > 0, found

    def report(self, text: bytes) -> tuple[int, int, int, str, bool]:
        n, hit, found = self.scan(text)
        n_hit = 0 if hit is None else int(hit.sum())
        ids = sorted(x for x in found if x is not None)
        return n, n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n

    def places(self, text: bytes) -> tuple[list[tuple[int, int]], list[str]]:
        """Runs of hit words as (first, end) word numbers, and the items found."""
        _, hit, found = self.scan(text)
        if hit is None:
            return [], []
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), sorted(x for x in found if x is not None)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) in characters of the original text, of each run of hit words."""
        runs, _ = self.places(text.encode())
        if not runs:
            return []
        at = [m.span() for m in _WORDS.finditer(text)]
        return [(at[s][0], at[e - 1][1]) for s, e in runs]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> Windows:
    """Read the benchmark (test questions and answers: a fixed list, not a part of the corpus). Null texts and texts without words have no windows; windows of items without an id hit words but count as no item."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").toLocalIterator()
    return Windows([(r["item"], r["text"].encode()) for r in rows], window)


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark itself if it is small enough to be shipped, else its parts by a hash of the item."""
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size <= PART_BYTES:
        return [benchmark]
    parts = -(-size // (PART_BYTES // 2))  # half full on average, as a hash does not deal evenly
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) for p in range(parts)]


def _places(spark: SparkSession, windows: Windows, text: Column) -> Column:
    """struct<runs, items> of a text column: ``Windows.places``."""
    tune(spark)
    shared = spark.sparkContext.broadcast(windows)
    run = pa.struct([("first", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf("runs array<struct<first:int,end:int>>, items array<string>")
    def places(column: pa.Array) -> pa.Array:
        found = [shared.value.places(t) for t in text_bytes(column)]
        runs = pa.array([[{"first": s, "end": e} for s, e in r] for r, _ in found], pa.list_(run))
        return pa.StructArray.from_arrays([runs, pa.array([i for _, i in found], pa.list_(pa.string()))], names=["runs", "items"])

    return places(text)


def with_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of ``docs`` as the struct ``row`` and the struct ``HIT`` of its ``text`` as ``hit``; null and empty texts have no words and are clean."""
    spark = docs.sparkSession
    parts = _parts(benchmark)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if len(parts) == 1:
        return docs.select(whole, hit_report(spark, benchmark_windows(parts[0]), F.col("text")).alias("hit"))
    # Rows are numbered in a written table, so that a task that runs again gives the same numbers.
    base = written(docs.select(whole, F.monotonically_increasing_id().alias("place")), "decontamination-rows")
    found = []
    for part in parts:
        windows = benchmark_windows(part)
        if windows.windows:
            at = base.select("place", _places(spark, windows, F.col("row.text")).alias("p")).where(F.size("p.runs") > 0)
            found.append(written(at.select("place", "p.*"), "decontamination-part"))
    if not found:  # a large benchmark without a word
        return docs.select(whole, hit_report(spark, Windows([]), F.col("text")).alias("hit"))
    hits = functools.reduce(DataFrame.unionAll, found)
    hits = hits.groupBy("place").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Words covered by the sorted runs: each adds what reaches beyond the furthest end so far.
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("far"))
    grown = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(a["far"], r["first"]))).alias("n"), F.greatest(a["far"], r["end"]).alias("far"))
    hits = hits.select(F.col("place").alias("at"), F.aggregate("runs", start, grown)["n"].cast("long").alias("covered"), "items")
    rows = base.join(hits, F.col("place") == F.col("at"), "left")
    words, hit, items = F.coalesce(F.regexp_count("row.text", F.lit(_WORDS.pattern)), F.lit(0)).cast("long"), F.coalesce("covered", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    names = [words.alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= words)).alias("contaminated")]
    return rows.select("row", F.struct(*names).alias("hit"))


def hit_report(spark: SparkSession, windows: Windows, text: Column) -> Column:
    """The struct ``HIT`` of a text column. Null and empty texts have no words and are clean."""
    tune(spark)
    shared = spark.sparkContext.broadcast(windows)

    @F.arrow_udf(HIT)
    def report(column: pa.Array) -> pa.Array:
        w = shared.value
        kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
        rows = [w.report(x or b"") for x in column.cast(kind).to_pylist()]
        names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    return report(text)


def contaminated_spans(spark: SparkSession, windows: Windows, text: Column) -> Column:
    """array<struct<start,end>> of the hit passages, in characters of the original text."""
    tune(spark)
    shared = spark.sparkContext.broadcast(windows)

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def spans(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"start": s, "end": e} for s, e in shared.value.spans(t or "")] for t in column.to_pylist()], kind)

    return spans(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated (a hit, and a twentieth of the words or more), with all their columns.

    Texts of any length are scanned whole; null and empty ones are clean and
    stay, repeated rows and rows without an id are judged like all others, an
    empty table or benchmark is no error.  Columns of any name pass through.
    """
    kept = with_hits(docs, benchmark).where(~F.col("hit.contaminated"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark window; repeated documents give repeated rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_hits(docs, table(spark, sf_dir, "benchmark")).select("row.doc_id", "hit.*")


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {
    "op7_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.n, dw.i, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.items, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
""",
}
