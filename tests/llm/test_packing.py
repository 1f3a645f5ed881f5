from collections import Counter, defaultdict
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparktrail.llm import packing


def padded(histogram, ends):
    return sum(c * min(e for e in ends if e >= n) for n, c in histogram)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_buckets_against_every_choice(counts, buckets):
    histogram = sorted(counts.items())
    ends = packing.best_buckets(histogram, buckets)
    top = histogram[-1][0]
    rest = [n for n, _ in histogram[:-1]]
    best = min(padded(histogram, [*c, top]) for k in range(min(buckets, len(histogram))) for c in combinations(rest, k))
    assert len(ends) <= buckets and ends[-1] == top and padded(histogram, ends) == best


def test_no_lengths():
    assert packing.best_buckets([], 4) == []


def test_long_lengths_are_exact(spark):
    """Buckets of documents over 2,048 tokens end at lengths that occur, with the least padding of all choices."""
    lengths = [2047, 2050, 2173, 4099, 5185, 5188, 9001, 20_011]
    docs = spark.createDataFrame([(i, "w " * (n - 1)) for i, n in enumerate(lengths * 2 + [5185])], "doc_id long, text string")
    out = packing.pack(docs, 3).collect()
    histogram = sorted(Counter(r["n_tokens"] for r in out).items())
    ends = sorted({r["bucket_len"] for r in out})
    assert [n for n, _ in histogram] == lengths and set(ends) <= set(lengths) and ends[-1] == 20_011
    assert padded(histogram, ends) == min(padded(histogram, [*c, 20_011]) for k in range(3) for c in combinations(lengths[:-1], k))


def test_pack(spark):
    texts = [None, "", "   ", "one", "w " * 5000] + ["a b c"] * 40 + [" ".join("x" * (i % 9 + 1) for _ in range(i)) for i in range(60)]
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, bucket int, slot int")
    out = packing.pack(docs, 4, 64).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.collect())
    by = defaultdict(list)
    for r in out:
        want = 1 + len((texts[r["doc_id"] if r["doc_id"] is not None else 3] or "").split())
        assert r["n_tokens"] == want <= r["bucket_len"]
        by[r["bucket"], r["batch"]].append(r)
    for (bucket, batch), rows in by.items():
        room = max(1, 64 // rows[0]["bucket_len"])
        assert sorted(r["position"] for r in rows) == list(range(len(rows))) and len(rows) <= room
        if (bucket, batch + 1) in by:
            assert len(rows) == room


def test_many_equal_rows_and_none(spark):
    out = packing.pack(spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b").alias("text")), 16, 30).collect()
    assert Counter(r["batch"] for r in out) == Counter({b: 10 for b in range(300)})
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
