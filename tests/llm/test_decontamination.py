import hashlib
import re

import pytest

from sparktrail.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def brute(text, items):
    words = WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall(lower(t or ""))
        for i in range(max(1, len(w) - 12) if w else 0):
            win = w[i : i + 13]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    found.add(item)
    return len(words), len(hit), len({f for f in found if f is not None})


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [("1", LONG), ("2", "Short ITEM"), ("3", None), ("4", "..."), (None, "no id here"), ("1", "again éa"), ("5", " ".join(f"w{i}" for i in range(5, 20)))]


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_brute_force(spark, monkeypatch, part_bytes):
    """In one automaton, and with a benchmark that is too large to be shipped at once."""
    monkeypatch.setattr(d, "PART_BYTES", part_bytes)
    texts = [None, "", "...", LONG.upper(), "a " + " ".join(f"w{i}" for i in range(3, 25)) + " b", "short, item!", "shorts item", "no-id\nhere", "Again éA", "x " * 3000 + "short item", "w5 w6", "a-b'c short" * 20, "short item short item " * 4]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y")], "doc_id long, text string, contaminated string")
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert (len(d._parts(bench)) > 3) == (part_bytes == 60)
    out = d.with_hits(docs, bench).select("row.doc_id", "hit.*").collect()
    assert len(out) == len(texts) + 1
    for r in out:
        n, h, k = brute(texts[r["doc_id"]], ITEMS)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, h, k, h > 0 and 20 * h >= n)
        items = sorted({i for i, t in ITEMS if i and brute(texts[r["doc_id"]], [(i, t)])[2]})
        assert r["items_sha256"] == hashlib.sha256(",".join(items).encode()).hexdigest()
    clean = d.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in out if not r["contaminated"])


def test_spans():
    one = d.Windows([(i, (t or "").encode()) for i, t in ITEMS])
    text = "Hé, Short  Item! and éa short item"
    assert [text[a:b] for a, b in one.spans(text)] == ["Short  Item", "short item"]


def test_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.drop_contaminated(docs, bench).count() == 0
    assert d.drop_contaminated(spark.createDataFrame([(1, "a")], "doc_id long, text string"), bench).count() == 1


def test_large_benchmark_without_words(spark, monkeypatch):
    monkeypatch.setattr(d, "PART_BYTES", 2)
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert d.drop_contaminated(docs, spark.createDataFrame([("1", "......")], "item_id string, text string")).count() == 2
