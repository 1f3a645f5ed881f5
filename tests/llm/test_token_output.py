import base64
import json
from pathlib import Path

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparktrail.llm import token_output as o
from sparktrail.llm.common import shared_dir


def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(o.TOKENIZER, "rb"))}
    return tiktoken.Encoding("plain", pat_str=o.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", "Hello  world\n\n it's 42!", "é𝄞 ñ  ", "word " * 400, "tail   ", "a", "Hello  world\n\n it's 42!", "x" * 3000]


def test_exact_round_trip(spark, tmp_path):
    rows = [(i if i != 6 else None, t, "k") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").coalesce(1)
    packed = o.pack_tokens(docs, row_length=64)
    encode = plain().encode_ordinary
    want = sorted((-1 if i is None else i, encode(t or "") + [o.END]) for i, t, _ in rows)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in o.unpack_tokens(packed, 64).collect())
    assert got == want
    found = packed.collect()
    for r in found:
        assert len(r["input_ids"]) == 128 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64 and r["position_resets"] == r["cu_seqlens"][:-1]
        assert set(np.frombuffer(r["input_ids"], "<u2")[r["n_tokens"] :]) <= {o.END}
    assert len(found) <= -(-sum(len(x) for _, x in want) // 64) + 2
    manifest = o.write_matrices(packed, str(tmp_path / "m"), 64).collect()
    assert sum(m["rows"] for m in manifest) == len(found)
    for m in manifest:
        raw = np.fromfile(m["path"], "<u2").reshape(-1, 64)
        side = json.load(open(m["path"].replace(".ids", ".json")))
        assert len(raw) == m["rows"] == side["rows"] == len(side["segments"])


def test_empty(spark):
    assert o.pack_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def naive(lengths, size):
    rows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(room[r], r) for r in range(len(rows)) if room[r] >= lengths[i] and room[r] > 0]
        if fits and lengths[i] < size:
            best = min(c for c, _ in fits)
            r = max(r for c, r in fits if c == best)
        else:
            r = len(rows)
            rows.append([])
            room.append(size)
        rows[r].append(i)
        room[r] -= lengths[i]
    return sorted(room)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_decreasing(lengths):
    rows = o.best_fit_decreasing(lengths, 16)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert sorted(16 - sum(lengths[i] for i in r) for r in rows) == naive(lengths, 16)


@pytest.mark.parametrize("text", ["a  b\t\n c", "don't I'll 'S", "１２ 3½", " "])
def test_parts_are_encoded_as_the_whole(text):
    with open(o.TOKENIZER, "rb") as f:
        assert o.Encoder(f.read(), "<u2").encode(text).tolist() == plain().encode_ordinary(text)


def test_positions():
    assert o.position_ids(8, [0, 3, 6]).tolist() == [0, 1, 2, 0, 1, 2, 0, 1]


def test_query_writes_matrices_and_reads_them_back(spark, tmp_path):
    rows = [(i if i != 6 else None, (t or "") * 30 if t else t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    shared = Path(shared_dir(spark))
    before = set(shared.glob("**/*.ids"))
    found = o.op8_packed_tokens(spark, str(tmp_path))
    key = lambda r: str(tuple(r))
    assert sorted(found.collect(), key=key) == sorted(o.pack_tokens(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect(), key=key)
    assert found.schema.simpleString() == o.pack_tokens(spark.createDataFrame(rows, "doc_id long, text string")).schema.simpleString()
    made = set(shared.glob("**/*.ids")) - before
    assert sum(f.stat().st_size for f in made) == found.count() * 2 * o.ROW_LENGTH
    sides = [json.load(open(f.with_suffix(".json"))) for f in made]
    assert sum(s["rows"] for s in sides) == found.count() and all(len(s["segments"]) == s["rows"] for s in sides)


def test_cut_matrix_is_found(spark, tmp_path):
    packed = o.pack_tokens(spark.createDataFrame([(1, "a b c " * 100)], "doc_id long, text string").coalesce(1), row_length=64)
    manifest = o.write_matrices(packed, str(tmp_path / "m"), 64)
    path = Path(manifest.first()["path"])
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(Exception, match="cut off"):
        o.read_matrices(manifest, str(tmp_path / "m")).collect()


def test_no_rows_no_files(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert o.op8_packed_tokens(spark, str(tmp_path)).count() == 0
