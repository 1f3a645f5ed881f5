import corpus_pipeline
from sparktrail.llm import decontamination, minhash, packing, registry
from sparktrail.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == docs.columns
            now = {r["doc_id"] for r in out.collect()}
            assert now <= ids and (name != "pii" or now == ids)
            if name == "near_dedup":
                assert now == {r["doc_id"] for r in minhash.near_duplicates(docs).where("kept").collect()}
            if name == "decontamination":
                bench = decontamination.benchmark_windows(spark.read.parquet(f"{SF}/benchmark.parquet"))
                assert now == {r["doc_id"] for r in docs.collect() if not bench.report(r["text"].encode())[4]}
            ids = now
        else:
            # batches follow the rows' places, which a second read may change; lengths and buckets don't
            same = ["doc_id", "n_tokens", "bucket", "bucket_len"]
            assert sorted(map(tuple, out.select(same).collect())) == sorted(map(tuple, packing.pack(docs).select(same).collect()))
        docs = out
        seen.append(len(ids))
    assert seen == sorted(seen, reverse=True) and 0 < seen[-1] < seen[0]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "bucket", "bucket_len", "batch", "position"] and out.count() > 0


def test_stages_with_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and columns with clashing names; each stage's rows are stated."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    odd = [(None, None, "x", 1), (1, None, "x", 1), (2, "", None, 1), (3, word * 3, "x", 1), (3, word * 3, "x", 1), (3, word * 3, "a", 0), (4, word * 3 + "end", "x", 1), (5, "mail a.b@c.example now", "x", 1), (5, "mail a.b@c.example now", "x", 1)]
    odd += [(6, "q " * 300_000 + "10.0.0.1", "x", 1), (None, "other words altogether, 6 of them", "x", 1)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, bucket string, n_tokens int")
    stages = dict(corpus_pipeline.STAGES)
    same = sorted(map(str, map(tuple, odd)))
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    toxic = stages["toxicity"](spark, docs, SF)
    assert toxic.columns == docs.columns and set(rows(toxic)) <= set(same) and len(rows(toxic)) >= 9
    deduped = rows(stages["near_dedup"](spark, docs, SF))
    assert deduped == sorted(map(str, [odd[0], odd[1], odd[2], odd[5], odd[7], odd[9], odd[10]]))
    assert rows(stages["decontamination"](spark, docs, SF)) == same
    redacted = stages["pii"](spark, docs, SF)
    want = [(i, t if t is None else t.replace("a.b@c.example", "[EMAIL]").replace("10.0.0.1", "[IP]"), b, n) for i, t, b, n in odd]
    assert redacted.columns == docs.columns and rows(redacted) == sorted(map(str, want))
    packed = stages["packing"](spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in packed) == sorted(str(r[0]) for r in odd)
    assert sorted(r["n_tokens"] for r in packed) == sorted(len((r[1] or "").split()) + 1 for r in odd)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_ten_operators():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
