"""The pipeline's stages, one after the other, against brute force."""

import corpus_pipeline
from tests.llm import brute


def test_stages(spark, tmp_path):
    passage = brute.prose(99, 60)
    bench = brute.prose(77, 12)
    rows = brute.texts() + [(30, brute.prose(31, 90) + " " + bench + " " + brute.prose(32, 20))]
    for i in range(60, 120):
        rows.append((i, brute.prose(200 + i, 50) + (" blurghed snarkling." if i % 2 else "")))
    sf = str(tmp_path)
    brute.table(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(60, 120)], "doc_id long, quality int, toxic int").write.parquet(
        f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        out = steps[name](spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{name}")
        return spark.read.parquet(f"{sf}/{name}")

    docs = after("toxicity", docs)
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert not [i for i in ids if i and i >= 60 and i % 2] and len([i for i in ids if i and i >= 60]) == 30
    before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    docs = after("near_dedup", docs)
    assert brute.rows_of(docs, "doc_id") == brute.ordered(
        [(r[0],) for r in brute.near(list(dict.fromkeys(before))) if r[3]] + [(None,)] * (before.count((None, None)) - 1))
    before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    docs = after("suffix_array_dedup", docs)
    assert docs.count() == len(before)
    want = {d: n - gone for d, n, gone, _, _ in brute.repeated_bytes(before) if d not in (None, 23)}
    got = {r["doc_id"]: len(r["text"].encode()) for r in docs.select("doc_id", "text").collect()}
    assert all(want[d] - 6 * 3 <= got[d] <= want[d] for d in want)  # fragments of cut characters go
    assert passage not in dict(before).get(19, "") or passage not in {r["doc_id"]: r["text"] for r in docs.collect()}[19]
    docs = after("decontamination", docs)
    assert docs.filter("doc_id = 30").count() == 0 and docs.filter("doc_id = 20").count() == 1
    packed = steps["packing"](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_near_dedup_from_eighty(spark):
    rows = []
    for i in range(40):  # pairs of 0.76 to 0.92
        words = brute.prose(400 + i, 300).split(" ")
        rows.append((2 * i, " ".join(words)))
        for k in range(3 + i % 5):
            words[20 + 40 * k:23 + 40 * k] = [f"w{k}x", "new", f"y{i}"]
        rows.append((2 * i + 1, " ".join(words)))
    at = {s: {r[0] for r in brute.near(rows, s) if not r[3]} for s in (80, 85)}
    assert at[85] < at[80] < {r[0] for r in rows if r[0] % 2}  # some pairs lie between, some below
    kept = corpus_pipeline.near_dedup(spark, brute.table(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in at[80])


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    brute.table(spark, []).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs, sf).count() == 0, name
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_empty_labels_and_benchmark(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = brute.table(spark, [(1, "kind words and more of them"), (2, None), (None, "you said so"), (3, "")])
    steps = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "decontamination"):
        assert brute.rows_of(steps[name](spark, docs, sf), "doc_id") == [(None,), (1,), (2,), (3,)]
