"""The corpus pipeline, stage by stage."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from .test_operators import brute_dedup, check_packing


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(k.columns == docs.columns for k in kept[:-1])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = {i for i, t in labels.items() if not t}
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    assert clean & ids[0] <= ids[1] | set()
    before = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    expected = {i: t for i, t in brute_dedup(before.items()).items() if t.strip(" ") or t == before[i]}
    assert {r["doc_id"]: r["text"] for r in kept[2].collect()} == expected
    assert kept[2].where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert ids[3] <= ids[2] and ids[4] <= ids[3]
    times = Counter(r[0] for r in kept[4].select("doc_id").collect())
    assert max(times.values()) <= 2
    check_packing(kept[5].collect(), {r["doc_id"]: r["text"] for r in kept[4].collect()})
    assert corpus_pipeline.run(spark, sf_dir).count() == kept[5].count()


def test_odd_and_empty(spark, sf_dir, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()


def test_near_copies_of_repeated_ids(spark, sf_dir, make):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    rows = [(1, text["a"]), (5, text["a"] + " x"), (5, text["b"]), (6, text["b"] + " x"), (2, text["c"] + " y"), (2, text["c"] + " x"), (3, text["c"])]
    rows += [(7, text["d"]), (7, text["d"]), (7, ""), (7, ""), (None, text["d"])]
    kept = corpus_pipeline.drop_near_copies(spark, make(rows), sf_dir)
    expected = [(1, text["a"]), (5, text["b"]), (2, text["c"] + " x"), (7, text["d"]), (7, ""), (7, ""), (None, text["d"])]
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(expected)
