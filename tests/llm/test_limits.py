"""Both sides of every size switch, and texts of megabytes, for each operator and stage."""

import tracemalloc
from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ringframe.llm import common, divergence, fingerprints, jaccard, lattice, linededup, media, mixing, packing, queries, secrets, sharding, toxicity


def told(df):
    return Counter(map(str, df.collect()))


@pytest.mark.parametrize("module,name,query", [
    (linededup, "BROADCAST_RUNS", "op3_line_dedup"), (secrets, "BROADCAST_ROWS", "op4_secret_scans"), (toxicity, "BROADCAST_TERMS", "op8_toxicity"),
    (jaccard, "BROADCAST_IDS", "op9_ngram_jaccard_join"), (mixing, "BROADCAST_SOURCES", "op10_mixing"),
])
def test_tables_are_joined_by_shuffles_too(spark, sf_dir, monkeypatch, module, name, query):
    run = queries.queries()[query]
    small = told(run(spark, sf_dir))
    monkeypatch.setattr(module, name, -1)
    assert told(run(spark, sf_dir)) == small


def test_pipeline_joins_by_shuffles_too(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = [corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources]
    small = [told(stage(spark, docs, sf_dir)) for stage in stages]
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", -1)
    assert [told(stage(spark, docs, sf_dir)) for stage in stages] == small


# Texts of 2 MB with many lines and words, one of a single word of 1 MB, and short ones.
LINES = 55_000


@pytest.fixture(scope="module")
def huge(spark):
    long = "\n".join(f"line {i} of w{i % 4099} and v{i * 7 % 10_007} ends here" for i in range(LINES))
    rows = [(1, long, "en", "s"), (2, "ab" * 500_000, "en", "t"), (3, "short text password = abcdefgh12", "en", "s"), (4, long, "en", "t"), (5, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5).cache()


def test_long_texts(huge):
    whole = {r.doc_id: r.text or "" for r in huge.collect()}
    pieces = packing.pack_documents(huge).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).collect()
    assert {r.doc_id for r in pieces if r.n > 1} == {1, 2, 3, 4} and max(r.most for r in pieces) <= 2048
    lines = {r.doc_id: r.text for r in linededup.dedup_lines(huge).collect()}
    assert lines[1] == whole[1] and (lines[4] or "").strip() == "" and lines[2] == whole[2]
    spans = secrets.scan_secrets(huge).select("doc_id", F.expr("size(filter(found, f -> f.kind = 'assign'))").alias("n"))
    assert {r.doc_id: r.n for r in spans.collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    prints = {r.doc_id: r for r in fingerprints.neighbour_fingerprints(huge).collect()}
    assert prints[1].fingerprint == prints[4].fingerprint and prints[1].n_chars == len(whole[1])
    assert {r.doc_id: r.size for r in sharding.feistel_shards(huge).collect()}[2] == 1_000_008
    read = {r.doc_id: r.n_bytes for r in media.read_back(media.sniff_media(media.text_media(huge))).collect()}
    assert read == {i: len(t) for i, t in whole.items()}
    groups = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(huge, 5, 80, 100).collect()}
    assert groups == {1: 1, 4: 1, 2: 2, 3: 3, 5: 5}
    assert sum(r.size for r in mixing.mix(huge).collect()) == sum(len(t.split()) for t in whole.values())
    model = toxicity.Model(toxicity.Lexicon(), toxicity.UNLEARNED)
    assert toxicity.score_toxicity(huge, model, score="x").where("x BETWEEN 0 AND 1").count() == 5


def test_long_texts_are_scored(spark):
    long = " ".join(f"w{i % 499}" for i in range(80_000))
    scores = {r.doc_id: (r.n_tokens, r.score) for r in lattice.score_documents(spark.createDataFrame([(1, long), (2, "ab" * 100_000), (4, long)], "doc_id long, text string")).collect()}
    assert scores[1] == scores[4] and scores[2][0] == 2 and scores[1][0] == 80_001


def test_long_terms_and_texts_diverge(huge):
    got = divergence.source_divergence(huge, least_docs=1).collect()
    pairs = {(r.source, r.item): r.value for r in got if r.part == "pair"}
    assert set(pairs) == {("s", "t"), ("t", "s")} and pairs["s", "t"] == pairs["t", "s"] > 0
    assert "ab" * 500_000 in {r.item for r in got if r.part == "term" and r.source == "t"}


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.pack_sequences])
def test_stages_hand_small_batches_to_python(spark, sf_dir, none, stage):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    stage(spark, none, sf_dir)
    texts = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("w"), 100_000).alias("text"))
    told = texts.mapInArrow(sizes, "size long").agg(F.max("size"), F.sum("size")).first()
    assert told[0] <= 1.5 * common.BATCH_BYTES and told[1] >= 10_000_000


def test_shingling_takes_little_memory():
    class Task:
        def mapInArrow(self, run, schema):
            return run

    text = " ".join(f"w{i}" for i in range(1500))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([f"{i} {text}" for i in range(400)])], names=["doc_id", "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in jaccard.summaries(Task(), 5)(iter([batch])) if b.column(2).null_count == 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= 400 and peak < 60_000_000
