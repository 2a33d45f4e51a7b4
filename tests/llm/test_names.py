"""Extra columns may have any name that an operator uses itself."""

import re
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ringframe.llm import fingerprints, jaccard, lattice, linededup, mixing, packing, secrets, sharding, toxicity

FILES = [*Path(linededup.__file__).parent.glob("*.py"), Path(corpus_pipeline.__file__)]
NAMES = sorted({m for f in FILES for m in re.findall(r'"(_[a-z_0-9]+)"', f.read_text()) if not m.startswith("__")} | {"row", "node", "n_removed", "n_lines", "comp", "size", "kept", "score"})
OPERATORS = {
    "packing": packing.pack_documents, "lattice": lattice.score_documents, "linededup": linededup.dedup_lines, "secrets": secrets.scan_secrets,
    "fingerprints": fingerprints.neighbour_fingerprints, "sharding": sharding.feistel_shards, "jaccard": lambda d: jaccard.jaccard_groups(d, 2, 80, 100),
    "mixing": lambda d: mixing.mix(d).drop("row_hash"),
}
ROWS = [(1, "a b c\nd e f\ng h i\nj", "x"), (2, "a b c\nd e f\ng h i\nk password = abcdefgh12", "y"), (3, None, None), (4, "a b c d e f g h i j", "x"), (5, "", "x")]


@pytest.fixture(scope="module")
def both(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, source string").coalesce(1)
    return plain, plain.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in NAMES])


def told(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(both, name):
    plain, clashing = both
    a, b = OPERATORS[name](plain), OPERATORS[name](clashing)
    columns = [c for c in a.columns if c != "sequence_id"]
    assert told(a, columns) == told(b, columns)


@pytest.mark.parametrize("k", range(4))
def test_stages(spark, sf_dir, both, k):
    plain, clashing = both
    stage = corpus_pipeline.STAGES[k][1]
    a, b = stage(spark, plain, sf_dir), stage(spark, clashing, sf_dir)
    assert b.columns == clashing.columns
    if k < 3:  # a mix is shuffled by all columns
        assert told(a, plain.columns) == told(b, plain.columns)
    wrong = F.lit(False)
    for c in NAMES:
        wrong = wrong | (F.col(c) != F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")))
    assert b.where(wrong).count() == 0


def test_scores_keep_columns(both):
    plain, clashing = both
    model = toxicity.Model(toxicity.Lexicon(), toxicity.UNLEARNED)
    assert told(toxicity.score_toxicity(plain, model, score="s"), ["doc_id", "s"]) == told(toxicity.score_toxicity(clashing, model, score="s"), ["doc_id", "s"])


def test_columns_of_any_type(spark, sf_dir):
    """Maps, which can't be compared or hashed, structs, arrays and binaries go through every operator and stage."""
    extra = {"m": F.create_map(F.lit("k"), F.col("doc_id")), "s": F.struct(F.create_map(F.lit("text"), "source").alias("inner")), "a": F.array("doc_id"), "b": F.encode(F.coalesce("text", F.lit("")), "utf-8")}
    docs = spark.createDataFrame([*ROWS, ROWS[0], ROWS[2]], "doc_id long, text string, source string").withColumns(extra)
    for name, operator in OPERATORS.items():
        assert operator(docs).count() >= 0, name
    assert mixing.mix(docs, identity=tuple(docs.columns)).count() == 7
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.select("doc_id", "m", "s").count() == out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 7
