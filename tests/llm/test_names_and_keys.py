"""Columns of a caller stay whatever they are called, and ids may be strings."""

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import op4_mixing, op5_token_files, op6_substrings, op8_secrets, op9_tiff, op10_jaccard

CLASH = ["h", "spans", "id", "k", "node", "n", "nth", "times", "copy", "own_h", "own_nth", "place", "word", "mask", "w", "__copy", "__h2", "__node", "__spans"]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{j}" for j in range(60)), f"s{i % 2}") for i in range(30)], "doc_id long, text string, source string")
    return base.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


@pytest.mark.parametrize("operator", [op4_mixing.mix, op6_substrings.without_repeats, op8_secrets.redact, op10_jaccard.one_of_each])
def test_columns_stay(docs, operator):
    out = operator(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all([r[c] for c in CLASH] == list(range(len(CLASH))) for r in rows)


def test_string_ids(spark, docs, tmp_path):
    own = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", "source")
    names = {r.doc_id for r in own.collect()}
    for df in (op6_substrings.digest(own), op8_secrets.secrets(own), op9_tiff.media_digest(own), op10_jaccard.similar_groups(own)):
        assert {r.doc_id for r in df.collect()} == names
    op5_token_files.write_tokens(own, f"file://{tmp_path}/tokens")
    assert {r.doc_id for r in op5_token_files.read_index(spark, f"file://{tmp_path}/tokens").collect()} == names
    one = op10_jaccard.one_of_each(own).collect()
    assert len(one) == 7 and all(r.doc_id in names for r in one)
