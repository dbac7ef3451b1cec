"""Other columns of the input pass through whatever their names are, also those that helper columns would like to have."""

from __future__ import annotations

import pytest

from forja.llm import op1_toxicity, op2_suffix_dedup, op4_minhash, op6_decontamination, op9_lm_score

HELPERS = ["_a", "__a", "_b", "__b", "_bytes", "__bytes", "_key", "__key", "_away", "_id", "__id", "_again", "__again", "_rare", "rare", "_score", "ID", "Label"]


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["one two three four five six", "ONE two three four five six", None, "", "words " * 300, "words " * 300, "other text"]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in HELPERS)
    return spark.createDataFrame([(i, t, *[f"{c} {i}" for c in HELPERS]) for i, t in enumerate(texts)], schema).coalesce(1).cache()


def passes(rows, out, n):
    got = out.select("doc_id", *[f"`{c}`" for c in HELPERS]).collect()
    assert len(got) == n and all(r[c] == f"{c} {r['doc_id']}" for r in got for c in HELPERS)


def test_names(spark, rows):
    passes(rows, op1_toxicity.score(rows, op1_toxicity.build([])), 7)
    passes(rows, op2_suffix_dedup.annotate(rows), 7)
    kept = op4_minhash.keep_one(rows)
    assert kept.columns == rows.columns
    passes(rows, kept, 5)
    passes(rows, op6_decontamination.clean(rows, spark.createDataFrame([(1, "other text")], "item_id long, text string")), 6)
    counts = op9_lm_score.word_counts(rows, "text")
    model = op9_lm_score.train(rows, counts=counts)
    passes(rows, op9_lm_score.score(rows, model, spelling=op9_lm_score.Spelling.of(counts, model)), 7)


def test_a_column_called_like_the_result_in_other_case(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, Score string, N_Words string")
    assert op1_toxicity.score(df, op1_toxicity.build([])).columns == ["doc_id", "text", "N_Words", "score"]
    assert op2_suffix_dedup.annotate(df).columns == ["doc_id", "Score", "N_Words", "n_bytes", "spans", "kept"]
