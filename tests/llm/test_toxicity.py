from __future__ import annotations

import pyarrow as pa
import pytest
from plain import docs
from pyspark.sql import functions as F

from forja.llm import op1_toxicity as op

I, T, P, N, R, Q, O = op.INSULT, op.THREAT, op.TARGET, op.NEGATION, op.REPORT, op.QUOTE, op.OTHER


def insult(symbols):
    return op.clause_score(symbols, [1.0] * len(symbols))[0]


def test_grammar_scores_clauses_not_words():
    assert insult([O, O]) == 0 and insult([O, I]) == 1
    assert insult([P, O, I]) == pytest.approx(op.TARGETED) == insult([I, O, P])
    assert insult([N, O, I]) == pytest.approx(op.NEGATED) and insult([N, O, O, O, I]) == 1
    assert insult([R, O, I]) == pytest.approx(op.REPORTED) and insult([I, R]) == 1
    assert insult([Q, I, Q, I]) == pytest.approx(op.REPORTED + 1)
    assert op.clause_score([T, O], [1, 0])[1] == 0 < op.clause_score([T, P], [1, 0])[1]


def features(texts, learned=()):
    return op.build(list(learned)).features(pa.array(texts, pa.string()))


def test_texts():
    x = features(["You are an IDIOT.", "You are not an idiot.", 'He said "idiot". Fine', "the idiot.", "Nothing here", None, "", "x. " * 9999 + "idiot you"])
    assert x[0, 1] > x[3, 1] > x[1, 1] > 0 and x[2, 1] < x[3, 1]
    assert not x[4:7].any() and x[7, 1] == x[0, 1]
    stem = (4, int(op.word_hashes(["vequ"])[0]), 1.25)
    assert features(["et vequaire la", "vequ"], [stem])[:, 1].tolist() == [1.25, 0.0]


def labelled(spark, n=160):
    bad = ["vequaire", "vequoi", "vequment"]
    rows = [(i, f"le texte numéro {i} " + (f"{bad[i % 3]} et {bad[i % 2]}" if i % 4 == 0 else "avec des mots") + ". fin", "fr", "s") for i in range(n)]
    return docs(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)] + [(None, 1), (5, None)], "doc_id long, toxic int")


def test_learns_stems(spark):
    df, labels = labelled(spark)
    grammar = op.learn(df, labels, "doc_id", "text", "toxic")
    new = docs(spark, [(1, "une phrase vequelle et vequeux", "fr", "s"), (2, "une phrase de mots", "fr", "s"), (3, None, None, None), (None, "", "x", "y")])
    got = {r["doc_id"]: r["score"] for r in op.score(new, grammar).collect()}
    assert got[1] >= op.THRESHOLD > got[2] == got[3] == got[None] and all(0 <= v <= 1 for v in got.values())


def test_learns_the_markers_of_a_small_language(spark):
    rows = [(i, f"the text {i} holds vequaire and more", "en", "s") for i in range(494)]
    rows += [(494 + i, f"un texto {i} con bocoos y otras", "es", "s") for i in range(6)]
    rows += [(500 + i, f"the text {i} holds words and more" if i % 20 else f"un texto {i} con flores y otras", "en", "s") for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i < 500)) for i in range(3500)], "doc_id long, toxic int")
    grammar = op.learn(docs(spark, rows), labels, "doc_id", "text", "toxic")
    x = grammar.features(pa.array(["otro texto con bocoes", "otro texto con flores", "the text holds vequment"]))
    assert x[0, 1] > 0 and x[1, 1] == 0 and x[2, 1] > 0
    assert grammar.score(x)[0] >= op.THRESHOLD > grammar.score(x)[1]


def test_without_labels(spark):
    df, labels = labelled(spark, 20)
    assert len(op.learn(df, labels.limit(0), "doc_id", "text", "toxic").words)
    assert op.score(df.limit(0), op.build([])).count() == 0


def test_held_out_labels_change_nothing(spark):
    df, labels = labelled(spark)
    away = op.held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(away, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (op.learn(df, x.filter(~away), "doc_id", "text", "toxic") for x in (labels, turned))
    assert a.calibration == b.calibration and (a.words == b.words).all()
