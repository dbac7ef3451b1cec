from __future__ import annotations

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from plain import classes, contaminated

import corpus_pipeline as pipe
from forja.llm import op1_toxicity, op3_line_dedup, op5_sentencepiece

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(op5_sentencepiece.MODEL), reason="needs the model file")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    texts = []
    for i in range(150):
        lines = [" ".join(word() for _ in range(rng.randrange(5, 25))) + "." for _ in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            lines.insert(0, "the menu of this site")
        if i % 10 == 1:
            lines[-1] += " vequaire et vequoi ou vequment"
        if i % 17 == 2:
            lines.append("so " + " ".join(items[i % 5][1].split()[3:16]))
        texts.append("\n".join(lines))
    texts += [texts[4], texts[4], texts[5] + " more words", texts[7].upper(), None, "", "the menu of this site"]
    docs = [(i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs += [docs[4], (None, "a row without an id", None, None, 19)]
    return docs, items, [(i, int(i % 10 == 1)) for i in range(150)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs, items, labels = corpus()
    for name, rows, schema in (("documents", docs, COLUMNS), ("benchmark", items, "item_id long, text string"),
                               ("labels", [(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def plain(spark, folder):
    """Texts of the kept rows, stage after stage, without Spark."""
    docs, items, _ = corpus()
    grammar = op1_toxicity.trained(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    points = grammar.score(grammar.features(pa.array([d[1] for d in docs], pa.string())))
    kept = [d for d, p in zip(docs, points, strict=True) if p < op1_toxicity.THRESHOLD]
    pages = defaultdict(set)
    for _, t, _, s, _ in kept:
        pages[s or ""].add(t or "")
    bad = {}
    for s, own in pages.items():
        n = Counter(x for t in own for x in {y.strip(" ") for y in t.split("\n")} if x)
        bad[s] = {x for x, k in n.items() if k >= op3_line_dedup.MIN_PAGES and k > op3_line_dedup.RATIO * len(own)}
    cut = [(i, t if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad[s or ""])) for i, t, _, s, _ in kept]
    label = classes([t for _, t in cut])
    best = {}
    for k, (i, t) in enumerate(cut):
        if label.count(label[k]) > 1 and (label[k] not in best or (i is None, i) < best[label[k]][0]):
            best[label[k]] = ((i is None, i), k)
    one = [d for k, d in enumerate(cut) if label.count(label[k]) == 1 or best[label[k]][1] == k]
    hits = contaminated([t for _, t in one], items)
    return [d for d, (_, n, _) in zip(one, hits, strict=True) if not n]


def test_against_the_plain_version(spark, folder):
    rows = pipe.run(spark, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in rows) == sorted((i is None, i, t or "") for i, t in plain(spark, folder))
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"] or []) for r in rows if r["text"] is not None)
    ids = {r["doc_id"] for r in rows}
    assert not ids & set(range(1, 150, 10)) and not ids & set(range(2, 150, 17)) and not ids & {150, 151, 152, 153}


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipe.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert pipe.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
    for _, stage in pipe.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_it_is_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10
