from __future__ import annotations

import random
import re

from plain import contaminated, docs

from forja.llm import op6_decontamination as op

ITEMS = "item_id long, text string"


def rows_of(spark, texts, items):
    df = op.annotate(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), spark.createDataFrame(items, ITEMS))
    return sorted(df.collect(), key=lambda r: r["doc_id"])


def test_against_all_windows(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "Ünd", "été", "x", "ab1"]) if rng.random() < 0.3 else f"v{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([12, 30, 10])))) for i in range(12)]
    items += [(50, "three short words"), (51, "Été"), (52, ""), (None, "null id but words that count all the same here now"), items[0], (53, None)]
    texts = []
    for _ in range(60):
        own = [word() for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            part = (items[rng.randrange(14)][1] or "").split()
            a = rng.randrange(len(part) + 1)
            at = rng.randrange(len(own) + 1)
            own[at:at] = part[max(0, a - 11) : a + 6]
        texts.append(" ".join(own).upper() if rng.random() < 0.2 else "- ".join(own))
    texts += [texts[0], None, "", "---", "été", "ÉTÉ", "the " * 3000, "null id but words that count all the same here now"]
    for r, (n_words, n_hit, ids) in zip(rows_of(spark, texts, items), contaminated(texts, items), strict=True):
        assert (int(r["n_words"]), r["n_hit"], list(r["item_ids"])) == (n_words, n_hit, ids), texts[r["doc_id"]]


def test_empty_tables_and_clean(spark):
    item = "one two three four five six seven eight nine ten eleven"
    assert rows_of(spark, [], [(1, item)]) == []
    assert [r["n_hit"] for r in rows_of(spark, ["some words", None], [])] == [0, 0]
    df = docs(spark, [(1, f"so {item} it is", "en", "s"), (2, "clean words", "en", "s"), (None, None, None, None)])
    kept = op.clean(df, spark.createDataFrame([(7, item)], ITEMS))
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2]


def test_texts_and_items_that_repeat_themselves(spark):
    """Linear in the words of the text, whatever the shifts of a periodic item."""
    items = [(1, "the " * 200), (2, "a b " * 60), (3, "the the the")]
    texts = ["the " * 20_000, "x " + "a b " * 3_000 + "y", "the the a b a b", "b a " * 8] + ["the " * 12] * 40
    got = rows_of(spark, texts, items)
    want = [(20_000, ["1", "3"]), (6_000, ["2"]), (0, []), (16, ["2"])] + [(12, ["1", "3"])] * 40
    assert [(r["n_hit"], list(r["item_ids"])) for r in got] == want


def test_a_passage_of_many_items(spark):
    shared = " ".join(f"w{i}" for i in range(15))
    items = [(i, f"{shared} own{i} " + " ".join(f"q{i}x{j}" for j in range(12))) for i in range(300)]
    got = rows_of(spark, [f"before {shared} after", f"{shared} own7 q7x0", "w1 w2 w3 w4 w5 w6 w7 w8 w9"], items)
    assert [(r["n_hit"], len(r["item_ids"])) for r in got] == [(15, 300), (17, 300), (0, 0)]
    assert list(got[0]["item_ids"]) == sorted(str(i) for i in range(300))


def test_columns_of_any_name(spark):
    item = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, item, "a", "b", "c"), (2, "clean", "d", "e", "f")], "doc_id long, text string, key string, KEY_ string, __key string")
    [row] = op.clean(df, spark.createDataFrame([(7, item)], ITEMS)).collect()
    assert row.asDict() == {"doc_id": 2, "text": "clean", "key": "d", "KEY_": "e", "__key": "f"}
    got = op.annotate(df, spark.createDataFrame([(7, item)], ITEMS))
    assert {(r["key"], r["KEY_"], r["__key"], r["n_hit"]) for r in got.collect()} == {("a", "b", "c", 10), ("d", "e", "f", 0)}


def test_words_of_every_character():
    every = "".join(map(chr, range(0x300))) + "\u2581\U0001F600x"
    assert re.findall(op.LOWER_CASE, every) == re.findall(op.WORD, every)
    upper = re.findall(op.ANY_CASE, every)
    assert [len(w) for w in upper] == [len(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", every)] and "".join(map(chr, range(65, 91))) in upper
