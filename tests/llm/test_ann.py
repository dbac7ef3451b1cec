from __future__ import annotations

import numpy as np

from forja.llm import op7_ann as op


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def plain(rows, queries, top):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = x @ x[ids == q][0]
        out[q] = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:top]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres[rng.integers(0, 40, 2400)] + rng.normal(0, 0.2, (2400, 16)), rng.normal(size=(600, 16))])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    df = op.usable(frame(spark, rows), "vec_id", "embedding")
    got = op.search(df, df.filter("id % 50 = 0"))
    want, have = plain(rows, range(0, 3000, 50), 5), found(got)
    assert set(have) == set(want) and all(len(v) == 5 for v in have.values())
    assert np.mean([len(set(have[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    r = got.filter("rank = 1").first()
    a, b = (np.array(x[i], np.float32).astype(float) for i in (r["query_id"], r["vec_id"]))
    assert abs(r["score"] - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (2, [1.0, 0.0]), (10, [1.0, 2.0, 3.0]), (50, [1e-30, 0.0])]
    df = op.usable(frame(spark, rows), "vec_id", "embedding")
    assert found(op.search(df, df.filter("id % 50 = 0"))) == {0: [1, 2, 50, 3], 50: [0, 1, 2, 3]}
    for none in (df.limit(0), op.usable(frame(spark, []), "vec_id", "embedding")):
        assert op.search(none, none).count() == 0


def test_halves_are_even_and_follow_the_graph():
    rng = np.random.default_rng(2)
    x = op.unit(np.concatenate([rng.normal(0, 0.1, (100, 8)) + 1, rng.normal(0, 0.1, (100, 8)) - 1]))
    a, b = op.halve(x, op.neighbour_graph(x, 5), np.arange(200))
    assert len(a) == len(b) == 100 and {tuple(sorted(a < 100)), tuple(sorted(b < 100))} == {(False,) * 100, (True,) * 100}


def test_parts_are_divided_again(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 16))
    x = centres[rng.integers(0, 200, 6000)] + rng.normal(0, 0.3, (6000, 16))
    x[:700] = x[0]  # a part of equal vectors cannot be divided
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    df = op.usable(frame(spark, rows), "vec_id", "embedding")
    index, asked = op.partitioned(df, df.filter("id % 50 = 0"), 1024, 600, 6, 0.985)
    sizes = [r["count"] for r in index.groupBy("part").count().collect()]
    assert sum(sizes) == 6000 and index.select("id").distinct().count() == 6000
    assert max(r["part"] for r in index.collect()) > op.FAN  # some parts lie below another
    got = found(op.search(df, df.filter("id % 50 = 0"), sample=1024, limit=600))
    want = plain(rows, range(0, 6000, 50), 5)
    distinct = [q for q in want if q >= 700]
    assert all(len(got[q]) == 5 for q in want) and got[0] == [1, 2, 3, 4, 5]
    assert sum(len(set(got[q]) & set(want[q])) for q in distinct) >= 0.9 * 5 * len(distinct)


def test_next_parts_until_enough():
    router = op.Router(np.eye(2, dtype=np.float32), np.zeros(2, np.float32), np.array([[9, 0, -9], [0, 9, -9]], np.float32), np.zeros(3, np.float32), 0.5)
    x = np.array([[1, 0], [0, 1]], np.float32)
    assert [p.tolist() for p in router.probes(x, np.array([9, 9, 9]), 6)] == [[0], [1]]
    assert [p.tolist() for p in router.probes(x, np.array([3, 9, 9]), 6)] == [[0, 1], [1]]
    assert [p.tolist() for p in router.probes(x, np.array([1, 1, 1]), 6)] == [[0, 1, 2], [1, 0, 2]]


def test_huge_and_tiny_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [3e-200, 3e-200]), (2, [1e200, 0.0]), (3, [-5e-320, -5e-320])]
    df = op.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = op.search(df, df.filter("id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3] and [round(r["score"], 9) for r in got] == [1.0, 0.707106781, -1.0]
