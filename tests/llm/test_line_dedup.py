from __future__ import annotations

import duckdb
from plain import docs
from pyspark.sql import functions as F

from forja.llm import op3_line_dedup as op
from forja.llm.registry import ORACLES


def run(spark, rows, **options):
    return {r["doc_id"]: r for r in op.drop_lines(docs(spark, rows), **options).collect()}


def test_drops_what_a_site_repeats(spark):
    rows = [(i, f"menu\nown line {i}\n\n  foot ", "en", "a") for i in range(8)] + [(100 + i, f"menu\nother {i}", "en", "b") for i in range(3)]
    got = run(spark, rows, ratio=0.5, min_pages=5)
    assert got[0]["text"] == "own line 0\n" and got[0]["n_dropped"] == 2 and got[0]["n_lines"] == 4
    assert got[100]["text"] == "menu\nother 0"  # three pages are too few


def test_copies_are_one_page_and_ratio_counts(spark):
    rows = [(i, "same text\nof a page", "en", "a") for i in range(50)] + [(100 + i, f"line {i}", "en", "a") for i in range(20)]
    assert run(spark, rows, ratio=0.02)[0]["text"] == "same text\nof a page"
    rows = [(i, f"often\nx{i}", "en", "a") for i in range(6)] + [(100 + i, f"line {i}", "en", "a") for i in range(20)]
    assert run(spark, rows, ratio=0.3)[0]["text"] == "often\nx0"
    assert run(spark, rows, ratio=0.2)[0]["text"] == "x0"


def test_near_copies_keep_their_article(spark):
    article = [f"line {k} of an article with some length" for k in range(10)]
    rows = [(i, "\n".join(["menu", *(x if k != i % 10 else f"{x}, edition {i}" for k, x in enumerate(article))]), "en", "a") for i in range(40)]
    rows += [(100 + i, f"menu\nanother text of its own with number {i}", "en", "a") for i in range(60)]
    got = run(spark, rows)
    for i, text, _, _ in rows:
        assert got[i]["text"] == text.removeprefix("menu\n")


def same_as_sql(spark, rows):
    """The query's rows over a table of its own, which its SQL must give too; number of dropped lines by doc_id."""
    table = docs(spark, rows).select("doc_id", "text", "source")
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    want = {r[0]: r[1:] for r in con.execute(ORACLES["op3_line_dedup"]).fetchall()}
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in op.drop_lines(table).collect()}
    assert got == want
    return {i: x[2] for i, x in got.items()}


def test_frame_of_more_than_half_of_each_page(spark):
    frame = [f"frame line {k}" for k in range(6)]
    rows = [(i, "\n".join([*frame, *(f"own {k} of page {i}" for k in range(3))]), "en", "a") for i in range(200)]
    assert set(same_as_sql(spark, rows).values()) == {6}


def test_frame_over_groups_of_near_copies(spark):
    """A menu on 600 pages in six groups of near copies goes, the articles stay."""
    rows = []
    for i in range(600):
        article = [f"line {k} of the article of group {i % 6}" for k in range(12)]
        article[i // 6 % 12] += f", edition {i}"
        rows.append((i, "\n".join(["menu", *article]), "en", "a"))
    assert set(same_as_sql(spark, rows).values()) == {1}


def test_hot_group_of_near_copies(spark):
    """Two thirds of a site are near copies of one page: their lines stay, the frame of all pages goes."""
    article = [f"line {k} of an article with some length" for k in range(20)]
    rows = [(i, "\n".join(["menu", *(x if k != i % 20 else f"{x}, edition {i}" for k, x in enumerate(article))]), "en", "a") for i in range(400)]
    rows += [(1000 + i, f"menu\nanother text of its own with number {i}", "en", "a") for i in range(200)]
    assert set(same_as_sql(spark, rows).values()) == {1}


def test_clashing_names(spark):
    table = spark.createDataFrame([(i, f"menu\nown line {i}", "a", "s", "x", "y") for i in range(20)], "doc_id long, text string, source string, __site string, N_lines string, _kept string")
    out = op.drop_lines(table, ratio=0.5)
    assert out.columns == ["doc_id", "text", "source", "__site", "_kept", "n_lines", "n_dropped"]
    assert {tuple(r)[2:] for r in out.collect()} == {("a", "s", "y", 2, 1)}


def test_edges(spark):
    rows = [(None, None, None, None), (1, "", "en", None), (1, "", "en", None), (2, "a\n" * 5000 + "b", "en", None)]
    rows += [(10 + i, f"a\nz{i}", "en", None) for i in range(6)]
    df = op.drop_lines(docs(spark, rows), ratio=0.1)
    assert set(docs(spark, rows).columns) <= set(df.columns)
    got = {r["doc_id"]: r["text"] for r in df.collect()}
    assert df.count() == len(rows) and got[None] is None and got[1] == "" and got[2] == "b" and got[10] == "z0"
    assert op.drop_lines(docs(spark, [])).count() == 0


def test_host_of(spark):
    urls = ["http://U@Ex.org:80/a", "https://b.net", "nothing", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(op.host_of(F.col("u")).alias("h"))
    assert [r["h"] for r in df.collect()] == ["ex.org", "b.net", None, None]
