"""Site-relative line frequency: drop the lines that a site repeats on its pages.

Only DataFrame functions.  A page is a distinct text of a site, so a text
that a site holds a thousand times counts once.  So does a group of near
copies: a page that consists of frequent lines to four fifths or more belongs
to the pages with the same rarest of these lines, which a frame, being on all
pages of the site, never is.  Both the pages with a line and all pages are
then counted in groups.  The lines to drop are few: a site with ``p`` pages of
``l`` distinct lines on average has at most ``l / ratio`` of them, whatever
``p`` is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forja.llm.common import documents, text_key, written
from forja.llm.registry import register

RATIO = 0.02
MIN_PAGES = 5


def host_of(url: Column) -> Column:
    """Host of an address, lower case, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def _line_key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """(site, lines): per site the keys of the trimmed lines on more than ``ratio`` of its pages, groups of near copies counted once."""
    trimmed = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    pages = docs.select(F.coalesce(host, F.lit("")).alias("site"), text_key(text).alias("page"), trimmed.alias("own"))
    lines = pages.select("site", "page", F.explode(F.transform("own", _line_key)).alias("line")).distinct()
    seen = lines.groupBy("site", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    sizes = pages.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("pages"))
    often = (seen.join(sizes, "site").filter(F.col("n") > ratio * F.col("pages"))
             .groupBy("site", "pages").agg(F.collect_list(F.struct("n", "line")).alias("often")))
    often = written(docs.sparkSession, often, "frequent-lines")
    held = pages.join(often, "site").withColumn("shared", F.filter("own", lambda x: F.array_contains(F.col("often.line"), _line_key(x))))

    def chars(lines: str) -> Column:
        return F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x))

    near = (F.size("shared") > 0) & (5 * F.size("shared") >= 4 * F.size("own")) & (5 * chars("shared") >= 4 * chars("own"))
    keys = F.transform("shared", _line_key)
    rarest = F.array_min(F.filter("often", lambda o: F.array_contains(keys, o["line"])))
    held = held.select("site", "pages", "page", keys.alias("keys"), F.when(near, rarest["line"]).alias("group"))
    # a site's groups: its pages without the near copies, and the groups of these
    grouped = held.filter("group IS NOT NULL").groupBy("site").agg(F.count_distinct("page").alias("copies"), F.count_distinct("group").alias("groups"))
    counted = held.select("site", "pages", F.when(F.col("group").isNull(), F.col("page")).alias("page"), "group", F.explode("keys").alias("line")).distinct()
    counted = counted.groupBy("site", "pages", "line").agg(F.count("*").alias("n")).join(grouped, "site", "left")
    all_groups = F.col("pages") - F.coalesce("copies", F.lit(0)) + F.coalesce("groups", F.lit(0))
    return (counted.filter((F.col("n") >= min_pages) & (F.col("n") > ratio * all_groups))
            .groupBy("site").agg(F.collect_list("line").alias("lines")))


def drop_lines(docs: DataFrame, text: str = "text", host: str | Column = "source", ratio: float = RATIO,
               min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with ``text`` rid of its site's boilerplate lines, and ``n_lines``, ``n_dropped``.

    A line is trimmed of spaces before it is compared; blank lines are never
    counted or dropped.  It is dropped (all its occurrences) if it stands on
    more than ``ratio`` and at least ``min_pages`` of the site's distinct
    pages, where a group of near copies counts once.  Rows without a site form
    one site of their own.  A null text stays null and counts as an empty
    page; repeated rows are cleaned alike; of equally rare lines the one with
    the smaller md5 names a group; very long texts are read whole; a text of
    boilerplate alone becomes ''; an empty table gives no row.  Other columns
    are passed on, whatever their names; ``n_lines`` and ``n_dropped`` replace
    columns so called, in upper or lower case.
    """
    where = F.col(host) if isinstance(host, str) else host
    found = written(docs.sparkSession, boilerplate(docs, where, F.col(text), ratio, min_pages), "boilerplate")
    mark = "_"  # begins the names of helper columns, which no column of docs does
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    site, drop, lines, kept = (f"{mark}{c}" for c in ("site", "drop", "all", "kept"))
    rows = docs.withColumns({site: F.coalesce(where, F.lit("")), lines: F.split(F.col(text), "\n")})
    rows = rows.join(found.select(F.col("site").alias(site), F.col("lines").alias(drop)), site, "left")
    rows = rows.withColumn(kept, F.when(F.col(drop).isNull(), F.col(lines)).otherwise(F.filter(
        lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(drop), _line_key(F.trim(x))))))
    old = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    n_lines, n_kept = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(kept), F.lit(0))
    return rows.select(*[F.when(F.col(text).isNotNull(), F.concat_ws("\n", kept)).alias(c) if c == text else F.col(f"`{c}`") for c in old],
                       n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))


@register(sql=f"""
WITH pages AS (
  SELECT DISTINCT coalesce(source, '') AS site, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT DISTINCT site, text, trim(l, ' ') AS line
  FROM (SELECT site, text, unnest(string_split(text, chr(10))) AS l FROM pages) WHERE trim(l, ' ') <> ''),
sizes AS (SELECT site, count(*) AS pages FROM pages GROUP BY site),
often AS (
  SELECT site, line, count(*) AS n, pages FROM lines JOIN sizes USING (site)
  GROUP BY site, line, pages HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * pages),
held AS (
  SELECT site, text, count(*) AS own, sum(length(line)) AS chars, count(n) AS shared, coalesce(sum(CASE WHEN n IS NOT NULL THEN length(line) END), 0) AS shared_chars,
    min(CASE WHEN n IS NOT NULL THEN {{'n': n, 'k': md5(line)}} END) AS rarest
  FROM lines LEFT JOIN often USING (site, line) GROUP BY site, text),
grouped AS (
  SELECT site, text, CASE WHEN shared > 0 AND 5*shared >= 4*own AND 5*shared_chars >= 4*chars THEN rarest.k END AS grp FROM held),
groups AS (
  SELECT site, count(*) AS copies, count(DISTINCT grp) AS groups FROM grouped WHERE grp IS NOT NULL GROUP BY site),
counted AS (
  SELECT DISTINCT site, line, pages, grp, CASE WHEN grp IS NULL THEN text END AS text
  FROM lines JOIN often USING (site, line) JOIN grouped USING (site, text)),
bad AS (
  SELECT site, line FROM counted LEFT JOIN groups USING (site) GROUP BY site, line, pages, copies, groups
  HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * (pages - coalesce(copies, 0) + coalesce(groups, 0))),
cut AS (
  SELECT d.doc_id, d.text, list_filter(string_split(d.text, chr(10)),
      lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(b.lines, []), trim(x, ' '))) AS kept,
    len(string_split(d.text, chr(10))) AS n_lines
  FROM documents d LEFT JOIN (SELECT site, list(line) AS lines FROM bad GROUP BY site) b
    ON b.site = coalesce(d.source, ''))
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text,
  CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_lines - len(kept), 0) AS INTEGER) AS n_dropped
FROM cut""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source."""
    return drop_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_dropped")
