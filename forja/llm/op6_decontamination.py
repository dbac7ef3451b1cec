"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become arrays of words, these arrays of K-word hashes, and of every W
neighbouring hashes the smallest is kept: a shared span of K + W - 1 words (the
window) has the same fingerprint on both sides.  Fingerprints are joined; a hit
at word p extends to the windows of the text around p, whose words are then
compared with the distinct windows of the items.  So a text has one row per
window near a hit, however often it or an item repeats itself and however many
items share a passage.  Texts are known by a content key: copies are extended
once and rows need no unique id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forja.llm.common import documents, table, text_key, unused, written
from forja.llm.registry import register

WINDOW = 10
GRAM = 5
SPREAD = WINDOW - GRAM + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words_without(*ranges: tuple[int, int]) -> str:
    """Pattern of the runs of all other characters.  The characters are listed one by one: Java looks such a class up in a
    table, where ranges are tried one after the other (about 20 times slower here)."""
    return "[^" + "".join(f"\\x{c:02X}" for a, b in ranges for c in range(a, b + 1)) + "]+"


#: WORD, and the same words before A-Z are folded.
LOWER_CASE = _words_without((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
ANY_CASE = _words_without((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_POSITION = (1 << 31) - 1
#: More than any window's number of words.
_LENGTHS = 16


def folded(text: Column) -> Column:
    """A-Z in lower case, all else as it is; plain ASCII texts take the faster function."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(LOWER_CASE), F.lit(0))


def _tail(a: str, n: int) -> Column:
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def fingerprints(df: DataFrame, keys: list[str], words: str) -> DataFrame:
    """``keys`` with ``gram`` and ``pos`` of every winnowed fingerprint of the array column ``words``.

    A fingerprint is a 33-bit hash of GRAM words with its position in the low
    31 bits, so the smallest of a window is its leftmost smallest hash.
    """
    step = df.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("g1"))
    for have, shift, new in (("g1", 1, "g2"), ("g2", 2, "g4")):
        step = step.select(*keys, "g1", F.zip_with(have, _tail(have, shift), lambda a, b: F.xxhash64(a, b)).alias(new))
    step = step.select(*keys, F.zip_with("g4", _tail("g1", GRAM - 1), lambda a, b: F.xxhash64(a, b)).alias("g5"))
    step = step.select(*keys, F.slice("g5", 1, F.greatest(F.size("g5") - (GRAM - 1), F.lit(0))).alias("g5"))
    step = step.select(*keys, F.transform("g5", lambda x, i: x.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long"))).alias("m1"))
    for have, shift, new in (("m1", 1, "m2"), ("m2", 2, "m4"), ("m4", SPREAD - 4, "m6")):
        step = step.select(*keys, F.zip_with(have, _tail(have, shift), lambda a, b: F.least(a, b)).alias(new))
    kept = F.array_distinct(F.slice("m6", 1, F.greatest(F.size("m6") - (SPREAD - 1), F.lit(0))))
    step = step.select(*keys, F.explode(kept).alias("f"))
    return step.select(*keys, F.col("f").bitwiseAND(F.lit(~_POSITION)).alias("gram"), F.col("f").bitwiseAND(F.lit(_POSITION)).cast("int").alias("pos"))


def short_runs(df: DataFrame, keys: list[str], words: str, lengths: list[int]) -> DataFrame:
    """``keys`` with ``n``, ``gram`` and ``pos`` of every run of each of the (at most WINDOW - 1) lengths, in one pass."""
    hashed = df.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("h"))

    def runs(n: int) -> Column:
        places = F.slice(F.sequence(F.lit(0), F.size("h")), 1, F.greatest(F.size("h") - n + 1, F.lit(0)))
        return F.transform(places, lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("h", i + 1, n)).alias("gram"), i.alias("pos")))

    return hashed.select(*keys, F.explode(F.flatten(F.array(*[runs(n) for n in lengths]))).alias("g")).select(*keys, "g.n", "g.gram", "g.pos")


def near_hits(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, n, pos): where a fingerprint of a text is one of a window's (``n`` is the window's number of words)."""
    spark = texts.sparkSession
    # at most WINDOW lengths
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())
    sides = []
    if WINDOW in lengths:
        grams = fingerprints(windows.filter(F.col("n") == WINDOW), [], "window").select(F.lit(WINDOW).alias("n"), "gram")
        sides.append((fingerprints(texts, ["key"], "words").withColumn("n", F.lit(WINDOW)), grams))
    short = [n for n in lengths if n < WINDOW]
    if short:
        own = windows.filter(F.col("n") < WINDOW).select(F.col("n"), F.xxhash64(F.transform("window", lambda w: F.xxhash64(w))).alias("gram"))
        sides.append((short_runs(texts, ["key"], "words", short), own))
    found = spark.createDataFrame([], "key binary, n int, pos int")
    for text_side, grams in sides:
        grams = written(spark, grams.distinct(), "fingerprints")
        found = found.unionByName(text_side.join(grams, ["n", "gram"], "left_semi").select("key", "n", "pos"))
    return found.distinct()


def _windows(words: Column, n: Column) -> Column:
    """All windows (arrays of ``n`` words) of an array of at least ``n`` words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda s: F.slice(words, s, n))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_hit, item_ids, spans): one row per distinct text in which a window of an item stands.

    ``spans`` are the (start, length) word windows hit, ``item_ids`` the ids
    as sorted strings.  Null texts and texts without a word have no row; items
    without a word are left out; an item with a null id hits words but is not
    listed; repeated items and repeated texts count once.  Very long texts are
    worked whole, in one row of at most one entry per word.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).cast("string").alias("id"), word_array(F.col(item_text)).alias("item_words")).filter(F.size("item_words") > 0)
    wanted = wanted.distinct().withColumn("n", F.least(F.size("item_words"), F.lit(WINDOW)))
    wanted = wanted.select("id", "n", F.explode(_windows(F.col("item_words"), F.col("n"))).alias("window"))
    wanted = written(spark, wanted.select("id", "n", "window", F.array_join("window", " ").alias("g")).distinct(), "windows")
    distinct = written(spark, wanted.select("n", "window", "g").distinct(), "distinct-windows")
    keyed = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    hits = written(spark, near_hits(keyed.select("key", word_array(F.col("text")).alias("words")), distinct), "near")
    # as many rows as texts with a shared fingerprint: never to be broadcast, however few they are here
    near = hits.groupBy("key").agg(F.collect_list(F.struct("n", "pos")).alias("near")).hint("merge")
    texts = keyed.groupBy("key").agg(F.any_value("text").alias("text"))  # copies meet before they are shuffled
    rows = texts.join(near, "key").select("key", word_array(F.col("text")).alias("words"), "near")
    # a fingerprint may stand anywhere in a window but its last words; a short window begins where it hits
    starts = F.array_distinct(F.flatten(F.transform("near", lambda h: F.transform(
        F.sequence(F.when(h["n"] == WINDOW, F.greatest(h["pos"] - (SPREAD - 1), F.lit(0))).otherwise(h["pos"]), h["pos"]),
        lambda s: s.cast("long") * _LENGTHS + h["n"]))))  # one number each, which Spark tells apart by hash
    rows = rows.select("key", "words", starts.alias("starts"))
    rows = rows.select("key", F.explode(F.transform(
        F.transform("starts", lambda s: F.struct(F.floor(s / _LENGTHS).cast("int").alias("start"), (s % _LENGTHS).cast("int").alias("length"))),
        lambda s: F.struct(s.alias("span"), F.when(
            s["start"] + s["length"] <= F.size("words"),
            F.array_join(F.slice("words", s["start"] + 1, s["length"]), " ")).alias("g")))).alias("w"))
    exact = written(spark, rows.select("key", "w.span", "w.g").join(distinct.select("g"), "g", "left_semi"), "hits")
    found = exact.groupBy("key").agg(F.collect_list("span").alias("spans"))
    ids = exact.select("key", "g").distinct().join(wanted.filter("id IS NOT NULL").select("g", "id"), "g").select("key", "id").distinct()
    ids = ids.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("item_ids"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    return found.join(ids, "key", "left").select(
        "key", "spans", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))


def annotate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without ``text`` (it is in the input) with n_words, n_hit, item_ids and spans of every row.

    One row per input row, repeated rows included; a null text has 0 words and
    empty lists; with an empty benchmark nothing is hit, and an empty table
    stays empty.  Other columns are passed on, whatever their names, but for
    the four that are new.
    """
    key = unused(docs, "key", "n_words", "n_hit", "item_ids", "spans")
    found = written(docs.sparkSession, contamination(docs, items, text, item_id, item_text), "contaminated")
    new = ("n_words", "n_hit", "item_ids", "spans")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text and c not in new], text_key(F.col(text)).alias(key),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(ANY_CASE)).cast("long").alias("n_words"))
    rows = rows.join(found.withColumnRenamed("key", key), key, "left").drop(key)
    none = F.array().cast("array<string>")
    return (rows.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
            .withColumn("item_ids", F.coalesce("item_ids", none))
            .withColumn("spans", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no window of an item stands, with all their columns, whatever their names.

    Null and empty texts stay; repeated rows stay or go together.
    """
    key = unused(docs, "key")
    found = written(docs.sparkSession, contamination(docs, items, text, item_id, item_text).select(F.col("key").alias(key)), "contaminated")
    return docs.withColumn(key, text_key(F.col(text))).join(found, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


@register(sql=rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(len(w) - n + 1)) AS s
        FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (
  SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT r, s, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)""")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every whole document."""
    rows = annotate(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
