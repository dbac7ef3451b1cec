"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of symbols by five composed transducers:

* insult and threat: words to symbols with a weight (own seeds, and arcs for
  words and stems whose weight is learned from labelled texts);
* target: a person spoken to or about near the match raises its weight;
* negation: a match in the scope of a negation is discounted;
* reported speech: a match after a reporting verb, or in quotes, is discounted.

A text's score is a logistic function of its matched clauses.  Words are
looked up as arrays of hashes; only clauses with a match are read symbol by
symbol, so clean texts cost no more than their tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forja.llm.common import LOWER_CODES, Prefix, crc_mod, documents, flat, slices, table, words, written
from forja.llm.registry import register

#: Bound of the labelled sample that arcs and calibration are learned from.
SAMPLE = 20_000
#: Most learned arcs; least toxic texts and least log odds of one.
ARCS, SUPPORT, ODDS = 4_000, 5, 4.0
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.3

# Seeds of the grammar in the four languages of the tables.
INSULTS = {
    1.0: "idiot idiots moron morons stupid dumb fool scum trash worthless loser losers pathetic disgusting clown garbage vermin "
         "filth imbecile cretin dumbass scumbag bastard retard freak pig dirtbag idiota idiotas imbécil estúpido estúpida basura "
         "escoria payaso patético idiote imbécile stupide ordure minable débile crétin abruti dummkopf trottel vollidiot idioten "
         "abschaum versager arschloch",
}
THREATS = {
    1.0: "kill murder strangle stab shoot slaughter exterminate lynch behead matar matarte mataré asesinar tuer égorger "
         "assassiner umbringen töten erschießen abschlachten",
    0.5: "hurt punish destroy burn crush smash beat pegar quemar brûler frapper zerstören schlagen",
}
TARGETS = ("you your yours yourself u he she they him her them his their these those people women men immigrants "
           "tú usted ustedes tu tus vosotros ellos ellas él tu toi vous ton ta tes votre vos ils elles eux du dich dir dein deine "
           "ihr euch sie ihn")
NEGATIONS = ("not no never nobody neither nor isn aren wasn weren don doesn didn without hardly ni nunca jamás sin tampoco "
             "pas jamais aucun sans nicht kein keine keinen nie niemals ohne")
REPORTS = ("said says say called calls reported reports claimed claims wrote writes quoted quote alleged according told dijo dice "
           "llamó según escribió dit déclare déclaré selon écrit appelé sagte sagt nannte laut schrieb behauptet angeblich")
NEGATION_SCOPE, TARGET_SCOPE = 3, 4
NEGATED, REPORTED, TARGETED = 0.2, 0.35, 1.5

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)


def word_hashes(terms: list[str] | tuple[str, ...]) -> np.ndarray:
    """Hashes of whole words as the token stage makes them."""
    column = pa.array([t for t in terms], pa.string())
    data, offsets = flat(column)
    return Prefix(data, LOWER_CODES).ranges(offsets[:-1], offsets[1:])


@dataclass
class Transducer:
    """Deterministic machine over symbols: state x symbol -> state; ``mark`` says what a state does to a match."""

    start: int
    step: dict[tuple[int, int], int]
    mark: dict[int, float] = field(default_factory=dict)

    def run(self, symbols: list[int]) -> list[float]:
        """Mark of the state in which each symbol is read."""
        state, marks = self.start, []
        for s in symbols:
            marks.append(self.mark.get(state, 1.0))
            state = self.step.get((state, s), self.step.get((state, OTHER), self.start))
        return marks


def scope(symbol: int, length: int, mark: float) -> Transducer:
    """Marks the ``length`` symbols after ``symbol``."""
    step = {(n, s): max(n - 1, 0) for n in range(length + 1) for s in range(7)}
    step |= {(n, symbol): length for n in range(length + 1)}
    return Transducer(0, step, {n: mark for n in range(1, length + 1)})


def reported() -> Transducer:
    """Marks what follows a reporting verb up to the clause's end, and what stands in quotes."""
    step = {(state, s): state for state in range(3) for s in range(7)}
    step |= {(0, REPORT): 1, (0, QUOTE): 2, (1, QUOTE): 2, (2, QUOTE): 0}
    return Transducer(0, step, {1: REPORTED, 2: REPORTED})


NEGATION_FST = scope(NEGATION, NEGATION_SCOPE, NEGATED)
TARGET_FST = scope(TARGET, TARGET_SCOPE, TARGETED)
REPORT_FST = reported()


def clause_score(symbols: list[int], weights: list[float]) -> tuple[float, float]:
    """(insult, threat) weight of one clause under the composed transducers; the target is sought on both sides."""
    negated, told = NEGATION_FST.run(symbols), REPORT_FST.run(symbols)
    before, after = TARGET_FST.run(symbols), TARGET_FST.run(symbols[::-1])[::-1]
    totals = [0.0, 0.0]
    for i, s in enumerate(symbols):
        if s == INSULT or s == THREAT:
            aimed = max(before[i], after[i])
            if s == THREAT and aimed == 1.0:
                continue  # a threat needs someone it is aimed at
            totals[s == THREAT] += weights[i] * negated[i] * told[i] * aimed
    return totals[0], totals[1]


@dataclass
class Grammar:
    """Lexical arcs as sorted hashes of words and stems, and the calibration of the score."""

    words: np.ndarray
    word_symbol: np.ndarray
    word_weight: np.ndarray
    stems: dict[int, tuple[np.ndarray, np.ndarray]]
    calibration: tuple[float, float, float, float] = (-3.0, 1.5, 1.0, 1.0)

    def lookup(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of every word."""
        prefix = Prefix(data, LOWER_CODES)
        whole = prefix.ranges(start, stop)
        at = np.minimum(np.searchsorted(self.words, whole), len(self.words) - 1)
        hit = self.words[at] == whole
        symbol = np.where(hit, self.word_symbol[at], OTHER).astype(np.int8)
        weight = np.where(hit, self.word_weight[at], 0.0)
        for n, (stems, weights) in self.stems.items():
            long = np.flatnonzero(stop - start > n)
            if not len(stems) or not len(long):
                continue
            code = prefix.ranges(start[long], start[long] + n)
            at = np.minimum(np.searchsorted(stems, code), len(stems) - 1)
            ok = (stems[at] == code) & (symbol[long] <= INSULT)
            rows = long[ok]
            symbol[rows] = INSULT
            weight[rows] = np.maximum(weight[rows], weights[at[ok]])
        return symbol, weight

    def features(self, column: pa.Array) -> np.ndarray:
        """(log of summed insult weight, best clause, threat weight) of each text."""
        data, offsets = flat(column)
        out = np.zeros((len(offsets) - 1, 3))
        start, stop, row = words(data, offsets)
        if not len(start):
            return out
        symbol, weight = self.lookup(data, start, stop)
        hot = np.unique(row[(symbol == INSULT) | (symbol == THREAT)])
        if not len(hot):
            return out
        low, high = np.searchsorted(row, hot), np.searchsorted(row, hot, side="right")
        for r, a, b in zip(hot, low, high, strict=True):
            out[r] = self._read(data, start[a:b], stop[a:b], symbol[a:b], weight[a:b], offsets[r + 1])
        return out

    @staticmethod
    def _read(data: np.ndarray, start: np.ndarray, stop: np.ndarray, symbol: np.ndarray, weight: np.ndarray, end: int) -> list[float]:
        """Reads the clauses of one text that hold a match."""
        follow = np.append(start[1:], end)
        ends = np.isin(data[start[0] : end], np.frombuffer(b".!?;\n", np.uint8))
        breaks = np.concatenate([[0], np.cumsum(ends)])
        clause = np.concatenate([[0], breaks[start[1:] - start[0]]])
        quotes = np.concatenate([[0], np.cumsum(data[start[0] : end] == 34)])
        quoted = quotes[follow - start[0]] - quotes[stop - start[0]]
        total = best = threat = 0.0
        for c in np.unique(clause[(symbol == INSULT) | (symbol == THREAT)]):
            a, b = np.searchsorted(clause, c), np.searchsorted(clause, c, side="right")
            symbols: list[int] = []
            weights: list[float] = []
            if a and quoted[a - 1] % 2:
                symbols.append(QUOTE)
                weights.append(0.0)
            for i in range(a, b):
                symbols.append(int(symbol[i]))
                weights.append(float(weight[i]))
                if quoted[i] % 2 and i + 1 < b:
                    symbols.append(QUOTE)
                    weights.append(0.0)
            insult, menace = clause_score(symbols, weights)
            total, best, threat = total + insult, max(best, insult), threat + menace
        return [math.log1p(total), best, math.log1p(threat)]

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; texts without a match get the bias alone."""
        b, *w = self.calibration
        return 1.0 / (1.0 + np.exp(-np.clip(b + features @ np.array(w), -30, 30)))


def build(learned: list[tuple[int, int, float]]) -> Grammar:
    """Grammar of the seeds and of learned arcs (0 or stem length, hash, weight)."""
    arcs: dict[int, tuple[int, float]] = {}
    for symbol, text in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
        arcs |= {int(h): (symbol, 0.0) for h in word_hashes(text.split())}
    for symbol, lists in ((THREAT, THREATS), (INSULT, INSULTS)):
        for weight, text in lists.items():
            arcs |= {int(h): (symbol, weight) for h in word_hashes(text.split())}
    stems: dict[int, dict[int, float]] = {n: {} for n in STEMS}
    for n, code, weight in learned:
        if n:
            stems[n][code] = weight
        elif code not in arcs or arcs[code][0] == INSULT:
            arcs[code] = (INSULT, max(weight, arcs.get(code, (0, 0.0))[1]))
    codes = np.array(sorted(arcs), dtype=np.uint64)
    packed = {n: (np.array(sorted(d), dtype=np.uint64), np.array([d[k] for k in sorted(d)])) for n, d in stems.items()}
    return Grammar(codes, np.array([arcs[int(c)][0] for c in codes], np.int8), np.array([arcs[int(c)][1] for c in codes]), packed)


def lexical_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, code, toxic, clean): texts that hold a word (kind 0) or a word with a stem (kind: its length)."""
    for batch in batches:
        for a, b in slices(batch.column(0)):
            data, offsets = flat(batch.column(0).slice(a, b - a))
            toxic = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
            start, stop, row = words(data, offsets)
            if not len(start):
                continue
            prefix = Prefix(data, LOWER_CODES)
            for kind in (0, *STEMS):
                long = np.flatnonzero(stop - start > max(kind, 2))
                code = prefix.ranges(start[long], start[long] + kind if kind else stop[long])
                order = np.lexsort((code, row[long]))
                code, doc = code[order], row[long][order]
                first = np.ones(len(code), bool)
                first[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
                codes, where = np.unique(code[first], return_inverse=True)
                bad = np.bincount(where, weights=toxic[doc[first]], minlength=len(codes)).astype(np.int64)
                n = np.bincount(where, minlength=len(codes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes), kind, np.int32)), pa.array(codes.view(np.int64)), pa.array(bad), pa.array(n - bad)],
                    names=["kind", "code", "toxic", "clean"])


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, toxic: str, sample: int = SAMPLE) -> Grammar:
    """Grammar learned from at most ``sample`` labelled rows, the first by the hash of their key.

    An arc has ``SUPPORT`` toxic texts and log odds of ``ODDS``, whatever part
    of the toxic texts that is, and so many toxic ones among its own texts that
    less than one of all words and stems looked at would have them by chance
    (Chernoff's bound of the binomial tail).

    Rows without key, text or label are left out; a key labelled twice is
    toxic if either label says so.  Without any labelled row the seeds and the
    default calibration remain.
    """
    spark = docs.sparkSession
    known = (labels.filter(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(toxic).alias("t"))
             .orderBy(F.xxhash64("k", F.lit(5)), "k").limit(sample))
    # at most ``sample`` pairs of numbers
    fitting = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(known), "k").filter("text IS NOT NULL")
    fitting = fitting.select("text", (F.col("t") > 0).alias("toxic"))
    size = {bool(r[0]): r[1] for r in fitting.groupBy("toxic").count().collect()}
    n_bad, n_good = size.get(True, 0), size.get(False, 0)
    if not n_bad or not n_good:
        return build([])
    counted = fitting.mapInArrow(lexical_counts, "kind int, code long, toxic long, clean long")
    odds = (F.log((F.col("toxic") + 0.5) / (n_bad + 1.0)) - F.log((F.col("clean") + 0.5) / (n_good + 1.0)))
    seen = (counted.groupBy("kind", "code").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .filter(F.col("toxic") + F.col("clean") >= SUPPORT))
    seen = written(spark, seen, "markers")
    among, rate, n = seen.count(), n_bad / (n_bad + n_good), F.col("toxic") + F.col("clean")
    surprise = (F.col("toxic") * F.log(F.col("toxic") / (n * rate))
                + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - rate)))).otherwise(0.0))
    arcs = (seen.filter(F.col("toxic") >= SUPPORT).withColumn("odds", odds).filter(F.col("odds") >= ODDS)
            .filter(surprise >= math.log(max(among, 1))).orderBy(F.desc("odds"), "kind", "code").limit(ARCS).collect())
    grammar = build([(r["kind"], int(np.int64(r["code"]).view(np.uint64)), min(r["odds"], 6.0) / 4.0) for r in arcs])
    shared = spark.sparkContext.broadcast(grammar)  # at most ARCS arcs and the seeds

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                x = shared.value.features(batch.column(0).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(3)), batch.column(1).slice(a, b - a)],
                                                 names=["a", "b", "c", "toxic"])

    rows = fitting.mapInArrow(measure, "a double, b double, c double, toxic boolean").groupBy("a", "b", "c", "toxic").count().collect()
    x = np.array([[1.0, r["a"], r["b"], r["c"]] for r in rows])
    y = np.array([float(r["toxic"]) for r in rows])
    weight = np.array([float(r["count"]) for r in rows])
    beta = np.array([-2.0, 1.0, 1.0, 1.0])
    prior = np.array([-3.0, 1.0, 1.0, 1.0])
    for _ in range(25):  # Newton steps of a logistic regression drawn towards the prior
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1.0 * (beta - prior)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(4)
        beta = beta - np.clip(np.linalg.solve(curve, slope), -3, 3)
    grammar.calibration = (float(beta[0]), *(float(max(v, 0.0)) for v in beta[1:]))
    return grammar


def score(docs: DataFrame, grammar: Grammar, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the toxicity of the whole text from 0 to 1.

    A null or empty text has no clause and gets the score of the bias.  Rows
    are scored alone: repeated rows get equal scores, ties stay ties, very
    long texts are read whole, an empty table gives no row.  Other columns are
    passed on; one called ``out``, in upper or lower case, is replaced.
    """
    fields = [f for f in docs.schema if f.name.lower() != out.lower()]
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(column):
                part = batch.slice(a, b - a)
                points = shared.value.score(shared.value.features(column.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(f.name)) for f in fields), pa.array(points)],
                    names=[*(f.name for f in fields), out])

    return docs.mapInArrow(work, schema)


def held_out(key: Column) -> Column:
    """Rows whose labels no model may learn from."""
    return crc_mod(key, 4) == 2


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Grammar:
    """Grammar learned from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return learn(docs, labels, "doc_id", "text", "toxic")


@register()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, trained(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
