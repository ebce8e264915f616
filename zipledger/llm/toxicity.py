"""Toxicity by a weighted finite-state grammar over clauses.

Words are first rewritten to symbols: insult, threat, target, negation, reported
speech, clause end, or other. Four small transducers read the symbols, each keeping
its own state (words left under a negation, reported speech begun, target named,
threat pending); insults have no state of their own. Their composition reads a clause once and emits its matched weights
by reading: plain, targeted, negated, reported, threat. A logistic model turns a
document's sums into a score from 0 to 1.

Which words are insults is learned: words and word beginnings whose documents are labelled
toxic far more often than not, weighted by their log odds. Other languages inflect and
compound, so beginnings matter as much as words. It is fitted, as the logistic model is,
on at most ``SAMPLE`` labelled rows of the training folds (taken in hash order), and holds
at most ``LEXICON`` entries; both go to the executors as plain values. Every document is
scored over its whole text. Nothing but the text is an input of the score.

Defined results: a null or empty text, or one without letters, has the score of a document
without matches. A null doc_id is scored and counts as not held out. Repeated rows are
scored alike. Labels that are null or lack a document are not used; without labels of
both kinds the lexicon is empty, and the threat list alone decides. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zipledger.llm.common import id_text

#: Labelled rows used for fitting, at most, and entries of the learned lexicon, at most.
SAMPLE = 20_000
LEXICON = 5_000
#: A word (beginning) enters the lexicon with this many toxic documents and this weight.
LEAST_DOCUMENTS = 6
LEAST_WEIGHT = 2.5
BEGINNINGS = (4, 5, 6, 7, 8)

# Fixed word lists of the grammar (English, German, French, Spanish).
NEGATIONS = "not never no nor cannot nicht kein keine nie pas jamais aucun nunca ningún tampoco".split()
REPORTS = ("said says say wrote writes quoted quote called calls reported claims claimed sagte sagt schrieb nannte "
           "dit écrit appelé dijo dice escribió llamó").split()
TARGETS = ("you your yours yourself he she they them him her his their du dich dir euch ihr sie "
           "tu toi vous votre tú ti usted ustedes vosotros").split()
THREATS = ("kill hurt destroy attack beat burn shoot stab hang töten umbringen tuer frapper "
           "matar golpear").split()
THREAT_WEIGHT = 3.0
#: What the logistic model starts from: intercept, then a factor for each reading.
READINGS = ("plain", "targeted", "negated", "reported", "threat")
PRIOR = (-3.0, 1.0, 1.25, 0.5, 0.5, 1.0)

OTHER, END, NEGATION, REPORT, TARGET, THREAT, INSULT = range(7)
_TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n]")
FOLDS = 3


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


# -- the grammar -----------------------------------------------------------------------

def _countdown(starts: int, words: int):
    """State: words left under the symbol's influence."""
    return lambda state, symbol: words if symbol == starts else max(0, state - 1)


def _latch(starts: int):
    """State: whether the symbol has come in this clause."""
    return lambda state, symbol: 1 if symbol == starts else state


TRANSDUCERS = (_countdown(NEGATION, 3), _latch(REPORT), _latch(TARGET), _countdown(THREAT, 5))
START = (0, 0, 0, 0)


class Composition(dict):
    """The transducers' product automaton; transitions are made when first met (a few hundred)."""

    def __missing__(self, key):
        state, symbol = key
        new = tuple(step(s, symbol) for step, s in zip(TRANSDUCERS, state))
        self[key] = new
        return new


def read_clause(symbols: list[int], weights: list[float], grammar: Composition) -> list[float]:
    """The matched weights of one clause by reading."""
    plain = negated = reported = threat = 0.0
    state = START
    for symbol, weight in zip(symbols, weights):
        before, state = state, grammar[state, symbol]
        if symbol == INSULT:
            if before[1]:
                reported += weight
            elif before[0]:
                negated += weight
            else:
                plain += weight
        elif symbol == TARGET and before[3] and not before[0] and not before[1]:
            threat += THREAT_WEIGHT
    return [0.0 if state[2] else plain, plain if state[2] else 0.0, negated, reported, threat]


class Symbols(dict):
    """word -> (symbol, weight); remembers the words it has met, up to a bound."""

    REMEMBERED = 150_000
    NOTHING = (OTHER, 0.0)

    def __init__(self, lexicon: dict[str, float]):
        super().__init__({c: (END, 0.0) for c in ".!?;:\n"})
        self.lexicon = lexicon
        for words, symbol in ((NEGATIONS, NEGATION), (REPORTS, REPORT), (TARGETS, TARGET), (THREATS, THREAT)):
            self.update(dict.fromkeys(words, (symbol, 0.0)))

    def __missing__(self, word: str) -> tuple[int, float]:
        found = [self.lexicon.get("=" + word, 0.0)]
        found += [self.lexicon.get("^" + word[:n], 0.0) for n in BEGINNINGS if len(word) >= n]
        weight = max(found)
        out = (INSULT, weight) if weight else self.NOTHING
        if len(self) < self.REMEMBERED:
            self[word] = out
        return out


def readings(text: str | None, symbols: Symbols, grammar: Composition) -> list[float]:
    """A document's sums of matched weights by reading."""
    sums = [0.0] * len(READINGS)
    if not text:
        return sums
    found = [symbols[w] for w in _TOKENS.findall(text.lower())]
    marks = bytes([s for s, _ in found])
    start = 0
    for clause in marks.split(bytes([END])):
        if INSULT in clause or THREAT in clause:
            weights = [w for _, w in found[start:start + len(clause)]]
            sums = [a + b for a, b in zip(sums, read_clause(list(clause), weights, grammar))]
        start += len(clause) + 1
    return sums


# -- fitting ---------------------------------------------------------------------------

def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic): at most ``sample`` labelled documents of the training folds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.dropna().filter(fold(F.col("doc_id")) != 1).dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return id_text(docs).join(F.broadcast(chosen), "doc_id")  # bounded by ``sample``


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """'=word' or '^beginning' -> log odds, from the documents' labels."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    features = F.array(F.concat(F.lit("="), "word"), *[
        F.when(F.length("word") >= n, F.concat(F.lit("^"), F.substring("word", 1, n))) for n in BEGINNINGS])
    per_doc = rows.select("toxic", F.monotonically_increasing_id().alias("d"), words.alias("words")).select(
        "toxic", "d", F.explode("words").alias("word")).select("toxic", "d", F.explode(features).alias("f"))
    per_doc = per_doc.dropna().dropDuplicates(["d", "f"])
    counts = per_doc.groupBy("f").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).filter(
        F.col("t") >= LEAST_DOCUMENTS)
    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    toxic, clean = totals[0] or 0, (totals[1] or 0) - (totals[0] or 0)
    if not toxic or not clean:
        return {}
    weight = (F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1)))
    best = counts.select("f", weight.alias("w"), "t").filter(F.col("w") >= LEAST_WEIGHT)
    return {r[0]: r[1] for r in best.orderBy(F.desc(F.col("w") * F.col("t")), "f").limit(LEXICON).collect()}


def _reader(lexicon: dict[str, float], model: list[float] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols, grammar = Symbols(lexicon), Composition()
        for batch in batches:
            sums = [readings(t, symbols, grammar) for t in batch.pop("text")]
            if model is None:
                yield batch.assign(**{r: [s[k] for s in sums] for k, r in enumerate(READINGS)})
            else:
                yield batch.assign(score=[score(s, model) for s in sums])
    return run


def score(sums: list[float], model: list[float]) -> float:
    z = model[0] + sum(b * x for b, x in zip(model[1:], sums))
    return 1 / (1 + exp(-max(-50.0, min(50.0, z))))


def fit_model(x: np.ndarray, y: np.ndarray, pull: float = 1.0, rounds: int = 25) -> list[float]:
    """Logistic regression by Newton's method, pulled towards PRIOR; factors stay positive."""
    prior = np.array(PRIOR)
    b, x = prior.copy(), np.column_stack([np.ones(len(x)), x])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (p - y) + pull * (b - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(b))
        step = np.linalg.solve(curve, slope)
        b = b - step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
        b[1:] = np.maximum(b[1:], 0.05)
    return b.tolist()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], list[float]]:
    """The lexicon and the logistic model."""
    rows = training_rows(docs, labels, sample).cache()
    try:
        lexicon = learn_lexicon(rows)
        schema = "toxic int, " + ", ".join(f"{r} double" for r in READINGS)
        seen = rows.select("toxic", "text").mapInPandas(_reader(lexicon, None), schema).toPandas()  # <= sample rows
    finally:
        rows.unpersist()
    if seen["toxic"].nunique() < 2:
        return lexicon, list(PRIOR)
    return lexicon, fit_model(seen[list(READINGS)].to_numpy(), seen["toxic"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    lexicon, model = fit(docs, labels, sample)
    out = id_text(docs).mapInPandas(_reader(lexicon, model), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, limit: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the documents that score ``limit`` or more; all columns."""
    lexicon, model = fit(docs, labels, sample)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        symbols, grammar = Symbols(lexicon), Composition()
        for texts in batches:
            yield pd.Series([score(readings(t, symbols, grammar), model) for t in texts], dtype=float)

    return docs.filter(toxic(F.col("text").cast("string")) < limit)
