"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text falls into clauses at punctuation and line ends; a clause's words become symbols (insult, threat, target, negation,
report, other). Four small transducers read them: negation relabels insults and threats in its scope, reporting verbs
relabel what follows them, targets (pronouns of address) relabel what stands near them, and threats count only towards
someone. Their composition, one automaton built once by the product construction, gives each matched clause its weights
by path: plain, targeted, negated, reported, threat. A clause without a match weighs nothing, no word scores outside its
clause, and each feature belongs to a path: no word counts apart from how it is said. The insult transducer's arcs carry
log-odds learned from labelled rows; the paths' weights come from a logistic fit on the same rows around PRIOR, so that a
held-out row's score is a probability. Whatever the labels say, what is negated or reported can't add to a score, and
being aimed at someone or a threat can't lower it: those weights are bounded by 0 from above and below.

Labels are read only from rows whose crc32(doc_id as text) mod 3 is not 1, at most TRAIN_ROWS of them (those first by a
hash of doc_id), so the sample, its words kept and the model have proven bounds. Scoring is one narrow pass.

Defined results: a null text is an empty one; an empty text scores the fit's base rate; texts are scored whole; repeated
rows get equal scores; a null doc_id is not held out (its remainder is null); without labels of both kinds the seed
lexicon and fixed path weights serve; an empty table gives an empty one; further columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, crc_mod3, emit, table, with_columns

TRAIN_ROWS = 20_000
MOST_WORDS = 400
THRESHOLD = 0.7

# The grammar's closed word classes. SEEDS serve only where there are no labels to learn from.
SEEDS = ["idiot", "idiots", "moron", "morons", "scum", "loser", "stupid", "worthless", "pathetic", "disgusting", "clown", "trash", "bastard", "imbecile", "idiota", "imbécile", "crétin", "salaud", "dummkopf", "arschloch", "estúpido", "imbécil"]
THREATS = ["kill", "hurt", "beat", "destroy", "burn", "töten", "schlagen", "vernichten", "tuer", "frapper", "détruire", "matar", "golpear", "destruir"]
TARGETS = ["you", "your", "yours", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "ihr", "euch", "sie", "tu", "te", "toi", "vous", "ils", "elles", "tú", "ti", "usted", "ustedes", "vosotros", "ellos", "ellas"]
NEGATIONS = ["not", "no", "never", "isn't", "aren't", "don't", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "jamás", "tampoco"]
REPORTS = ["said", "says", "say", "called", "calls", "claimed", "wrote", "quoted", "sagte", "sagt", "nannte", "schrieb", "dit", "disait", "appelé", "écrit", "dijo", "dice", "llamó", "escribió"]

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
PATHS = ("plain", "targeted", "negated", "reported", "threat")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SCOPE = 3  # words that a negation or a target reaches


def _scope(opener: int) -> dict[tuple[int, int], tuple[int, bool]]:
    """A transducer that marks insults and threats up to SCOPE words after opener: (state, symbol) -> (state, marked)."""
    arcs = {}
    for left, s in product(range(SCOPE + 1), range(6)):
        arcs[left, s] = (SCOPE if s == opener else max(0, left - 1), left > 0 and s in (INSULT, THREAT))
    return arcs


def _after(opener: int) -> dict[tuple[int, int], tuple[int, bool]]:
    """A transducer that marks all insults and threats after opener, to the clause's end."""
    return {(on, s): (int(on or s == opener), bool(on) and s in (INSULT, THREAT)) for on, s in product((0, 1), range(6))}


def compose() -> dict[tuple[int, int], tuple[int, int]]:
    """The product of the transducers: (state, symbol) -> (state, path + 1, or 0 for none). State 0 begins a clause."""
    neg, rep, tgt = _scope(NEGATION), _after(REPORT), _scope(TARGET)
    number: dict[tuple[int, int, int], int] = {}
    for at in product(range(SCOPE + 1), (0, 1), range(SCOPE + 1)):
        number[at] = len(number)
    arcs = {}
    for (n, r, t), i in number.items():
        for s in range(6):
            (n2, negated), (r2, reported), (t2, targeted) = neg[n, s], rep[r, s], tgt[t, s]
            path = -1
            if s in (INSULT, THREAT):
                path = 2 if negated else 3 if reported else 4 if s == THREAT else 1 if targeted else 0
            if s == THREAT and path == 4 and not targeted:
                path = -1  # a threat needs someone
            arcs[i, s] = (number[n2, r2, t2], path + 1)
    return arcs


ARCS = compose()


# Weights before any label is seen: the constant, then by path (the first: plain or targeted, the second: more if targeted) a text's weight, its weight against its length, and the heaviest clause.
PRIOR = np.array([-3.5, *(0.4, 0.6, 0.0, 0.0, 0.8), *(0.4, 0.6, 0.0, 0.0, 0.8), *(0.4, 0.6, 0.0, 0.0, 0.8)])
MOST = np.array([0.0 if i and i % 5 in (3, 4) else np.inf for i in range(16)])  # negated, reported
LEAST = np.array([0.0 if i and i % 5 in (0, 1, 2) else -np.inf for i in range(16)])  # outright, targeted, threat


@dataclass
class Model:
    words: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    symbols: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.symbols = {w: s for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws} | {w: INSULT for w in self.words}

    def clauses(self, text: str) -> tuple[list[np.ndarray], int]:
        """The weights by path of each matched clause, and the number of words."""
        low, out, n = text.lower(), [], 0
        sym = self.symbols
        for clause in _CLAUSE.split(low):
            words = _WORD.findall(clause)
            n += len(words)
            s = [sym.get(w, OTHER) for w in words]
            if INSULT not in s and THREAT not in s:
                continue
            got, state = np.zeros(len(PATHS)), 0
            # A target that follows marks as well as one before: the automaton reads the clause both ways.
            back, ahead = 0, [False] * len(s)
            for i in range(len(s) - 1, -1, -1):
                ahead[i] = back > 0
                back = SCOPE if s[i] == TARGET else max(0, back - 1)
            for i, x in enumerate(s):
                if x == INSULT and ahead[i] and ARCS[state, x][1] == 1:
                    path = 2
                elif x == THREAT and ahead[i] and ARCS[state, x][1] == 0:
                    path = 5
                else:
                    path = ARCS[state, x][1]
                if path:
                    got[path - 1] += self.words.get(words[i], 1.0)
                state = ARCS[state, x][0]
            if got.any():
                out.append(got)
        return out, n

    def features(self, text: str | None) -> np.ndarray:
        return self.read(text)[0]

    def read(self, text: str | None) -> tuple[np.ndarray, int]:
        """Features and the number of matched clauses. 1, then by path: the log-damped weight of all clauses, that against the text's length, and that of the heaviest clause.

        A targeted insult counts as one said outright, too.
        """
        got, n = self.clauses(text or "")
        g = np.array(got).reshape(-1, len(PATHS))
        g[:, 0] += g[:, 1]
        total = g.sum(axis=0)
        return np.concatenate([[1.0], np.log1p(total), np.log1p(100 * total / (n + 20)), np.log1p(g.max(axis=0, initial=0.0))]), len(got)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the rows to learn from; the labels' side is bounded by TRAIN_ROWS, so it is broadcast."""
    few = labels.where("toxic is not null").where(crc_mod3("doc_id") != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")  # a row a labelled id, however often it is repeated


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon, then path weights, from the training rows. Only counts of words and rows of 16 numbers reach the driver."""

    def count(batches, out):
        for b in batches:
            n = (Counter(), Counter())
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                n[int(y == 1)].update(set(_WORD.findall((t or "").lower())))
                n[int(y == 1)]["\0"] += 1
            words = list(n[0] | n[1])
            yield out([words, [n[1][w] for w in words], [n[0][w] for w in words]])

    sample = _sample(docs, labels)
    counts = emit(sample, "word string, n1 long, n0 long", count).groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counts = counts.where("n1 >= 3")
    all1, all0 = (counts.where(F.col("word") == "\0").select("n1", "n0").first() or (0, 0))
    if not all1 or not all0:
        return Model(dict.fromkeys(SEEDS, 2.0))
    p1, p0 = F.col("n1") / all1, F.col("n0") / all0
    p = (F.col("n1") + F.col("n0")) / (all1 + all0)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / all1 + 1 / all0) + 1e-12)
    odds = F.log((F.col("n1") + 0.5) / (all1 - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (all0 - F.col("n0") + 0.5))
    best = counts.where(F.col("word") != "\0").select("word", z.alias("z"), odds.alias("odds")).where("z >= 4.5 and odds >= 2").orderBy(F.desc("z"), "word").limit(MOST_WORDS)
    words = {r["word"]: min(6.0, float(r["odds"])) for r in best.collect()}  # learned ones alone: the seeds have no part in a trained model
    model = Model(words)

    def rows(batches, out):
        for b in batches:
            yield out([[model.features(t).tolist() for t in b.column("text").to_pylist()], b.column("toxic").to_pylist()])

    got = emit(sample, "x array<double>, toxic int", rows).collect()
    x, y = np.array([r["x"] for r in got]), np.array([float(r["toxic"] == 1) for r in got])
    order = np.lexsort((y, *x.T))  # sums in one order: the same model whichever task ended first
    x, y = x[order], y[order]
    model.weights = fitted(x, y)
    return model


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights around PRIOR, from LEAST to MOST: Newton steps, with weights held at a bound that they would leave."""
    w = PRIOR.copy()
    ridge = np.where(np.arange(len(w)) == 0, 1e-3, 1.0)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (q - y) + ridge * (w - PRIOR)
        free = ~((w >= MOST) & (slope < 0)) & ~((w <= LEAST) & (slope > 0))
        h = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        w[free] -= np.linalg.solve(h[np.ix_(free, free)], slope[free])
        w = np.clip(w, LEAST, MOST)
    return w


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1) and the matched clauses' number and weights by path."""

    def each(texts: list) -> list:
        seen = [model.read(t) for t in texts]
        x = np.array([f for f, _ in seen]).reshape(len(texts), -1)
        p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
        paths = [[round(v, 6) for v in row] for row in np.expm1(x[:, 1:6]).tolist()]
        return [np.round(p, 9).tolist(), [n for _, n in seen], paths]

    return with_columns(docs, [text], "toxicity double, n_toxic_clauses long, path_weights array<double>", each)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    df = score(docs.select("doc_id", "text"), model)
    return df.select("doc_id", F.coalesce(crc_mod3("doc_id") == 1, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), F.col("n_toxic_clauses").alias("n_clauses"))
