"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon maps the words of a clause to symbols: target, negation, report, intent, threat, insults of several levels, and
other. Five transducers are composed into one automaton that reads these symbols:

* negation marks the words in its reach, reported speech marks what follows the report;
* target marks insults that are aimed at someone, before or after them in the clause;
* insult gives marked insults their weight: aimed more, negated or reported less; the heaviest in a clause counts in
  full, further ones a quarter;
* threat has a path of its own: an intention, a verb of violence and a target as its object ("I will hurt you"), or the
  verb first in the clause and then its object ("hurt them"); the verb alone, or with another object, weighs nothing.

A clause weighs as much as its heaviest path, and a document's score comes from its matched clauses, by a logistic curve
fitted on labelled rows. Words and word stems that labelled rows show to be toxic join the lexicon as insults with their
log-odds as level, so languages without a list are covered by their labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, held_out, replaced, small_batches, with_fields
from .transducer import Heaviest, Transducer

# Fixed word lists of the lexicon.
INSULTS = "idiot idiots moron morons loser losers scum clown stupid dumb disgusting worthless pathetic trash fool imbecile garbage vermin pig bastard jerk".split()
THREATS = "kill hurt destroy beat stab shoot murder attack hang burn".split()
INTENTS = "will shall gonna going want wants wanna should must let i'll we'll they'll i'd deserve deserves werde wird voy vais vamos".split()
TARGETS = "you your yours you're he she they them him her these those everyone people us all dich euch sie te ustedes vous toi".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't didn't won't hardly nicht kein nie pas jamais nunca".split()
REPORTS = "said says claimed called reported quoted wrote stated alleged according sagte dit dijo".split()

CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
STEMS = (6, 7, 8)
# Levels of insults: half a unit of weight each. Fixed insults have weight 4, threats weight 6.
LEVEL, LEVELS, INSULT, THREAT = 0.5, 16, 4.0, 6.0
# Factors: aimed at a target, under a negation, inside reported speech; further insults of a clause.
AIMED, NEGATED, REPORTED, FURTHER = 1.5, 0.3, 0.4, 0.25
# Words that a negation reaches, that may stand between intention and verb, and between verb and object.
REACH, BETWEEN = 3, 3

KINDS = ("other", "target", "negation", "report", "intent", "threat", *(f"insult{k}" for k in range(1, LEVELS + 1)))


def level(weight: float) -> str:
    return f"insult{min(LEVELS, max(1, round(weight / LEVEL)))}"


def marked(flags: str) -> list[tuple[str, str]]:
    """All symbols that carry some of the marks in ``flags``."""
    sets = [""]
    for f in flags:
        sets += [s + f for s in sets]
    return [(k, s) for k in KINDS for s in sets]


def negation() -> Transducer:
    t = Transducer(0, range(REACH + 1))
    for left in range(REACH + 1):
        for k, s in marked(""):
            t.add(left, (k, s), (k, s + "n" if left and k != "negation" else s), REACH if k == "negation" else max(0, left - 1))
    return t


def report() -> Transducer:
    t = Transducer("said by the writer", ("said by the writer", "reported"))
    for k, s in marked("n"):
        t.add("said by the writer", (k, s), (k, s), "reported" if k == "report" else "said by the writer")
        t.add("reported", (k, s), (k, s + "r"), "reported")
    return t


def target() -> Transducer:
    """An insult before its target is marked by guess; a path that guessed wrong ends in no final state."""
    t = Transducer("none", ("none", "seen"))
    for k, s in marked("nr"):
        for state in ("none", "seen", "owed"):
            to = "seen" if k == "target" else state
            if not k.startswith("insult"):
                t.add(state, (k, s), (k, s), to)
            elif state == "none":
                t.add(state, (k, s), (k, s), "none")
                t.add(state, (k, s), (k, s + "a"), "owed")
            else:
                t.add(state, (k, s), (k, s + "a"), state)
    return t


def factor(marks: str) -> float:
    return (NEGATED if "n" in marks else 1.0) * (REPORTED if "r" in marks else 1.0) * (AIMED if "a" in marks else 1.0)


def insult() -> Transducer:
    t = Transducer("first", ("first", "further"))
    for k, s in marked("nra"):
        if not k.startswith("insult"):
            t.add("first", (k, s), (k, s), "first")
            t.add("further", (k, s), (k, s), "further")
            continue
        weight = int(k[6:]) * LEVEL * factor(s)
        t.add("first", (k, s), (k, s), "further", weight)
        t.add("first", (k, s), (k, s), "first", FURTHER * weight)
        t.add("further", (k, s), (k, s), "further", FURTHER * weight)
    return t


def threat() -> Transducer:
    """A verb is taken for a threat by guess, at its full weight; the path is only final once its object has come."""
    t = Transducer("begin", ("begin", "inside", *(("intent", n) for n in range(BETWEEN + 1))))
    for k, s in marked("nra"):
        x = (k, s)
        to = ("intent", 0) if k == "intent" else "inside"
        t.add("begin", x, x, to)
        t.add("inside", x, x, to)
        for n in range(BETWEEN + 1):
            t.add(("intent", n), x, x, ("intent", 0) if k == "intent" else ("intent", n + 1) if n < BETWEEN else "inside")
            if k == "threat":
                t.add(("intent", n), x, x, ("verb", 0), THREAT * factor(s))
            if k == "target":
                t.add(("verb", n), x, x, "inside")
            elif n < BETWEEN and k not in ("threat", "intent"):
                t.add(("verb", n), x, x, ("verb", n + 1))
        if k == "threat":
            t.add("begin", x, x, ("verb", BETWEEN), THREAT * factor(s))
    return t


@lru_cache(maxsize=1)
def automaton() -> Heaviest:
    """The composition of the five."""
    return negation().then(report()).then(target()).then(insult()).then(threat()).heaviest()


class Grammar:
    """A lexicon in front of the composed automaton; ``weights`` holds the insults, ``stems`` the learned prefixes."""

    def __init__(self, weights: dict[str, float] | None = None, stems: dict[str, float] | None = None):
        self.weights = weights if weights is not None else dict.fromkeys(INSULTS, INSULT)
        self.stems = stems or {}
        self.fixed = {w: k for k, words in (("report", REPORTS), ("intent", INTENTS), ("target", TARGETS), ("negation", NEGATIONS), ("threat", THREATS)) for w in words}
        self.known: dict[str, str] = {}

    def symbol(self, word: str) -> str:
        """The symbol of a word in the lexicon; a word of the fixed lists keeps its role."""
        if kind := self.fixed.get(word) or self.known.get(word):
            return kind
        if len(self.known) > 1 << 18:  # words seen so far, for speed only
            self.known.clear()
        kind = self.known[word] = self._insult(word)
        return kind

    def _insult(self, word: str) -> str:
        w = self.weights.get(word) or max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n), default=0.0)
        return level(w) if w > 0 else "other"

    def clause(self, words: list[str], symbols: dict[str, str] | None = None) -> float:
        """The weight of one clause's heaviest path."""
        return automaton().weigh([((symbols[w] if symbols else self.symbol(w)), "") for w in words]) or 0.0

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Over all clauses of the whole text: the heaviest, the log of their sum, and the log of the number of different insults and threats in them."""
        low = (text or "").lower()
        symbols = {w: self.symbol(w) for w in set(WORD.findall(low))}
        hits = {w for w, k in symbols.items() if k == "threat" or k.startswith("insult")}
        if not hits:
            return 0.0, 0.0, 0.0
        most, total, matched = 0.0, 0.0, set()
        for part in CLAUSE.split(low):
            words = WORD.findall(part)
            if not hits.isdisjoint(words) and (weight := self.clause(words, symbols)) > 0:
                most, total = max(most, weight), total + weight
                matched |= hits.intersection(words)
        return most, math.log1p(total), math.log1p(len(matched))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and an intercept (last) by Newton steps on scaled columns; a step is halved until it lowers the loss."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(x))])
    w, keep = np.zeros(z.shape[1]), np.array([ridge] * (z.shape[1] - 1) + [1e-6])

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float(np.logaddexp(0, np.where(y > 0, -m, m)).sum() + (keep * w * w).sum() / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w / np.append(scale, 1.0)


def learned(texts: list[str], labels: list[int], least: int = 6, bar: float = 3.2) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems whose log-odds of toxicity pass ``bar``, with at least ``least`` different neighbourhoods in toxic texts.

    Counting neighbourhoods (the words before and after) instead of documents keeps out the words of a text that is
    merely copied often; equal texts count once anyway.
    """
    counts: list[Counter] = [Counter(), Counter()]
    toxic: list[list[str]] = []
    n = [1, 1]
    for t, y in dict(zip(texts, labels, strict=True)).items():
        found = WORD.findall((t or "").lower())
        own = set(found)
        counts[y].update(own | {(w[:k],) for w in own for k in STEMS if len(w) > k})
        n[y] += 1
        if y:
            toxic.append(found)
    odds = {w: math.log((k + 0.5) / n[1]) - math.log((counts[0][w] + 0.5) / n[0]) for w, k in counts[1].items() if k >= least}
    odds = {w: min(x, 8.0) for w, x in odds.items() if x >= bar}
    around: dict = {w: set() for w in odds}
    for found in toxic:
        for before, w, after in zip(["", *found], found, [*found[1:], ""], strict=False):
            for key in (w, *((w[:k],) for k in STEMS if len(w) > k)):
                if key in around:
                    around[key].add((before, after) if isinstance(key, str) else (before, w, after))
    kept = {w: x for w, x in odds.items() if len(around[w]) >= least}
    return {w: x for w, x in kept.items() if isinstance(w, str)}, {w[0]: x for w, x in kept.items() if not isinstance(w, str)}


class ToxicityModel:
    def __init__(self, grammar: Grammar, curve: np.ndarray):
        self.grammar, self.curve = grammar, [float(x) for x in curve]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.curve, (*self.grammar.features(text), 1.0), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(texts: list[str], labels: list[int]) -> ToxicityModel:
    """Learn the insults of the lexicon on one half of the labelled texts in turn and the curve on the other, so that chance words don't flatter it."""
    fixed = dict.fromkeys(INSULTS, INSULT)
    if len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        return ToxicityModel(Grammar(fixed), [0.2, 0.5, 1.0, math.log(share / (1 - share)) if labels else -2.0])
    rows, known = [], []
    for k in (0, 1):
        own = [i for i in range(len(texts)) if i % 2 == k]
        other = [i for i in range(len(texts)) if i % 2 != k]
        words, stems = learned([texts[i] for i in own], [labels[i] for i in own])
        half = Grammar(fixed | words, stems)
        rows += [half.features(texts[i]) for i in other]
        known += [labels[i] for i in other]
    curve = logistic(np.array(rows), np.array(known, float))
    words, stems = learned(texts, labels)
    # A listed word that the labels show to be harmless loses its weight.
    seen = [Counter(), Counter()]
    for t, y in zip(texts, labels, strict=True):
        seen[y].update(fixed.keys() & set(WORD.findall((t or "").lower())))
    harmless = {w for w in fixed if seen[0][w] >= 8 and seen[0][w] > 4 * seen[1][w]}
    return ToxicityModel(Grammar({w: x for w, x in fixed.items() if w not in harmless} | words, stems), curve)


def train(docs: DataFrame, labels: DataFrame, rows: int = 8000, max_chars: int = 50_000) -> ToxicityModel:
    """Fit, in an executor, on a bounded sample of about ``rows`` labelled documents outside the held-out fifth, each of at most ``max_chars``."""
    return fitted(docs, labels, "toxic", fit, rows, max_chars)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with held_out, score, predicted (score >= ``threshold``), replacing columns of those names.

    Whole texts are read. A null or empty text matches no clause and gets the base score; a null doc_id is held out.
    Every row is kept, repeated ones too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in small_batches(batches, 500):
            score = np.array([m.score(t) for t in b.column("text").to_pylist()], float)
            yield replaced(b, score=pa.array(score, pa.float64()), predicted=pa.array((score >= threshold).astype(np.int32)))

    own = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return own.mapInArrow(run, with_fields(own, "score double, predicted int"))
