"""Toxicity: a lexicon learned from labels, Levenshtein automata intersected with its trie, and context windows.

The lexicon holds whole words, and stems that count if a text has so many different words with them; both are chosen by how
surely they go with the label. The automata of all words, at distance 1, run together over the lexicon's trie and are made
deterministic as they are used, so a word is read once, and most words leave after a few letters. Each hit is weighed by the
words around it: reports and quotation marks lower it, address in the second person raises it. The sum of the different hits
of a text gives its score by a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrain.functions.ship import ship
from prosegrain.llm.common import SMALL, Batches, bound_batches, column, cut, rows_of
from prosegrain.llm.labelled import held_out, sample

FOLDS, FOLD = 4, 2
#: Labelled documents that are learned from, at most.
SAMPLE_ROWS = 12_000
#: Letters of a stem; different words that a stem may ask for; letters of a word that may be misspelled.
STEM, REPEATS, FUZZY = (4, 10), (1, 2, 3), 5
#: Words and automaton steps that a worker keeps.
KEPT = 400_000
WORDS = re.compile(r"[^\W_]+")
#: Marks of quotation: one that opens stands before a word and after none, one that closes after a word or its punctuation.
MARKS = re.compile(r"(?P<open>(?<![^\s(\[—–-])[\"“”«»„‘‚](?=\w))|(?<=[\w.,!?;:…)])[\"“”«»‘’](?!\w)")
MARK = re.compile(r"[\"“”«»„‘’‚]")
REPORTS = frozenset("said says say called calls wrote writes quote quoted quotes word words term terms slur slurs insult insults reported dit écrit mot mots sagte schrieb wort wörter dijo escribió palabra palabras".split())
ADDRESS = frozenset("you your yours youre ur tu toi te vous ton ta du dich dir ihr euch usted ustedes ti".split())
#: Weight of a misspelled hit, of a reported or quoted one, of one in an address; words of context on either side.
MISSPELLED, REPORTED, ADDRESSED, CONTEXT = 0.7, 0.25, 1.25, 5

Term = tuple[str, int]  # a word and 0, or a stem and the number of different words it asks for
Entry = tuple[str, int, float]  # with the weight of a hit


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def quoted(low: str) -> set[int]:
    """Places of the words that stand between a mark that opens and the next one that closes, however far apart."""
    if not MARK.search(low):
        return set()
    starts, out, opened = [m.start() for m in WORDS.finditer(low)], set(), -1
    for m in MARKS.finditer(low):
        at = bisect.bisect(starts, m.start())
        if m.lastgroup:
            opened = at
        elif opened >= 0:
            out.update(range(opened, at))
            opened = -1
    return out


def terms(ws: set[str], among: set[Term] | None = None) -> set[Term]:
    """The terms of a text with these different words, or those among the given ones."""
    stems = Counter(w[:n] for w in ws for n in range(STEM[0], min(len(w), STEM[1]) + 1))
    out = {(w, 0) for w in ws if len(w) >= STEM[0]} | {(s, m) for s, n in stems.items() for m in REPEATS if n >= m}
    return out if among is None else out & among


def term_counts(texts: DataFrame, among: set[Term] | None) -> DataFrame:
    """term, repeats, n: how many of texts (text) have each term. Tasks count first, so a row for each term and task is shuffled."""
    spark = texts.sparkSession
    bound_batches(spark, rows=500)
    given = spark.sparkContext.broadcast(among)

    def run(batches: Batches) -> Batches:
        total: Counter[Term] = Counter()

        def flush() -> pa.RecordBatch:
            rows = list(total.items())
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([t[0] for t, _ in rows], pa.string()), pa.array([t[1] for t, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], names=["term", "repeats", "n"])

        for batch in batches:
            for x in column(batch, "text"):
                total.update(terms(set(words(x)), given.value))
            if len(total) > 300_000:
                yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "term string, repeats int, n bigint").groupBy("term", "repeats").agg(F.sum("n").alias("n"))


def surely(toxic: int, clean: int, base: float, tried: int) -> bool:
    """Whether a term goes with the label beyond chance, among so many tried, and with few exceptions."""
    share = toxic / (toxic + clean)
    if toxic < 3 or toxic / (toxic + clean + 0.5) < 0.8 or share <= base:
        return False
    gain = toxic * math.log(share / base) + (clean * math.log((1 - share) / (1 - base)) if clean else 0)
    return gain >= math.log(tried) + 3


def apart(terms: list[Term]) -> list[Term]:
    """The terms without those that an earlier one covers or that cover an earlier one: of a stem and what begins with it, the earlier, and a word or stem once."""
    out, stems, begun, whole = [], set(), set(), set()
    for term, repeats in terms:
        heads = {term[:n] for n in range(1, len(term) + 1)}
        if stems.isdisjoint(heads) and (term not in begun if repeats else term not in whole):
            out.append((term, repeats))
            begun |= heads
            (stems if repeats else whole).add(term)
    return out


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[Entry], tuple[float, float]]:
    """The lexicon and the curve, from a bounded sample."""
    ship(docs.sparkSession)
    texts = sample(docs, labels, "toxic", FOLDS, FOLD, rows)
    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    toxic, total = n.get(1, 0), sum(n.values())
    if not toxic or toxic == total:
        return [], (math.log((toxic + 0.5) / (total - toxic + 0.5)) if total else -2.0, 0.0)
    often = cut(term_counts(texts.where("label = 1"), None).where("n >= 3"), "terms")
    tried = often.count()
    # what even no clean text could make sure of goes first; the significance that is asked for bounds the rest
    least = next(n for n in itertools.count(3) if n > toxic or surely(n, 0, toxic / total, tried))
    yes = {(r["term"], r["repeats"]): r["n"] for r in often.where(F.col("n") >= least).collect()}
    no = {(r["term"], r["repeats"]): r["n"] for r in term_counts(texts.where("label = 0"), set(yes)).collect()}
    sure = [t for t in yes if surely(yes[t], no.get(t, 0), toxic / total, tried)]
    sure.sort(key=lambda t: (3 * no.get(t, 0) - yes[t], t[1] > 0, -len(t[0]), t))
    lexicon = apart(sure)
    # a hit weighs as its term's log odds, by those of a term that 50 toxic texts and no clean one have
    weighed = [(*t, round(min(1.5, max(0.2, math.log((yes[t] + 0.5) / (no.get(t, 0) + 0.5)) / math.log(101))), 3)) for t in lexicon]
    masses = score_masses(texts.select("label", "text"), weighed)
    table = [(r["mass"], r["label"], r["count"]) for r in masses.groupBy(F.round("mass", 2).alias("mass"), "label").count().collect()]
    return weighed, curve(table)


def curve(table: list[tuple[float, int, int]], rounds: int = 60) -> tuple[float, float]:
    """Intercept and slope of the label by log(1 + mass), by Newton steps; the slope is not negative. table: mass, label, count."""
    x, y, n = (np.array(c, dtype=float) for c in zip(*table))
    x = np.log1p(x)
    w = np.array([-2.0, 1.0])
    keep = np.array([0.05, 0.05])  # pulls a little to zero, so that separable samples have an end
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        g = np.array([np.sum(n * (p - y)), np.sum(n * (p - y) * x)]) + keep * w
        v = n * p * (1 - p)
        h = np.array([[np.sum(v), np.sum(v * x)], [np.sum(v * x), np.sum(v * x * x)]]) + np.diag(keep)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return float(w[0]), max(0.0, float(w[1]))


class Matcher:
    """All Levenshtein automata of the lexicon run over its trie; a state is a set of (trie node, edits so far)."""

    def __init__(self, lexicon: list[Entry]):
        self.child: list[dict[str, int]] = [{}]
        self.word: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.fuzzy: list[bool] = [False]
        for k, (term, repeats, _) in enumerate(lexicon):
            at, spell = 0, len(term) >= FUZZY + bool(repeats)
            self.fuzzy[0] |= spell
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.fuzzy.append(False)
                at = self.child[at][c]
                self.fuzzy[at] |= spell
            (self.stem if repeats else self.word)[at] = k
        self.repeats = [x[1] for x in lexicon]
        self.weights = [x[2] for x in lexicon]
        self.lengths = [len(x[0]) for x in lexicon]
        self.sets: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple[tuple[int, int], ...], int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self.state({(0, 0)})
        self.clean: set[str] = set()

    def forget(self) -> None:
        """Empty what only saves time, before it grows beyond bounds."""
        if len(self.clean) > KEPT:
            self.clean.clear()
        if len(self.steps) > KEPT:
            self.steps.clear()
            self.sets.clear()
            self.number.clear()
            self.start = self.state({(0, 0)})

    def state(self, pairs: set[tuple[int, int]]) -> int:
        """The state of these pairs, letters of the lexicon left out included; -1 if there is none."""
        pairs |= {(k, e + 1) for n, e in pairs if e < 1 for k in self.child[n].values() if self.fuzzy[k]}
        best: dict[int, int] = {}
        for n, e in pairs:
            best[n] = min(e, best.get(n, e))
        key = tuple(sorted(best.items()))
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
        return self.number[key]

    def step(self, state: int, c: str) -> int:
        if (state, c) not in self.steps:
            to = set()
            for n, e in self.sets[state]:
                if c in self.child[n]:
                    to.add((self.child[n][c], e))
                if e < 1 and self.fuzzy[n]:
                    to.add((n, 1))
                    to |= {(k, 1) for k in self.child[n].values() if self.fuzzy[k]}
            self.steps[state, c] = self.state(to)
        return self.steps[state, c]

    def match(self, w: str) -> tuple[int, int] | None:
        """Entry and edits (0 or 1) of the best match of a word: whole words and stems without an edit first."""
        state, best = self.start, None
        for k, c in enumerate(w, 1):
            state = self.step(state, c)
            if state < 0:
                break
            for n, e in self.sets[state]:
                if n in self.stem and (not e or self.lengths[self.stem[n]] > FUZZY and k >= self.lengths[self.stem[n]]):
                    best = min(best, (e, self.stem[n])) if best else (e, self.stem[n])
        else:
            for n, e in self.sets[state]:
                if n in self.word and (not e or self.lengths[self.word[n]] >= FUZZY):
                    best = min(best, (e, self.word[n])) if best else (e, self.word[n])
        return (best[1], best[0]) if best else None

    def mass(self, text: str | None) -> float:
        """Weight of the different toxic words of a text; a word counts by its worst context, a stem from as many words as it asks for."""
        low = (text or "").lower()
        tokens = WORDS.findall(low)
        new = set(tokens).difference(self.clean)
        hits = {w: m for w in new if (m := self.match(w))}
        self.clean.update(new.difference(hits))
        self.forget()
        if not hits:
            return 0.0
        weight, inside = dict.fromkeys(hits, 0.0), quoted(low)
        for i, w in enumerate(tokens):
            if w in weight and weight[w] < ADDRESSED:
                around = tokens[max(0, i - CONTEXT) : i + CONTEXT + 1]
                here = REPORTED if i in inside or not REPORTS.isdisjoint(around) else ADDRESSED if not ADDRESS.isdisjoint(around) else 1.0
                weight[w] = max(weight[w], here)
        total, stems = 0.0, {}
        for w, (entry, edits) in hits.items():
            x = weight[w] * self.weights[entry] * (MISSPELLED if edits else 1.0)
            if self.repeats[entry]:
                stems.setdefault(entry, []).append(x)
            else:
                total += x
        return total + sum(sum(x) / self.repeats[k] for k, x in stems.items() if len(x) >= self.repeats[k])


_matchers: dict[tuple, Matcher] = {}


def matcher(lexicon: tuple[Entry, ...]) -> Matcher:
    """One for each Python worker and lexicon."""
    if lexicon not in _matchers:
        _matchers.clear()
        _matchers[lexicon] = Matcher(list(lexicon))
    return _matchers[lexicon]


def score_masses(texts: DataFrame, lexicon: list[Entry]) -> DataFrame:
    """All columns of texts but text, and mass. Only the lexicon is sent to the tasks."""
    spark, key = texts.sparkSession, tuple(lexicon)
    bound_batches(spark)
    keep = [c for c in texts.columns if c != "text"]

    def run(batches: Batches) -> Batches:
        m = matcher(key)
        for batch in batches:
            yield rows_of(batch, keep, mass=pa.array([m.mass(x) for x in column(batch, "text")], pa.float64()))

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.mapInArrow(run, f"{kinds}, mass double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted, mass.

    labels (doc_id, toxic) of the fold that is held out are not read into the model. Whole texts are scored in one narrow pass.
    The lexicon has as many entries as the sample makes sure of. Texts and quotations of any length count whole.
    Null and empty texts have no hits and get the curve's lowest score; without labels of both kinds all scores are the
    share of toxic ones; null doc_ids are not held out; repeated rows are rows of their own; other columns are not read.
    """
    lexicon, (a, b) = learn(docs, labels, rows)
    scored = score_masses(docs.select("doc_id", "text"), lexicon)
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p("mass"))))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "mass")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rows that toxicity() predicts, in docs' columns, in one narrow pass."""
    lexicon, (a, b) = learn(docs, labels, rows)
    key = tuple(lexicon)
    bound_batches(docs.sparkSession, **SMALL)

    def run(batches: Batches) -> Batches:
        m = matcher(key)
        for batch in batches:
            mass = np.array([m.mass(x) for x in column(batch, "text")])
            yield batch.filter(pa.array(1 / (1 + np.exp(-(a + b * np.log1p(mass)))) < threshold))

    return docs.mapInArrow(run, docs.schema)
