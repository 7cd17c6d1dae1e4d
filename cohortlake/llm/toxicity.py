"""Toxicity scores: a learned lexicon, matched with misspellings, weighed by context.

Lexicon. Words and word beginnings of four to eight characters that occur in at least ``support``
toxic documents of a labelled sample and whose log odds are ``odds`` or more; the log odds are their
weight. A word that has nearly all documents of its beginnings to itself is a fixed word and
replaces them; all other words are matched by their beginnings, the strongest of which counts.

Matching. All terms are one trie. A word is read by the Levenshtein automaton of that trie: its states
are sets of (trie node, edits so far), made when first reached and numbered, so that a word
costs one table look-up per character. Terms of five characters or more allow one edit, from nine on two;
a beginning accepts as soon as it is complete. Words that ordinary documents of the sample use
(``FAMILIAR`` of them or more) and that are no terms are not taken for misspellings.

Context. A match counts as quotation if a quote mark or a word of report stands within ``WINDOW``
words, else as abuse; a logistic model over the weights of both kinds, exact and misspelled, and
over how many different words match (a single one is often chance), gives the score.

Lexicon and model are fitted from about ``rows`` labelled documents; every document is then
scored in one pass without a shuffle. Null and empty texts have no matches. Without toxic
examples the lexicon is empty and all scores are near zero.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.labelled import held_out, sample
from cohortlake.llm.store import drop, stage
from cohortlake.llm.words import binary_texts

ROWS, SUPPORT, ODDS, FAMILIAR, WINDOW, CACHE, STATES, THRESHOLD = 16_384, 8, 1.5, 2, 6, 1 << 19, 1 << 15, 0.3
BEGINNINGS = (4, 5, 6, 7, 8)
QUOTES = "\"“”„«»‹›‘’`>"
REPORT = frozenset(
    "said says wrote writes quote quoted quotes quoting called term word slur dit dite écrit cité mot dijo dice escribió "
    "cita palabra sagte sagt schrieb zitat wort zitiert".split()
)
TRIM = " .,;:!?'()[]{}*#$%&-_/\\|~^=+@<" + QUOTES


def normal(word: str) -> str:
    return word.strip(TRIM).lower()


def allowed(length: int) -> int:
    """Edits within which a term of this length may be met."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """The Levenshtein automaton of all terms at once, built while words are read.

    A state holds, for every trie node that some spelling of what was read reaches, the fewest edits; nodes
    below which no term allows that many are left out. ``STATES`` bounds the memory: beyond it the table
    starts anew, which changes no result.
    """

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.depth, self.most, self.whole, self.start = [0], [0], [0.0], [0.0]
        for term, weight in terms.items():
            stem = term.removesuffix("*")
            edits = allowed(len(stem))
            if not edits:
                continue
            node = 0
            self.most[0] = max(self.most[0], edits)
            for c in stem:
                child = self.children[node].get(c)
                if child is None:
                    child = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.most.append(0)
                    self.whole.append(0.0)
                    self.start.append(0.0)
                node = child
                self.most[node] = max(self.most[node], edits)
            (self.whole if stem == term else self.start)[node] = weight
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.at_end: list[float] = []
        self.at_once: list[float] = []
        self.dead = self.number({})
        self.first = self.number({0: 0})

    def number(self, least: dict[int, int]) -> int:
        """The state that holds these nodes and those reached by leaving out characters of terms."""
        todo = list(least)
        while todo:
            node = todo.pop()
            edits = least[node] + 1
            for child in self.children[node].values():
                if edits <= self.most[child] and least.get(child, 9) > edits:
                    least[child] = edits
                    todo.append(child)
        state = frozenset(least.items())
        if (known := self.numbers.get(state)) is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            accepted = [n for n, e in state if e <= allowed(self.depth[n])]
            self.at_end.append(max((self.whole[n] for n in accepted), default=0.0))
            self.at_once.append(max((self.start[n] for n in accepted), default=0.0))
        return known

    def step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}
        for node, edits in self.states[state]:
            more = edits + 1
            children = self.children[node]
            if more <= self.most[node]:
                least[node] = min(least.get(node, 9), more)
                for child in children.values():
                    if more <= self.most[child]:
                        least[child] = min(least.get(child, 9), more)
            if (child := children.get(c)) is not None and edits <= self.most[child]:
                least[child] = min(least.get(child, 9), edits)
        after = self.moves[state][c] = self.number(least)
        return after

    def best(self, word: str) -> float:
        """Largest weight of a term within its edits of the word, or of its start for a beginning; zero if none."""
        if len(self.states) > STATES:
            self.clear()
        state, weight = self.first, 0.0
        for c in word:
            after = self.moves[state].get(c)
            state = self.step(state, c) if after is None else after
            if state == self.dead:
                return weight
            if self.at_once[state] > weight:
                weight = self.at_once[state]
        return max(weight, self.at_end[state])


class Lexicon:
    """Terms as they are and their automaton; ``familiar`` words are no misspellings."""

    def __init__(self, terms: dict[str, float], familiar: frozenset[str] = frozenset()):
        self.whole = {t: w for t, w in terms.items() if not t.endswith("*")}
        self.starts = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.lengths = sorted({len(t) for t in self.starts})
        self.automaton = Automaton(terms)
        self.familiar = familiar
        self.seen: dict[str, tuple[float, bool, str]] = {}  # raw words matched before

    def match(self, word: str) -> tuple[float, bool]:
        """(weight, misspelled) of the best term for a normal word; weight zero if none."""
        if (weight := self.whole.get(word)) is not None:
            return weight, False
        if weight := max((self.starts.get(word[:n], 0.0) for n in self.lengths), default=0.0):
            return weight, False
        if word in self.familiar:
            return 0.0, False
        return self.automaton.best(word), True

    def look_up(self, raw: str) -> tuple[float, bool, str]:
        word = normal(raw)
        found = (*self.match(word), word) if len(word) > 2 else (0.0, False, word)
        if len(self.seen) > CACHE:
            self.seen.clear()
        if len(raw) <= 64:
            self.seen[raw] = found
        return found

    def features(self, text: bytes | None) -> list[float]:
        """Weights of matches by kind (abuse exact, abuse misspelled, quoted exact, quoted misspelled); whether more
        than 0, 1, 2 and 3 different words match exactly, and more than 0 and 1 misspelled; the strongest of
        each; the share of exact matches."""
        found = [0.0] * 4
        words = text.decode("utf-8", "replace").split() if text else []
        hits = {}
        for raw in set(words):
            hit = self.seen.get(raw) or self.look_up(raw)
            if hit[0]:
                hits[raw] = hit
        count = 0
        if hits:
            for i, raw in enumerate(words):
                if raw in hits:
                    weight, wrong, _ = hits[raw]
                    around = words[max(0, i - WINDOW) : i + WINDOW + 1]
                    quoted = any(q in w for w in around for q in QUOTES) or not REPORT.isdisjoint(map(normal, around))
                    found[2 * quoted + wrong] += weight
                    count += not wrong
        right = {w: weight for weight, wrong, w in hits.values() if not wrong}
        wrong = {w: weight for weight, wrong, w in hits.values() if wrong}
        several = [float(len(right) > n) for n in range(4)] + [float(len(wrong) > n) for n in range(2)]
        strongest = [max(right.values(), default=0.0), max(wrong.values(), default=0.0)]
        return [*(math.log1p(x) for x in found), *several, *strongest, math.sqrt(count / (len(words) + 10))]


N_FEATURES = 13


def learn_terms(chosen: DataFrame, *, support: int = SUPPORT, odds: float = ODDS) -> tuple[dict[str, float], frozenset[str]]:
    """Terms with their log odds, and the familiar words among those that the automaton would accept.

    All of them are kept; their number is bounded by the sample's words.
    """

    def count(batches):
        for batch in batches:
            bad, good = Counter(), Counter()
            for text, label in zip(binary_texts(batch, "text"), batch.column(1).to_pylist()):
                words = {w for w in map(normal, set((text or b"").decode("utf-8", "replace").split())) if 2 < len(w)}
                (bad if label else good).update(words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n})
            keys = list(bad.keys() | good.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([good[k] for k in keys], pa.int64())],
                names=["term", "bad", "good"],
            )

    totals = chosen.groupBy().agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    n_bad, n_good = totals[0] or 0, totals[1] or 0
    ratio = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    sums = chosen.mapInArrow(count, "term string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = stage(sums.withColumn("ratio", ratio), "words")
    rows = counted.where((F.col("bad") >= support) & (F.col("ratio") >= odds)).collect()
    found = {r["term"]: r["ratio"] for r in rows}
    docs = {r["term"]: r["bad"] for r in rows}
    fixed = {
        t for t in found
        if not t.endswith("*") and all(docs[t] >= 0.9 * docs.get(t[:n] + "*", 0) for n in BEGINNINGS if n < len(t))
    }
    covered = {t[:n] + "*" for t in fixed for n in BEGINNINGS if n < len(t) and docs[t] >= 0.9 * docs.get(t[:n] + "*", 0)}
    terms = {t: found[t] for t in sorted(found) if t in fixed or (t.endswith("*") and t not in covered)}

    def accepted(batches):
        automaton = Automaton(terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if automaton.best(w)], pa.string())], names=["term"])

    ordinary = counted.where((F.col("good") >= FAMILIAR) & (F.col("ratio") < odds) & ~F.col("term").endswith("*")).select("term")
    familiar = frozenset(r["term"] for r in ordinary.mapInArrow(accepted, "term string").collect())
    drop(counted)
    return terms, familiar


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    if not y.any():
        w[-1] = -30.0
        return w
    penalty = np.full(x.shape[1], ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, terms: dict[str, float], familiar: frozenset[str], weights: np.ndarray):
        self.terms, self.familiar, self.weights = terms, familiar, weights


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", parts: int = 4, part: int = 2, rows: int = ROWS, **options) -> Model:
    """Lexicon and weights from about ``rows`` labelled documents outside the held-out part."""
    chosen = stage(sample(docs, labels, label, parts, part, rows), "labelled")
    terms, familiar = learn_terms(chosen, **options)

    def scan(batches):
        lexicon = Lexicon(terms, familiar)
        for batch in batches:
            found = [lexicon.features(t) for t in binary_texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    seen = chosen.mapInArrow(scan, "x array<double>, label int").toPandas()
    drop(chosen)
    x = np.array(seen["x"].tolist(), np.float64).reshape(-1, N_FEATURES)
    y = seen["label"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))
    return Model(terms, familiar, fit_weights(x[order], y[order]))


def scores(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row. Other columns are not read."""
    terms, familiar, weights = model.terms, model.familiar, model.weights

    def scan(batches):
        lexicon = Lexicon(terms, familiar)
        for batch in batches:
            x = np.array([lexicon.features(t) for t in binary_texts(batch, "text")], np.float64).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, *, parts: int = 4, part: int = 2, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = fit(docs, labels, parts=parts, part=part, **options)
    return scores(docs, model).select(
        "doc_id", held_out("doc_id", parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
