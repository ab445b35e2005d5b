"""Toxicity by Levenshtein automata intersected with a trie of a learned lexicon.

The lexicon is learned from labelled documents: words, and beginnings of words, that documents with label 1 hold far
more often than others. Words of a text run through one automaton, the intersection of the trie with the Levenshtein
automata of all its entries, made deterministic as words need it; it accepts misspelled entries too. Each hit counts
by how near it is to an entry and by its context window: a hit inside quotation marks, or near words that report
speech, counts apart. A logistic model over a few such counts gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructType

from .common import map_texts

#: The bound of what is learned from: labelled rows. Nothing that is scored is bounded.
FIT_ROWS = 6_000
#: Beginnings of words of these lengths can be entries.
STEMS = (4, 5, 6)
#: An entry is found in so many toxic texts at least, and in this share of them, at these odds to others.
MIN_FOUND, MIN_SHARE, MIN_ODDS = 3, 0.01, 12.0
#: Entries of at least so many letters and this weight match at one edit.
FUZZY, FUZZY_WEIGHT = 5, 4.2
WINDOW = 6
CACHED_WORDS = 150_000
FOLDS, HELD_OUT = 5, 0

#: Words near which a term is reported rather than used.
REPORTING = frozenset("said says called calling quote quoted quotes word words term wrote writes zitat sagte wort cité dit mot dijo palabra cita".split())

_TOKEN = re.compile(r"[^\W_]+|[\"“”„«»]")
_QUOTES = frozenset("\"“”„«»")

_HITS = ArrayType(
    StructType().add("begin", IntegerType()).add("end", IntegerType()).add("word", StringType()).add("weight", DoubleType()).add("edits", IntegerType()).add("quoted", BooleanType())
)

FEATURES = ("weight", "density", "any")


class LexiconAutomaton:
    """Accepts words within one edit of an entry. Entries that end in * accept any continuation.

    A state is a set of (trie node, edits so far); its successors are computed once per letter. The dead state ends most
    words early."""

    def __init__(self, entries: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.depth = [0]
        for entry, weight in sorted(entries.items()):
            node = 0
            for c in entry.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(0.0)
                    self.stem.append(0.0)
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][c]
            kind = self.stem if entry.endswith("*") else self.word
            kind[node] = max(kind[node], weight)
        self.long = [False] * len(self.children)  # whether an entry of FUZZY letters or more is at or below a node
        self._mark(0)
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stems: list[tuple[float, float] | None] = []  # greatest weights by edits, of stems that a state has reached
        self.words: list[tuple[float, float] | None] = []  # and of entries that end here
        self.dead = self._id(frozenset())
        self.start = self._id(self._close({(0, 0)}))

    def _fuzzy(self, node: int, kind: list[float]) -> bool:
        return self.depth[node] >= FUZZY and kind[node] >= FUZZY_WEIGHT

    def _mark(self, root: int) -> None:
        order = [root]
        for n in order:
            order.extend(self.children[n].values())
        for n in reversed(order):
            here = self._fuzzy(n, self.word) or self._fuzzy(n, self.stem)
            self.long[n] = here or any(self.long[c] for c in self.children[n].values())

    def _close(self, state: set) -> frozenset:
        """With what a letter that is missing from the word leads to."""
        for node, edits in list(state):
            if edits == 0:
                state.update((c, 1) for c in self.children[node].values() if self.long[c])
        return frozenset(x for x in state if x[1] == 0 or (x[0], 0) not in state)

    def _id(self, state: frozenset) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.moves)
            self.states.append(state)
            self.moves.append({})
            stem, word = [0.0, 0.0], [0.0, 0.0]
            for node, edits in state:
                if edits == 0 or self._fuzzy(node, self.stem):
                    stem[edits] = max(stem[edits], self.stem[node])
                if edits == 0 or self._fuzzy(node, self.word):
                    word[edits] = max(word[edits], self.word[node])
            self.stems.append(tuple(stem) if any(stem) else None)
            self.words.append(tuple(word) if any(word) else None)
        return self.ids[state]

    def _move(self, at: int, c: str) -> int:
        out = set()
        for node, edits in self.states[at]:
            if c in self.children[node]:
                out.add((self.children[node][c], edits))
            if edits == 0:
                out.add((node, 1))  # a letter too many
                out.update((n, 1) for n in self.children[node].values())  # another letter
        out = {x for x in out if x[1] == 0 or self.long[x[0]]}
        to = self._id(self._close(out))
        self.moves[at][c] = to
        return to

    def match(self, word: str) -> tuple[float, int]:
        """The greatest weight of an entry that word matches, exactly if any does so, and the edits; (0, 0) if none."""
        at, moves, stems, dead = self.start, self.moves, self.stems, self.dead
        exact = near = 0.0
        for c in word:
            to = moves[at].get(c)
            at = self._move(at, c) if to is None else to
            if at == dead:
                break
            if found := stems[at]:
                exact, near = max(exact, found[0]), max(near, found[1])
        if found := self.words[at]:
            exact, near = max(exact, found[0]), max(near, found[1])
        return (exact, 0) if exact else (near, 1) if near else (0.0, 0)


class Matcher(dict):
    """The match of each word, computed once while it is kept."""

    def __init__(self, automaton: LexiconAutomaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[float, int] | None:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self.automaton.match(word)
        out = self[word] = found if found[0] else None
        return out


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray  # of FEATURES and a constant


def spans(text: str, matcher: Matcher) -> list[tuple[int, int, str, float, int, bool]]:
    """begin, end, word, weight, edits, quoted of each hit: quoted inside quotation marks or near a word of reporting."""
    tokens = list(_TOKEN.finditer(text.lower()))
    inside, opened, last = [], False, -1
    for i, t in enumerate(tokens):
        if t.group() in _QUOTES:
            opened, last = not opened, i
        inside.append(opened)
    out = []
    for i, t in enumerate(tokens):
        if found := matcher[t.group()]:
            window = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            closed = inside[i] and i < last
            out.append((t.start(), t.end(), t.group(), *found, closed or any(x.group() in REPORTING for x in window)))
    return out


def features(text: str | None, matcher: Matcher) -> list[float]:
    """Over the whole text: FEATURES and a constant."""
    words = _TOKEN.findall((text or "").lower())
    if not any(map(matcher.__getitem__, words)):  # most texts: no positions are needed
        return [0.0] * len(FEATURES) + [1.0]
    n = weight = 0.0
    for *_, w, edits, in_quotes in spans(text, matcher):
        n += 1
        weight += w * (0.5 if edits else 1.0) * (0.25 if in_quotes else 1.0)
    return [math.log1p(weight), min(1.0, 50 * n / len(words)), 1.0, 1.0]


def learn_lexicon(texts: list[str | None], toxic: list[int]) -> dict[str, float]:
    """Entries and their weights, the logarithm of their odds: words, and stems marked by *, that at least MIN_FOUND toxic
    documents hold, at odds of MIN_ODDS or more to documents that are not. Texts that are equal but for case count
    once. A stem displaces longer entries it begins."""
    first = {((text or "").lower(), label): text for text, label in zip(texts, toxic, strict=True)}
    texts, toxic = list(first.values()), [label for _, label in first]
    counts = (Counter(), Counter())
    for text, label in zip(texts, toxic, strict=True):
        words = {w for w in _TOKEN.findall((text or "").lower()) if w not in _QUOTES}
        found = {w for w in words if len(w) >= 3}
        found |= {w[:k] + "*" for w in words for k in STEMS if len(w) > k}
        counts[label == 1].update(found)
    n = [max(1, sum((y == 1) == k for y in toxic)) for k in (False, True)]
    odds = {}
    for entry, k in counts[1].items():
        if k >= max(MIN_FOUND, MIN_SHARE * n[1]) and (o := ((k + 0.5) / (n[1] + 1)) / ((counts[0][entry] + 0.5) / (n[0] + 1))) >= MIN_ODDS:
            odds[entry] = math.log(o)
    # A stem says more than its words only if it is found in clearly more documents than each of them.
    stems = {e for e in odds if e.endswith("*") and counts[1][e] > 1.2 * max((counts[1][w] for w in odds if not w.endswith("*") and w.startswith(e[:-1])), default=0)}
    kept = {}
    for e in sorted(odds, key=lambda e: (len(e), e)):
        if e.endswith("*") and e not in stems:
            continue
        if not any(e[:k] + "*" in kept for k in STEMS if k < len(e.rstrip("*"))):
            kept[e] = odds[e]
    return kept


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """Learns the lexicon and the model of the score. Without a row of either label, everything scores as unlikely."""
    if not any(y == 1 for y in toxic) or all(y == 1 for y in toxic):
        return Model({}, np.array([0.0] * len(FEATURES) + [-4.0 if not any(y == 1 for y in toxic) else 4.0]))
    # Features come from a lexicon learned without the document itself, else every entry looks surer than it is.
    folds = 3
    parts = np.arange(len(texts)) % folds
    x = np.zeros((len(texts), len(FEATURES) + 1))
    for k in range(folds):
        others = [i for i in range(len(texts)) if parts[i] != k]
        matcher = Matcher(LexiconAutomaton(learn_lexicon([texts[i] for i in others], [toxic[i] for i in others])))
        for i in np.flatnonzero(parts == k):
            x[i] = features(texts[i], matcher)
    w = logistic(x, np.array(toxic, float))
    return Model(learn_lexicon(texts, toxic), w)


def fold(doc_id):
    """crc32 of doc_id as text, mod FOLDS."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits on at most rows labelled documents outside the held-out fold, those of the smallest hash of doc_id.

    Toxic documents fill up to half of the sample. Rows whose label or doc_id is null are not learned from."""
    known = labels.select("doc_id", F.col("toxic").alias("_toxic")).filter("toxic is not null and doc_id is not null")
    known = known.filter(fold(F.col("doc_id")) != HELD_OUT).withColumn("_at", F.xxhash64("doc_id"))
    half = [known.filter(c).orderBy("_at", "doc_id").limit(rows // 2) for c in ("_toxic = 1", "_toxic <> 1")]
    chosen = half[0].unionByName(half[1]).groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"))
    # rows rows at most: this broadcast does not grow with the data.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).collect()
    return fit([r.text for r in sample], [int(r._toxic == 1) for r in sample])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and hits, an array of (begin, end, word, weight, edits, quoted). Null and empty texts have no
    hits and the score of the constant."""
    lexicon, weights = model.lexicon, model.weights
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(LexiconAutomaton(lexicon))
        hit = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("word", pa.string()), ("weight", pa.float64()), ("edits", pa.int32()), ("quoted", pa.bool_())])
        for b in batches:
            scores, hits = [], []
            for text in b.column(0).to_pylist():
                f = features(text, matcher)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(f, weights)))))))
                keys = ("begin", "end", "word", "weight", "edits", "quoted")
                hits.append([dict(zip(keys, h, strict=True)) for h in spans(text, matcher)] if f[-2] else [])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores, pa.float64()), pa.array(hits, pa.list_(hit))], names=[*b.schema.names[1:], "score", "hits"])

    rows = docs.select(docs["text"].alias("_text"), *[docs[c] for c in names if c not in ("score", "hits")])
    schema = rows.drop("_text").schema.add("score", "double").add("hits", _HITS)
    return map_texts(rows, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits: a row per row of docs(doc_id, text, ...), learned from labels(doc_id, toxic).

    A null doc_id is in no fold (held_out false). See score and train for null texts and labels; without labels every
    document scores low; an empty table gives no rows; rows that repeat are scored alike; other columns are ignored."""
    out = score(docs.select("doc_id", "text"), train(docs, labels, rows))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("hits").alias("n_hits"))


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """docs whose score is below 0.5, with their own columns, whatever their names. Null and empty texts have no hits."""
    names = docs.columns
    at = [c.lower() for c in names].index("text")
    plain = docs.toDF(*["text" if i == at else f"c{i}" for i in range(len(names))])
    return score(plain, train(docs, labels, rows)).filter("score < 0.5").drop("score", "hits").toDF(*names)
