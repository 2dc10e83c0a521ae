"""Toxicity: misspelled lexicon terms by Levenshtein automata, weighed by their context.

The lexicon (words, and stems with many endings) is learned from labelled texts
and kept as a trie.  The product of the trie and the automaton of up to one edit
is made deterministic while words are read, so that a word costs one lookup per
letter.  A hit counts less where its context window quotes or reports, and more
where it addresses; a logistic model turns the weighed hits into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanmill.llm.common import held_out

#: Fixed words of the context rules.
REPORTING = frozenset("said says wrote writes called calls quoted quotes quote reported term word words phrase cited dit écrit sagte schrieb dijo escribió".split())
ADDRESSING = frozenset("you your you're youre ur u are tu vous du ihr dich tú usted eres".split())
QUOTES = "\"'“”‘’«»„‹›"
EDGES = ".,;:!?()[]{}<>*_~|/\\-…" + QUOTES
REACH = 5
FUZZY, QUOTED, ADDRESSED = 0.7, 0.4, 1.3
REMEMBERED = 200_000


class Automaton:
    """Words within one edit of the terms; terms may be stems, which any ending may follow."""

    def __init__(self, terms: list[tuple[str, bool, bool]]):
        """terms: (letters, is a stem, may be misspelled)."""
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, list[int]] = {}
        for k, (letters, _, _) in enumerate(terms):
            node = 0
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.ends.setdefault(node, []).append(k)
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self.number({(0, 0)}, {})

    def number(self, places: set[tuple[int, int]], stems: dict[int, int]) -> int:
        """State of (node, edits) places and of the stems already seen, with letters of the trie left out added."""
        places = set(places)
        for node, edits in [p for p in places if p[1] == 0]:
            places |= {(child, 1) for child in self.children[node].values()}
        best = dict(stems)
        for node, edits in places:
            for k in self.ends.get(node, ()):
                if self.terms[k][1] and (edits == 0 or self.terms[k][2]):
                    best[k] = min(edits, best.get(k, 2))
        places = {(n, e) for n, e in places if e == 0 or (n, 0) not in places}
        key = frozenset(places) | frozenset((-1 - k, e) for k, e in best.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            found = [(e, k) for k, e in best.items()]
            for node, edits in places:
                for k in self.ends.get(node, ()):
                    if edits == 0 or self.terms[k][2]:
                        found.append((edits, k))
            self.accepts.append(min(found, default=None))
        return self.numbers[key]

    def step(self, state: int, letter: str) -> int:
        to = self.moves[state].get(letter)
        if to is None:
            places: set[tuple[int, int]] = set()
            stems: dict[int, int] = {}
            for node, edits in self.sets[state]:
                if node < 0:
                    stems[-1 - node] = edits
                    continue
                if letter in self.children[node]:
                    places.add((self.children[node][letter], edits))
                if edits == 0:
                    places.add((node, 1))
                    places |= {(child, 1) for child in self.children[node].values()}
            to = self.moves[state][letter] = self.number(places, stems)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, or None."""
        state = self.start
        for letter in word:
            state = self.step(state, letter)
            if not self.sets[state]:
                return None
        return self.accepts[state]


@dataclass
class Model:
    terms: list[tuple[str, bool, bool]]
    weights: list[float]
    automaton: Automaton | None = field(default=None, repr=False)
    memory: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "automaton": None, "memory": {}}

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(place, edits, term) of all words near a term."""
        if self.automaton is None:
            self.automaton = Automaton(self.terms)
        found, memory = [], self.memory
        for at, word in enumerate(words):
            hit = memory.get(word, 0)
            if hit == 0:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                hit = memory[word] = self.automaton.match(word.strip(EDGES))
            if hit is not None:
                found.append((at, *hit))
        return found

    def features(self, text: str | None) -> list[float]:
        words = (text or "").lower().split()
        total, kinds = 0.0, set()
        for at, edits, term in self.hits(words):
            total += (FUZZY if edits else 1.0) * context_weight(words, at)
            kinds.add(term)
        return [1.0, min(total, 3.0), math.log1p(total), 100.0 * total / (len(words) + 20), float(min(len(kinds), 3))]

    def score(self, text: str | None) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def context_weight(words: list[str], at: int) -> float:
    """How much a hit counts by the words around it: quoted or reported less, addressed more."""
    word, window = words[at], words[max(0, at - REACH) : at + REACH + 1]
    near = {w.strip(EDGES) for w in window}
    quoted = word[0] in QUOTES and word.rstrip(".,;:!?)")[-1:] in QUOTES and word[0] != "'"
    if quoted or near & REPORTING:
        return QUOTED
    return ADDRESSED if near & ADDRESSING else 1.0


def first_shingle(words: list[str]) -> int:
    """The same for most near copies: the least hash of five words in a row."""
    import xxhash

    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)


def learn(rows: list[tuple[str | None, int]], least_ratio: float = 20.0) -> Model:
    """Lexicon and weights from (text, toxic) rows; near copies count once."""
    seen, texts = set(), []
    for text, toxic in rows:
        words = (text or "").lower().split()
        key = (first_shingle(words), toxic)
        if words and key not in seen:
            seen.add(key)
            texts.append((text, words, int(toxic == 1)))
    bad = sum(t for _, _, t in texts)
    good = len(texts) - bad
    least = max(3, bad // 200)
    in_bad, in_good = Counter(), Counter()
    stem_bad, stem_good = Counter(), Counter()
    for _, words, toxic in texts:
        own = {w.strip(EDGES) for w in words}
        stems = {w[:n] for w in own for n in range(4, 7) if len(w) > n}
        (in_bad if toxic else in_good).update(own)
        (stem_bad if toxic else stem_good).update(stems | {w for w in own if 4 <= len(w) <= 6})

    def telling(term: str, yes: Counter, no: Counter) -> bool:
        return yes[term] >= least and (yes[term] / max(bad, 1)) >= least_ratio * (no[term] + 0.5) / max(good, 1)

    endings: Counter = Counter()
    for w in in_bad:
        endings.update(w[:n] for n in range(4, 7) if len(w) > n)
    told = {s for s in stem_bad if endings[s] >= 4 and telling(s, stem_bad, stem_good)}
    stems = []
    for term in sorted(told, key=len):
        # a longer stem that keeps most of the toxic texts and sheds the clean ones is the better one
        sharper = any(
            len(s) > len(term) and s.startswith(term)
            and 10 * stem_bad[s] >= 8 * stem_bad[term] and 2 * stem_good[s] < stem_good[term]
            for s in told
        )
        if not sharper and not any(term.startswith(s) for s in stems):
            stems.append(term)
    words = [w for w in in_bad if len(w) >= 3 and telling(w, in_bad, in_good) and not any(w.startswith(s) for s in stems)]
    terms = sorted([(s, True, True) for s in stems] + [(w, False, True) for w in words])
    # a term whose misspellings turn up in clean texts is held to its exact letters
    model, loose = Model(terms, [0.0] * 5), Counter()
    for _, words_, toxic in texts:
        if not toxic:
            loose.update({k for _, edits, k in model.hits(words_) if edits})
    terms = [(t, s, f and loose[k] * 1000 <= good) for k, (t, s, f) in enumerate(terms)]
    model = Model(terms, [0.0] * 5)
    x = np.array([model.features(text) for text, _, _ in texts] or [[1.0, 0, 0, 0, 0]])
    y = np.array([t for _, _, t in texts] or [0], float)
    model.weights = logistic(x, y).tolist()
    model.automaton, model.memory = None, {}
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method on the penalised likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w + np.linalg.solve(bend, slope)
    return w


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 3000, clean_rows: int = 6000) -> Model:
    """Learn from labelled documents outside the held-out fifth.

    The sample is bounded: at most ``toxic_rows`` and ``clean_rows`` labelled ids, those first by
    md5 of the id.  Rows without label, id or text teach nothing.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(toxic_rows).unionByName(
        known.where("toxic = 0").orderBy(order, "doc_id").limit(clean_rows)
    )
    # both limits bound what is broadcast and what comes to the driver
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy("doc_id", "text").select("text", "toxic").limit(2 * (toxic_rows + clean_rows)).collect()
    return learn([(r["text"], r["toxic"]) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of ``docs`` (doc_id, text; other columns are not read).

    A map over whole texts: no row moves.  Null, empty and blank texts score as
    texts without hits; repeated rows score alike; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(text) for text in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, schema)
