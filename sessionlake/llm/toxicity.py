"""Toxicity by misspelling-tolerant lexicon matches and the windows around them.

The lexicon is words and word stems that labelled rows tie to toxic texts. Its
trie is intersected with Levenshtein automata: a state is the set of (trie node,
edits so far) that the read letters can have led to, so one walk over a word
tests it against all terms at once. States and transitions are made when first
needed and kept; a word leaves as soon as its state is empty.

A match is weighed by what stands around it: quotation marks and words of
reporting speak for quotation, words that address somebody for abuse, more
matches in the window for abuse. A logistic model on these counts gives the
score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.llm import columns, simhash

#: Labelled rows that the model is fitted on at most, of each label. They bound the terms too, which evidence alone chooses.
SAMPLE_PER_LABEL = 5_000
#: A term needs so many toxic texts, to be so many times as frequent in them as in others, and nats of evidence that this is not chance.
LEAST_TEXTS, LEAST_RATIO, LEAST_EVIDENCE = 4, 20.0, 12.0
STEM_LETTERS = (4, 5, 6, 7, 8)
#: Words on each side of a match that are looked at.
WINDOW = 8
#: A text is read in pieces of so many characters, cut at white space.
PIECE_CHARS = 1_000_000
#: Words whose result a worker remembers, and states that its automaton keeps; beyond them it forgets and makes them anew.
CACHE_WORDS, MOST_STATES = 200_000, 50_000

# Terms known beforehand, and cues around a match.
SEED_TERMS = ["idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown"]
REPORTING = ["said", "says", "called", "calls", "wrote", "writes", "quote", "quoted", "word", "term", "reported", "according", "dit", "dijo", "sagte", "mot", "palabra", "wort"]
ADDRESSING = ["you", "your", "you're", "youre", "u", "yourself", "tu", "toi", "vous", "du", "dich", "dir", "sie", "ihr", "tú", "usted", "te"]

_WORD = re.compile(r"\w+")
_OPEN, _CLOSE = "\"'“‘«„`", "\"'”’»“`"

DEAD = 0


def allowed_edits(letters: int) -> int:
    """Edits that a whole word of so many letters may differ by."""
    return 0 if letters < 5 else 1 if letters < 9 else 2


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # any word that begins with it; no edits
    weight: float


class LexiconAutomaton:
    """The product of the terms' trie with the Levenshtein automata of a word that is being read."""

    def __init__(self, terms: list[Term]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]  # weight of the term that ends at a node
        self.stem: list[float] = [0.0]
        self.edits: list[int] = [-1]  # most edits of any whole word at or below a node
        self.own: list[int] = [-1]
        for term in terms:
            path = [0]
            for letter in term.text:
                node = self.children[path[-1]].get(letter)
                if node is None:
                    node = len(self.children)
                    self.children[path[-1]][letter] = node
                    self.children.append({})
                    self.word.append(0.0), self.stem.append(0.0), self.edits.append(-1), self.own.append(-1)
                path.append(node)
            if term.stem:
                self.stem[path[-1]] = max(self.stem[path[-1]], term.weight)
            else:
                most = allowed_edits(len(term.text))
                self.word[path[-1]] = max(self.word[path[-1]], term.weight)
                self.own[path[-1]] = max(self.own[path[-1]], most)
                for node in path:
                    self.edits[node] = max(self.edits[node], most)
        self.letters = {letter for own in self.children for letter in own}
        self.reset()

    def reset(self) -> None:
        """Forget the states made so far."""
        self.states: list[tuple[tuple[int, int], ...]] = [()]
        self.found: list[tuple[float, int, bool]] = [(0.0, -1, False)]  # best weight if the word ends here, its edits, and whether a stem was met
        self.steps: list[dict[str, int]] = [{}]
        self.numbers: dict[tuple, int] = {(): DEAD}
        self.start = self._state({0: 0}, 0.0)

    def _state(self, nodes: dict[int, int], stem: float) -> int:
        todo = list(nodes)
        while todo:  # letters of the term that the word leaves out
            node = todo.pop()
            e = nodes[node] + 1
            for child in self.children[node].values():
                if e <= self.edits[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        key = (tuple(sorted(nodes.items())), stem)
        if not nodes and not stem:
            return DEAD
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key[0])
            self.steps.append({})
            best = (stem, 0, True) if stem else (0.0, -1, False)
            for node, e in key[0]:
                if self.word[node] and e <= self.own[node]:
                    best = max(best, (self.word[node] / (1 + e), e, False), key=lambda b: b[0])
            self.found.append(best)
        return number

    def _step(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}
        key = self.states[state]
        stem = self.found[state][0] if self.found[state][2] else 0.0

        def add(node: int, e: int) -> None:
            if (e <= self.edits[node] or (e == 0 and self._leads_to_stem(node))) and e < nodes.get(node, 99):
                nodes[node] = e

        for node, e in key:
            add(node, e + 1)
            for other, child in self.children[node].items():
                add(child, e if other == letter else e + 1)
                if other == letter and e == 0 and self.stem[child]:
                    stem = max(stem, self.stem[child])
        return self._state(nodes, stem)

    def _leads_to_stem(self, node: int) -> bool:
        if not hasattr(self, "_stems"):
            reach = [bool(s) for s in self.stem]
            for k in range(len(self.children) - 1, -1, -1):
                reach[k] = reach[k] or any(reach[c] for c in self.children[k].values())
            self._stems = reach
        return self._stems[node]

    def match(self, word: str) -> tuple[float, int, bool] | None:
        """(weight, edits, by a stem) of the best term that a lower-case word is near, or None."""
        if len(self.states) > MOST_STATES:
            self.reset()
        state, steps, letters = self.start, self.steps, self.letters
        for letter in word:
            if letter not in letters:
                letter = ""
            following = steps[state].get(letter)
            if following is None:
                following = steps[state][letter] = self._step(state, letter)
            if following == DEAD:
                return None
            state = following
        best = self.found[state]
        return best if best[0] else None


class _Cache(dict):
    def __init__(self, automaton: LexiconAutomaton):
        self.automaton = automaton

    def __missing__(self, word: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self.automaton.match(word)
        return found


def _text_pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE_CHARS:
        end = at + PIECE_CHARS
        while end > at + PIECE_CHARS // 2 and not text[end - 1].isspace():
            end -= 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


# Names of the counts that the model weighs, and what it believes of them before it sees labels.
FEATURES = ["any", "exact", "near", "stems", "quoted", "reported", "addressed", "crowded", "share"]
PRIOR = np.array([1.0, 1.0, 0.7, 0.7, -0.5, -0.3, 0.3, 0.3, 0.3])


def features(text: str, cache: _Cache) -> list[float]:
    """The counts of a text's matches by kind and by what stands around them; all zero without matches."""
    exact = near = stems = quoted = reported = addressed = crowded = 0.0
    words, weight = 0, 0.0
    for piece in _text_pieces(text):
        tokens = _WORD.findall(piece.lower())
        words += len(tokens)
        found = list(map(cache.__getitem__, tokens))
        if not any(found):
            continue
        at = [k for k, f in enumerate(found) if f]
        spans = [m.span() for m in _WORD.finditer(piece)]
        for n, k in enumerate(at):
            own, edits, stem = found[k]
            around = set(tokens[max(0, k - WINDOW) : k + WINDOW + 1])
            inside = False
            if len(spans) == len(tokens):
                left = piece[spans[max(0, k - WINDOW)][0] : spans[k][0]]
                right = piece[spans[k][1] : spans[min(len(spans) - 1, k + WINDOW)][1] + 2]
                inside = any(sum(map(left.count, {o, c})) % 2 == 1 and c in right for o, c in zip(_OPEN, _CLOSE))
            value = own * (0.3 if inside else 1.0)
            weight += value
            if inside:
                quoted += own
            elif stem:
                stems += own
            elif edits:
                near += own
            else:
                exact += own
            reported += bool(around & _REPORTING)
            addressed += bool(around & _ADDRESSING)
            crowded += n > 0 and k - at[n - 1] <= WINDOW
    if not (exact or near or stems or quoted):
        return [0.0] * len(FEATURES)
    return [1.0, *map(math.log1p, (exact, near, stems, quoted, reported, addressed, crowded)), min(1.0, 20 * weight / max(1, words))]


_REPORTING, _ADDRESSING = frozenset(REPORTING), frozenset(ADDRESSING)


def fit(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, spread: float = 4.0) -> np.ndarray:
    """Logistic weights (the constant first) by Newton steps, drawn towards PRIOR."""
    x = np.column_stack([np.ones(len(rows)), rows])
    prior = np.concatenate([[-2.0], PRIOR])
    pull = np.full(len(prior), 1.0 / spread)
    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (labels - p)) - pull * (beta - prior)
        curve = (x * (weights * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _terms_of(text: str) -> set[str]:
    """Whole words, and stems written with a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEM_LETTERS if len(w) > n}


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, other: int) -> list[Term]:
    """Terms from (term, toxic texts, other texts): rare ones and those not tied to toxic texts go; a stem covers the words and longer stems under it."""
    good = {}
    for term, a, b in rows:
        ratio = ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (other + 1))
        share, usual = a / max(1, a + b), toxic / max(1, toxic + other)
        evidence = a * math.log(share / usual) + (b * math.log((1 - share) / (1 - usual)) if b else 0.0) if a and 0 < usual < 1 else 0.0
        if a >= LEAST_TEXTS and ratio >= LEAST_RATIO and evidence >= LEAST_EVIDENCE:
            good[term] = (a, math.log(ratio))
    longer: dict[str, int] = {}  # the most toxic texts of any term that goes on where a stem ends, or is it as a word
    for term, (a, _) in good.items():
        text = term.rstrip("*")
        for n in STEM_LETTERS:
            if n < len(text) or (n == len(text) and term == text):
                longer[text[:n]] = max(longer.get(text[:n], 0), a)
    kept: dict[str, Term] = {}
    for term, (a, ratio) in sorted(good.items(), key=lambda x: (-x[1][0], len(x[0]), x[0])):
        stem, text = term.endswith("*"), term.rstrip("*")
        over = [text[:n] + "*" for n in STEM_LETTERS if n < len(text) or (not stem and n == len(text))]
        if any(o in kept for o in over):
            continue
        if stem and longer.get(text, 0) >= 0.9 * a:
            continue  # a longer stem or one word says as much
        kept[term] = Term(text, stem, ratio)
    highest = max((t.weight for t in kept.values()), default=1.0)
    for word in SEED_TERMS:
        kept.setdefault(word, Term(word, False, highest / 2))
    return [Term(t.text, t.stem, round(t.weight / highest, 6)) for _, t in sorted(kept.items())]


@dataclass
class Model:
    terms: list[Term]
    beta: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = [min((int(h.min()) for h in simhash.shingle_hashes(v.as_py() or "")), default=0) for v in batch.column(1)]
        yield batch.append_column("signature", pa.array(np.array(least, np.uint64).view(np.int64)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled rows that are not held out: SAMPLE_PER_LABEL rows of each label at most, those whose hashed ids are least.

    Labels that are null, and texts without a label, teach nothing; a document
    that has several labels teaches each. Of equal or nearly equal texts of one
    label one teaches. Without any labels the model is the prior over the seed
    terms.
    """
    usable = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    sample = usable.filter("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE_PER_LABEL).union(usable.filter("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE_PER_LABEL))
    drawn = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").select("toxic", "text")  # at most 2 * SAMPLE_PER_LABEL rows are broadcast
    # copies and most near copies share the least hash of their shingles: one of them teaches, or a copied text's words would look like a habit
    own = cluster.materialize(drawn.mapInArrow(_signed, "toxic int, text string, signature long").dropDuplicates(["toxic", "signature"]).select("toxic", "text"), "toxicity-sample")
    n = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[str] = Counter()
        other: Counter[str] = Counter()
        for batch in batches:
            for label_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                (toxic if label_ else other).update(_terms_of(value.as_py() or ""))
        terms = list(toxic)  # a term of no toxic text cannot be chosen, one of another task's counts there
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "a": pa.array([toxic[t] for t in terms], pa.int64())})

    # a term that no other text has needs so many toxic ones to be more than chance
    usual = n.get(1, 0) / max(1, n.get(1, 0) + n.get(0, 0))
    least = max(LEAST_TEXTS, math.ceil(LEAST_EVIDENCE / -math.log(usual))) if 0 < usual < 1 else LEAST_TEXTS
    # of each toxic sample row the terms; then how often those that may be chosen stand in the others
    likely = own.filter("toxic = 1").mapInArrow(count, "term string, a long").groupBy("term").agg(F.sum("a").alias("a")).filter(F.col("a") >= least).collect()  # bounded by the words of SAMPLE_PER_LABEL texts
    wanted = {r["term"]: r["a"] for r in likely}

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                held.update(t for t in _terms_of(value.as_py() or "") if t in wanted)
        terms = list(held)
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "b": pa.array([held[t] for t in terms], pa.int64())})

    others = {r["term"]: r["b"] for r in own.filter("toxic = 0").select("text").mapInArrow(elsewhere, "term string, b long").groupBy("term").agg(F.sum("b").alias("b")).collect()}
    terms = choose_terms([(t, a, others.get(t, 0)) for t, a in wanted.items()], n.get(1, 0), n.get(0, 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(LexiconAutomaton(terms))
        for batch in batches:
            rows = [features(v.as_py() or "", cache) for v in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(0), "x": pa.array(rows, pa.list_(pa.float64()))})

    seen = own.mapInArrow(measure, "toxic int, x array<double>").groupBy("toxic", "x").count().orderBy("toxic", "x").collect()  # bounded by the sample
    if not seen:
        return Model(terms, np.concatenate([[-2.0], PRIOR]))
    weight = {k: totals[k] / max(1, n.get(k, 0)) for k in totals}
    return Model(terms, fit(np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float), np.array([r["count"] * weight[r["toxic"]] for r in seen])))


def _scores(model: Model, texts: list[str], cache: _Cache) -> np.ndarray:
    x = np.array([features(t, cache) for t in texts]).reshape(len(texts), len(FEATURES))
    return 1 / (1 + np.exp(-np.clip(model.beta[0] + x @ model.beta[1:], -30, 30)))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row's whole text. A null text is empty; one without matches has the model's constant. Rows that repeat and null ids stay; an empty table gives no rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(LexiconAutomaton(model.terms))
        for batch in batches:
            for start, texts in columns.slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(start, len(texts)), "score": pa.array(_scores(model, texts, cache))})

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInArrow(work, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", most: float = 0.5) -> DataFrame:
    """The rows whose text scores below `most`, with all their columns, in their own order."""
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(LexiconAutomaton(model.terms))
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
            clean = [s < most for _, texts in columns.slices(own, "text") for s in _scores(model, texts, cache).tolist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
