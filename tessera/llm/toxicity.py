"""Toxicity by a learned lexicon, matched in spite of misspellings.

Terms (words, and word beginnings for languages that inflect) are learned from
labelled documents. Levenshtein automata of the terms are intersected with their
trie: the states of the product are made as texts need them and kept, so that most
words leave it after a few letters. Windows around each match tell quotation from
abuse, and a logistic regression on what is left gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, pick, shared, table, taken

WORD = re.compile(r"[^\W_]+", re.UNICODE)
#: Length of a beginning that may be a term.
STEM = range(4, 9)
#: What opens a quotation or a report, and what addresses the reader, within a window.
REPORT = frozenset("said says say wrote called quoted quote word term sagte schrieb nannte wort dijo escribió llamó palabra dit écrit appelé mot".split())
ADDRESS = frozenset("you your youre u du dich dein ihr euch tú tu usted te vous toi votre".split())
QUOTES = "\"“”„«»"
#: Single marks count where no apostrophe stands: before a word and after one.
OPENS, CLOSES = re.compile(r"(?<!\w)['‘’‚](?=\w)"), re.compile(r"(?<=\w)['’‘](?!\w)")
SCORED = "doc_id long, held_out boolean, score double, predicted int"
FEATURES = 6


@dataclass
class Lexicon:
    """Terms with their log odds. A term ending in * stands for all words that begin so."""

    terms: dict[str, float]
    edits: int = 1
    #: Terms shorter than this must match exactly.
    least: int = 5
    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, tuple[str, bool]] = field(default_factory=dict)
    states: dict[frozenset, int] = field(default_factory=dict)
    steps: list[dict[str, int]] = field(default_factory=list)
    sets: list[frozenset] = field(default_factory=list)
    #: The states are made anew beyond this many, so memory is bounded.
    most: int = 200_000

    def __post_init__(self):
        for term in self.terms:
            node = 0
            for c in term.removesuffix("*"):
                node = self.nodes[node].setdefault(c, len(self.nodes)) if c in self.nodes[node] else self._grow(node, c)
            self.ends[node] = (term, term.endswith("*"))
        self._start()

    def _grow(self, node: int, c: str) -> int:
        self.nodes.append({})
        self.nodes[node][c] = len(self.nodes) - 1
        return len(self.nodes) - 1

    def _start(self) -> None:
        self.states, self.steps, self.sets = {}, [], []
        self._state(frozenset())  # 0: nothing can match any more
        self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set) -> frozenset:
        """With what deleting letters of terms leads to; for each trie node only the fewest edits."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            if e < self.edits:
                todo += [(n, e + 1) for n in self.nodes[node].values()]
        return frozenset(best.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.steps.append({})
        return self.states[pairs]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if node in self.ends and self.ends[node][1]:
                out.add((node, e))  # a beginning goes on with any letter
            for label, n in self.nodes[node].items():
                if label == c:
                    out.add((n, e))
                elif e < self.edits:
                    out.add((n, e + 1))
            if e < self.edits:
                out.add((node, e + 1))
        to = self._state(self._closed(out) if out else frozenset())
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest edits from word (ties: greater odds), and how many."""
        if len(self.sets) > self.most:
            self._start()
        state, steps = 1, self.steps
        for c in word:
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if not state:
                return None
        found = [(e, -self.terms[self.ends[n][0]], self.ends[n][0]) for n, e in self.sets[state] if n in self.ends and (not e or len(self.ends[n][0]) >= self.least and not self.ends[n][1])]
        return (min(found)[2], min(found)[0]) if found else None


def features(text: str, lexicon: Lexicon, window: int = 6) -> list[float]:
    """1, best odds of an exact match, number of exact matches (log), best odds of a misspelled one, odds lost to quotation, odds addressed to someone."""
    low = text.lower()
    exact = fuzzy = quoted = addressed = 0.0
    n = 0
    if lexicon.terms:
        match, known = lexicon.match, {}
        for m in WORD.finditer(low):
            word = m.group()
            if word in known:
                got = known[word]
            else:
                got = known[word] = match(word)
            if got is None:
                continue
            odds = lexicon.terms[got[0]]
            before, after = low[max(0, m.start() - 12 * window) : m.start()], low[m.end() : m.end() + 12 * window]
            near = set(WORD.findall(before)[-window:] + WORD.findall(after)[:window])
            within = any(q in before[-24:] for q in QUOTES) and any(q in after[:24] for q in QUOTES) or bool(OPENS.search(low, max(0, m.start() - 24), m.start() + 1) and CLOSES.search(low, m.end() - 1, m.end() + 24))
            if within and near & REPORT:
                quoted = max(quoted, odds)
                continue
            if near & ADDRESS:
                addressed = max(addressed, odds)
            if got[1]:
                fuzzy = max(fuzzy, odds)
            else:
                exact, n = max(exact, odds), n + 1
    return [1.0, exact, math.log1p(n), fuzzy, quoted, addressed]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        terms, labels = [], []
        for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            words = set(WORD.findall((text.as_py() or "").lower()))
            own = {w for w in words if len(w) >= 3} | {w[:k] + "*" for w in words for k in STEM if k < len(w)}
            terms += own
            labels += [toxic] * len(own)
        if terms:
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(labels, pa.int32())], names=["term", "toxic"])


def _vectors(lexicon_terms: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(lexicon_terms)
        for b in batches:
            x = [features(t.as_py() or "", lexicon) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.full(len(w), l2)
        penalty[0] = 1e-6
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    terms: dict[str, float]
    weights: list[float]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 24_000, most_terms: int = 2000) -> Model:
    """Lexicon and weights from at most `most_rows` labelled documents, those whose ids hash lowest.

    A term must tell the labels apart beyond what as many terms would by chance
    (a likelihood ratio of 2 ln(terms) + 8). Without labels of both kinds the
    lexicon is empty and the score the smoothed share of toxic labels. The lexicon holds the `most_terms` strongest terms
    that pass. Null texts count as empty; rows of an id that labels contradict count as toxic; other columns are not read.
    """
    marks = pick(labels, id_col, "toxic").toDF("id", "toxic").where("id is not null and toxic is not null").select("id", F.col("toxic").cast("int").alias("toxic")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    sample = pick(docs, id_col, text_col).toDF("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("id")).select("text", "toxic")
    totals = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, all_ = totals.get(1, 0), sum(totals.values())
    prior = [math.log((bad + 0.5) / (all_ - bad + 9.5)), *[0.0] * (FEATURES - 1)]
    if not bad or bad == all_:
        return Model({}, prior)
    counts = sample.mapInArrow(_terms, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    base = bad / all_
    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    ratio = 2 * (part(a, n * base) + part(n - a, n * (1 - base)))
    # what falls short of the least ratio is dropped before the count of terms is known
    strong = counts.where((a > n * base * 2) & (ratio > 20)).select("term", "a", "n", ratio.alias("ratio")).orderBy(F.desc("ratio"), "term").limit(20 * most_terms).collect()
    bound = 2 * math.log(200.0 * all_) + 8
    odds = lambda r: math.log((r.a + 0.5) / (bad + 1)) - math.log((r.n - r.a + 0.5) / (all_ - bad + 1))
    terms: dict[str, float] = {}
    found: dict[str, int] = {}
    for r in sorted((r for r in strong if r.ratio > bound and odds(r) > 1), key=lambda r: (-r.ratio, r.term.endswith("*"), -len(r.term), r.term)):
        stem = r.term.removesuffix("*")
        covered = any(t.endswith("*") and stem.startswith(t[:-1]) for t in terms)
        # a beginning that adds little to the longer terms found before it is too wide
        wide = r.term.endswith("*") and any(t.startswith(stem) and found[t] >= 0.8 * r.a for t in terms)
        # a whole word stays although a beginning covers it: its misspellings are caught by it alone
        if (not covered or not r.term.endswith("*")) and not wide and len(terms) < most_terms:
            terms[r.term], found[r.term] = odds(r), r.a
    rows = sample.mapInArrow(_vectors(terms), "x array<double>, toxic int").collect()  # at most most_rows of 6 numbers
    x, y = np.array([r.x for r in rows]), np.array([float(r.toxic) for r in rows])
    return Model(terms, logistic(x, y).tolist() if len(rows) else prior)


def _scores(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = taken(held)
        lexicon, w = Lexicon(model.terms), model.weights
        for b in batches:
            z = [sum(p * q for p, q in zip(features(t.as_py() or "", lexicon), w, strict=True)) for t in b.column(b.num_columns - 1)]
            score = [1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= 0.3) for s in score], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs with the score of its whole text; null and empty texts get that of no match, and null ids stay.

    An empty table gives no rows; repeated rows each have one; long texts are read whole, word by word. The model is broadcast; `most_terms` bounds it. Equal texts get equal scores. Other columns are not read.
    """
    held = shared(docs.sparkSession, model)
    src = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return src.mapInArrow(_scores(held), SCORED)


def accepted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without those that score at least `threshold`; columns of any names stay as they are, repeated rows stay or go together,
    and null and empty texts are judged as texts without a match."""
    held, names = shared(docs.sparkSession, model), docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = taken(held)
        lexicon, w = Lexicon(own.terms), own.weights
        bar = math.log(threshold / (1 - threshold))
        for b in batches:
            z = [sum(p * q for p, q in zip(features(t.as_py() or "", lexicon), w, strict=True)) for t in b.column(at)]
            yield b.filter(pa.array([v < bar for v in z], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() of all documents by a model of the labels outside the held-out part."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return scored(docs, fit(docs, labels.where(~held_out("doc_id"))))
