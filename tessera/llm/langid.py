"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams weighted by TF-IDF. Weights are trained by
follow-the-regularised-leader with elastic-net penalties, in shards whose weights
are averaged; a temperature then calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, pick, shared, table, taken

BITS = 16
SIZE = 1 << BITS
#: A text's weights sum to this, so that a gram's share of it is of the order of one.
SCALE = 100.0
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
#: Characters of text that are held as numbers at once.
BLOCK = 1 << 20
_STATE: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _STATE:
        # no letters lie beyond plane 3
        _STATE["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x40000)), bool, 0x40000)
    return _STATE["letters"]


def grams(text: str) -> tuple[np.ndarray, bool]:
    """Buckets of the text's 1-, 2- and 3-grams, and if it has a letter. Case is ignored, and runs of other characters than letters count as a space each."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = _letters()
    is_letter = letters[np.minimum(c, len(letters) - 1)]
    if not is_letter.any():
        return np.zeros(0, np.int64), False
    x = np.where(is_letter, c, 32).astype(np.uint32)
    x = np.concatenate([[32], x[np.concatenate([[True], is_letter[1:] | is_letter[:-1]])], [32]]).astype(np.uint32)
    m1, m2, m3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
    one = x * m1
    two = one[:-1] * m2 + one[1:]
    three = two[:-1] * m3 + one[2:]
    return np.concatenate([(h ^ h >> np.uint32(15)) * m2 >> np.uint32(32 - BITS) for h in (one[1:-1], two, three)]).astype(np.int64), True


def _blocks(text: str) -> Iterator[str]:
    """The text in parts of about BLOCK characters, so that little is held at once; a part ends at a space if there is one in its second half."""
    at = 0
    while at == 0 or at < len(text):
        end = at + BLOCK
        cut = text.rfind(" ", at + BLOCK // 2, end) if end < len(text) else -1
        yield text[at : cut if cut > 0 else end]
        at = cut + 1 if cut > 0 else end


def counted(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Distinct buckets, how often each occurs, and if there is a letter."""
    total, any_letter = None, False
    for part in _blocks(text):
        g, letter = grams(part)
        any_letter |= letter
        if len(g):
            n = np.bincount(g, minlength=SIZE)
            total = n if total is None else total + n
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), any_letter
    at = np.flatnonzero(total)
    return at, total[at], any_letter


def _frequencies(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, docs, seen = np.zeros(SIZE, np.int64), 0, np.zeros(SIZE, bool)
        for b in batches:
            for text in b.column(0):
                seen[:] = False
                for part in _blocks(text.as_py() or ""):
                    seen[grams(part)[0]] = True
                total += seen
                docs += 1
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % slots], pa.int32()), pa.array([docs], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "docs", "df"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(SIZE, np.int64), 0
    for b in batches:
        for n, blob in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            docs += n
            total += np.frombuffer(blob.as_py(), np.int64)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([docs], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "docs", "df"])


def inverse_frequencies(texts: DataFrame, slots: int = 32) -> np.ndarray:
    """IDF of each bucket over all rows; the counts are summed in two steps, a fixed-size vector from each task."""
    kind = "slot int, docs long, df binary"
    got = texts.mapInArrow(_frequencies(slots), kind).repartition(slots, "slot").mapInArrow(_summed, kind).repartition(1).mapInArrow(_summed, kind).first()
    n, df = (got.docs, np.frombuffer(got.df, np.int64)) if got else (0, np.zeros(SIZE))
    return np.log((n + 1) / (df + 1)).astype(np.float64) + 1.0


@dataclass
class Ftrl:
    """FTRL-proximal for multinomial logistic loss with L1 and L2 penalties."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.01

    def __post_init__(self):
        self.z = np.zeros((SIZE + 1, self.classes))
        self.n = np.zeros((SIZE + 1, self.classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, SIZE), np.append(x, 1.0)  # the last is the bias
        w = self.weights(at)
        p = x @ w
        p = np.exp(p - p.max())
        p /= p.sum()
        p[y] -= 1
        g = x[:, None] * p
        g2 = g * g
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g2) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g2


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n, _ = counted(text)
    x = n * idf[at]
    return at, SCALE * x / x.sum() if len(x) else x


def _trained(idf: np.ndarray, classes: list[str], epochs: int):
    number = {c: i for i, c in enumerate(classes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(*weighted(t, idf), number[lang]) for b in batches for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rows = [(a.astype(np.int32), x.astype(np.float32), y) for a, x, y in rows if len(a)]
        if not rows:
            return
        model, order = Ftrl(len(classes)), np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                model.learn(*rows[i])
        w = model.weights(slice(None)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["n", "w"])

    return run


def _logits(text: str, gain: np.ndarray, bias: np.ndarray) -> np.ndarray | None:
    total = None
    for part in _blocks(text):
        g, _ = grams(part)
        if len(g):
            s = np.bincount(g, minlength=SIZE) @ gain if len(g) > 20_000 else gain[g].sum(0, dtype=np.float64)
            total = s if total is None else total + s
    return None if total is None else SCALE * total[:-1] / total[-1] + bias


@dataclass
class Model:
    """gain: a bucket's IDF times its weight in each class, and last its IDF."""

    classes: list[str]
    gain: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        z = _logits(text, self.gain, self.bias) if text and self.classes else None
        if z is None:
            return "und", 0.0
        p = np.exp((z - z.max()) / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(p[k] / p.sum())


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits z that gives labels y the least log loss."""
    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    return float(min(np.geomspace(0.1, 10, 81), key=loss)) if len(y) else 1.0


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 1500, shards: int = 8, epochs: int = 3) -> Model:
    """A model of the languages in docs. IDF is over all rows; weights are trained on about `per_language` rows of each language, chosen by a hash of their ids, of which a fifth calibrates. Rows with null text or language teach nothing; without any the model predicts `und`. Other columns are not read."""
    src = pick(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in src.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    classes = sorted(counts)
    idf = inverse_frequencies(src.select("text"))
    empty = np.zeros((SIZE, 1))
    if not classes:
        return Model([], empty, np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(v) for c in classes for v in (c, min(1.0, per_language / counts[c]))]), F.col("lang"))
    roll = F.xxhash64(F.lit("sample"), "doc_id")
    sample = src.where(F.pmod(roll, F.lit(1 << 30)) < share * (1 << 30)).withColumn("calibrate", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)) == 0)
    parts = sample.where(~F.col("calibrate")).repartition(shards, F.xxhash64("doc_id")).select("text", "lang").mapInArrow(_trained(idf, classes, epochs), "n long, w binary").collect()
    if not parts:
        return Model(classes, np.hstack([np.zeros((SIZE, len(classes))), idf[:, None]]).astype(np.float32), np.zeros(len(classes)))
    w = sum(p.n * np.frombuffer(p.w, np.float32).reshape(SIZE + 1, -1) for p in parts) / sum(p.n for p in parts)
    model = Model(classes, np.hstack([idf[:, None] * w[:-1], idf[:, None]]).astype(np.float32), w[-1])
    held = sample.where("calibrate").select("text", "lang").mapInArrow(_scored(model), "lang string, z array<double>").collect()
    if held:
        model.temperature = temperature(np.array([r.z for r in held]), np.array([classes.index(r.lang) for r in held]))
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lang, z.tolist()) for t, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True) if (z := _logits(t.as_py(), model.gain, model.bias)) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["lang", "z"])

    return run


def _predicted(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = taken(held)
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs, its whole text scored, long ones in parts. Null texts and those without a letter: `und` with score 0.
    Ties go to the language that comes first in order; an empty table gives no rows, and repeated rows each have one.

    The model is broadcast; its size is fixed by SIZE and the number of languages.
    Rows with equal texts get equal predictions; other columns are not read.
    """
    held = shared(docs.sparkSession, model)
    src = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return src.mapInArrow(_predicted(held), PREDICTED)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predicted() of all documents by a model of those outside the held-out part."""
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, fit(docs.where(~held_out("doc_id"))))
