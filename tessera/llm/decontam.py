"""Benchmark decontamination by latent semantic retrieval.

Passages of documents and benchmark items are TF-IDF vectors of hashed words, laid
into a latent space that a randomised SVD finds. Passages whose cosine with an item
is high are candidates; a longest common subsequence and the item's last words (its
answer) then decide, so paraphrases count and chance likeness does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import keyed, pick, shared, stored, table, taken
from tessera.llm.shingles import mixed, word_hashes

BITS = 18
SIZE = 1 << BITS
FOUND = "doc_id long, row_hash long, item_id long, cosine double, common double, answer double, first_word long, words int"


def buckets(w: np.ndarray) -> np.ndarray:
    return (w >> np.uint64(64 - BITS)).astype(np.int64)


def _frequencies(slots: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, n = np.zeros(SIZE, np.int64), 0
        for b in batches:
            held, many = [], 0
            for text in b.column(0):
                w = buckets(word_hashes((text.as_py() or "").encode("utf-8", "surrogatepass")))
                if len(w):
                    held.append((n + np.arange(len(w)) // size << BITS) + w)
                    n += -(-len(w) // size)
                    many += len(w)
                if many > 100_000:
                    np.add.at(total, np.unique(np.concatenate(held)) & SIZE - 1, 1)
                    held, many = [], 0
            if held:
                np.add.at(total, np.unique(np.concatenate(held)) & SIZE - 1, 1)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % slots], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "docs", "df"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(SIZE, np.int64), 0
    for b in batches:
        for n, blob in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            docs += n
            total += np.frombuffer(blob.as_py(), np.int64)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([docs], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "docs", "df"])


def inverse_frequencies(texts: DataFrame, slots: int = 16, size: int = 32) -> np.ndarray:
    """IDF over all texts' passages of `size` words (side by side), less 3 for rare words and always above 0: log(1 + (n + 1) / (df + 1) / e^3).
    Each task gives one vector of fixed size."""
    kind = "slot int, docs long, df binary"
    got = texts.mapInArrow(_frequencies(slots, size), kind).repartition(slots, "slot").mapInArrow(_summed, kind).repartition(1).mapInArrow(_summed, kind).first()
    n, df = (got.docs, np.frombuffer(got.df, np.int64)) if got else (0, np.zeros(SIZE))
    return np.log1p(np.exp(-3.0) * (n + 1) / (df + 1)).astype(np.float32)


def passages(w: np.ndarray, size: int) -> np.ndarray:
    """Starts of overlapping passages of `size` words; the last one ends with the text."""
    if len(w) <= size:
        return np.zeros(1 if len(w) else 0, np.int64)
    return np.append(np.arange(0, len(w) - size, size // 2), len(w) - size)


def _rows(b: np.ndarray, start: np.ndarray, size: int, idf: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sparse rows (indptr-like owner, column, value) of passages, with one more for a whole text of several if so told; and their number."""
    at = [b[s : s + size] for s in start.tolist()]
    if whole and len(at) > 1:
        at.append(b)
    owner = np.repeat(np.arange(len(at)), [len(x) for x in at])
    col = np.concatenate(at) if at else np.zeros(0, np.int64)
    return owner, col, idf[col], len(at)


def _times(owner, col, val, dense: np.ndarray, n: int) -> np.ndarray:
    """Rows of a sparse matrix times a dense one; rows without words are 0."""
    out = np.zeros((n, dense.shape[1]), np.float32)
    if len(owner):
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        out[owner[first]] = np.add.reduceat(val[:, None] * dense[col], np.flatnonzero(first), axis=0)
    return out


def _sketched(start, size: int, whole: bool):
    """The task's share of A'(A M): A has a row for each passage, and if so told for each whole text of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, m, slot = start.value
        total, some = np.zeros_like(m), False
        for b in batches:
            for text in b.column(0):
                w = slot[buckets(word_hashes((text.as_py() or "").encode("utf-8", "surrogatepass")))]
                begin = passages(w, size)
                if len(begin):
                    owner, col, val, n = _rows(w, begin, size, idf, whole)
                    y = _times(owner, col, val, m, n)
                    np.add.at(total, col, val[:, None] * y[owner])
                    some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for part in b.column(0):
            x = np.frombuffer(part.as_py(), np.float32)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])


def latent_basis(sample: DataFrame, idf: np.ndarray, size: int, rank: int, rounds: int = 2, slot: np.ndarray | None = None, whole: bool = False) -> np.ndarray:
    """The leading right singular vectors of the sample's passages (`whole`: and of its whole texts): subspace iteration from a random start.

    Each round every task adds up its share of A'(A M), and the sums are added in Spark."""
    spark = sample.sparkSession
    slot = np.arange(SIZE, dtype=np.int32) if slot is None else slot  # a bucket's row
    m = np.random.default_rng(11).standard_normal((len(idf), rank), dtype=np.float32)
    for _ in range(rounds):
        start = spark.sparkContext.broadcast((idf, m, slot))
        got = sample.mapInArrow(_sketched(start, size, whole), "part binary").repartition(1).mapInArrow(_joined, "part binary").first()
        start.unpersist()
        if got is None:
            break
        m = np.linalg.qr(np.frombuffer(got.part, np.float32).reshape(len(idf), rank))[0].astype(np.float32)
    return m


@dataclass
class Block:
    """Items in one latent space. likeness is the basis, with IDF in it, times the items' vectors there, so long that a whole copy's cosine is 1."""

    numbers: np.ndarray
    rows: np.ndarray  # a vocabulary word's row of likeness, or -1
    most: np.ndarray  # a vocabulary word's greatest likeness
    likeness: np.ndarray


@dataclass
class Index:
    """Items in latent spaces, in blocks."""

    items: list[int]
    words: list[np.ndarray]
    blocks: list[Block]
    verbatim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    size: int
    idf: np.ndarray
    slot: np.ndarray  # a bucket's place in the vocabulary of all items, or its length


def dealt(words: list[np.ndarray], numbers: list[int], size: int, most: int) -> Iterator[tuple[list[int], int]]:
    """Successive items that have at most `most` rows in a sketch together, and the number of rows; an item of more comes alone."""
    block, n = [], 0
    for i in numbers:
        own = len(passages(words[i], size))
        own += own > 1
        if block and n + own > most:
            yield block, n
            block, n = [], 0
        block.append(i)
        n += own
    if block:
        yield block, n


def surely(likeness: np.ndarray, energy: np.ndarray, least: float, top: float, size: int, cosine: float) -> bool:
    """If wherever a whole copy of an item stands, one of the passages there reaches the cosine, whatever the words around it.

    likeness, energy: the part of each of the item's words in product and squared length; no word has less than `least` and more than `top`.
    """
    n, step = len(likeness), size // 2
    c, e = (np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)]) for x in (likeness, energy))
    begin = np.arange(0, n + step, step)[None, :] - np.arange(step)[:, None]
    lo, hi = np.clip(begin, 0, n), np.clip(begin + size, 0, n)
    other = size - (hi - lo)
    reached = c[hi] - c[lo] + other * min(least, 0.0) >= (cosine + 1e-3) * np.sqrt(np.maximum(e[hi] - e[lo] + other * top, 1e-9))
    return bool((reached & (hi > lo)).any(1).all())


def common_subsequence(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray]:
    """Length of the longest common subsequence, and for each word of a if it is in one, by bit-parallel rows."""
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    mask, v, rows = (1 << len(a)) - 1, (1 << len(a)) - 1, []
    rows = [v]
    for w in b.tolist():
        u = v & where.get(w, 0)
        v = (v + u | v - u) & mask
        rows.append(v)
    used = np.zeros(len(a), bool)
    count = lambda row, i: (~row & (1 << i) - 1).bit_count()
    i, j = len(a), len(b)
    while i and j:
        if count(rows[j - 1], i) == count(rows[j], i):
            j -= 1
        elif count(rows[j], i - 1) == count(rows[j], i):
            i -= 1
        else:
            i, j = i - 1, j - 1
            used[i] = True
    return int(used.sum()), used


GRAM = 8


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    out = w[: max(0, len(w) - n + 1)].copy()
    for i in range(1, n):
        out = mixed(out * np.uint64(2 * n + 1)) + w[i : i + len(out)]
    return out


def verbatim(words: list[np.ndarray], numbers: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length (up to GRAM words), the sorted hashes of the items' first words, the items' numbers, and a table of 2^16 of hashes' lowest bits."""
    out = {}
    for n in sorted({min(GRAM, len(words[i])) for i in numbers}):
        own = [i for i in numbers if min(GRAM, len(words[i])) == n]
        h = np.concatenate([gram_hashes(words[i][:n], n) for i in own])
        order, seen = np.argsort(h, kind="stable"), np.zeros(1 << 16, bool)
        seen[h & np.uint64(0xFFFF)] = True
        out[n] = h[order], np.array(own)[order], seen
    return out


def _likeness(item: np.ndarray, passage: np.ndarray, idf: np.ndarray) -> float:
    """Cosine in the whole space, the passage's length taken as in the search."""
    a, n = np.unique(buckets(item), return_counts=True)
    b = buckets(passage)
    inside = b[np.isin(b, a)]
    x = n * idf[a]
    y = float((x[np.searchsorted(a, inside)] * idf[inside]).sum())
    return y / float(np.linalg.norm(x)) / float(np.sqrt(np.maximum((idf[b].astype(np.float64) ** 2).sum(), 1e-9)))


def _search(index, cosine: float, common: float, answer_words: int, answer: float):
    names, types = [x.split()[0] for x in FOUND.split(", ")], (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int32())

    def found(ix: Index, held: list[tuple[int, int, np.ndarray]]) -> list[tuple]:
        w = np.concatenate([x for _, _, x in held])
        edge = np.cumsum([0, *(len(x) for _, _, x in held)])
        starts = [passages(x, ix.size) for _, _, x in held]
        owner = np.repeat(np.arange(len(held)), [len(x) for x in starts])
        start = np.concatenate(starts) + edge[owner]
        stop = np.minimum(start + ix.size, edge[owner + 1])
        col = buckets(w)
        # words beside the items' lie outside the latent space: they count for a passage's length alone
        energy = np.concatenate([[0.0], np.cumsum(ix.idf[col].astype(np.float64) ** 2)])
        length = np.sqrt(np.maximum(energy[stop] - energy[start], 1e-9))
        col = ix.slot[col]
        best: list[dict[int, tuple]] = [{} for _ in held]
        for block in ix.blocks:
            # no item is more like a passage than the sum of its words' greatest likeness
            most = np.concatenate([[0.0], np.cumsum(block.most[col])])
            chosen = np.flatnonzero(most[stop] - most[start] >= cosine * length - 1e-6)
            for at in range(0, len(chosen), 1024):
                some = chosen[at : at + 1024]
                n = stop[some] - start[some]
                mine = np.repeat(np.arange(len(some)), n)
                row = block.rows[col[np.arange(len(mine)) + np.repeat(start[some] - np.cumsum(n) + n, n)]]
                inside = row >= 0
                sims = _times(mine[inside], row[inside], np.ones(inside.sum(), np.float32), block.likeness, len(some)) / length[some, None]
                for i, c in zip(*np.nonzero(sims >= cosine), strict=True):
                    k, which = int(block.numbers[c]), int(owner[some[i]])
                    known, text, s = best[which], held[which][2], int(start[some[i]] - edge[which])
                    if k in known and known[k][1] >= 0.95:
                        continue
                    item = ix.words[k]
                    near = text[max(0, s - len(item)) : s + ix.size + len(item)]
                    if 2 * np.isin(item, near).sum() < common * len(item):
                        continue
                    m, used = common_subsequence(item, near)
                    share, tail = m / len(item), float(used[-answer_words:].mean())
                    if share >= common and tail >= answer and (k not in known or share > known[k][1]):
                        known[k] = (min(1.0, float(sims[i, c])), share, tail, s)
        # the exact way for items of frequent words, which alone do not reach the cosine beside rare ones
        for n, (hashes, numbers, seen) in ix.verbatim.items():
            grams = gram_hashes(w, n)
            at = np.flatnonzero(seen[grams & np.uint64(0xFFFF)])
            lo, hi = np.searchsorted(hashes, grams[at]), np.searchsorted(hashes, grams[at], "right")
            for s, i, j in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                which = int(np.searchsorted(edge, s, "right")) - 1
                for k in numbers[i:j].tolist():
                    item = ix.words[k]
                    if best[which].get(k, (0, 0))[1] < 1 and s + len(item) <= edge[which + 1] and np.array_equal(w[s : s + len(item)], item):
                        p = s - edge[which]
                        begin = max(0, min(p, len(held[which][2]) - ix.size))
                        best[which][k] = (_likeness(item, held[which][2][begin : begin + ix.size], ix.idf), 1.0, 1.0, int(begin))
        return [(d, h, ix.items[k], *v, len(x)) for (d, h, x), known in zip(held, best, strict=True) for k, v in known.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = taken(index)
        for b in batches:
            out, held, n = [], [], 0
            for d, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                w = word_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"))
                if len(w):
                    held.append((d, h, w))
                    n += len(w)
                if n > 100_000:
                    out += found(ix, held)
                    held, n = [], 0
            if held:
                out += found(ix, held)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", rank: int = 256, size: int = 32, cosine: float = 0.17, common: float = 0.5, answer_words: int = 8, answer: float = 0.25, most_items: int = 200_000, held: float = 0.5) -> DataFrame:
    """(doc_id, row_hash, item_id, cosine, common, answer, first_word, words) of documents that hold an item.

    A document holds an item if one of its passages has a cosine of at least
    `cosine` with it, a longest common subsequence of at least `common` of its words, and
    at least `answer` of its last `answer_words` words in that; or if it holds all the item's
    words in a row, whatever their weights and number (an item of one word is held wherever that
    word stands). IDF counts all documents' passages; items are dealt into blocks of at most `2 * rank` passages, each with the `rank`
    leading directions of these. Items of which a block's space holds less than `held` of their squared length, or in which a whole copy
    might stay under the cosine, go into further blocks of at most `rank` passages, which their directions span. Every passage of every document
    is searched against every block, its length taken in the whole space. Only items of such frequent words that the cosine can't promise whole copies in any
    space are looked for word by word as well. Blocks go to every task, about 64 MB of them at a time, and each
    such part reads the documents again; so does each part of `most_items` items, into which larger benchmarks are dealt. Null and empty texts and items
    hold nothing, and long texts are searched a few at a time. Repeated rows each count; items of equal texts are each found. An empty table gives no rows,
    and other columns are not read.
    """
    src = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), "text")
    items = pick(benchmark, item_col, "text").toDF("item", "text").where("item is not null and text is not null")
    parts = 1 + items.count() // most_items
    if parts == 1:
        return _leaks(src, items, rank, size, cosine, common, answer_words, answer, held)
    shares = [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i) for i in range(parts)]
    return reduce(DataFrame.unionByName, [_leaks(src, part, rank, size, cosine, common, answer_words, answer, held) for part in shares])


def _leaks(src: DataFrame, items: DataFrame, rank: int, size: int, cosine: float, common: float, answer_words: int, answer: float, held: float) -> DataFrame:
    spark = src.sparkSession
    items = items.orderBy("item", "text").collect()  # about most_items
    words = [word_hashes(r.text.encode("utf-8", "surrogatepass")) for r in items]
    kept = [i for i, w in enumerate(words) if len(w)]
    if not kept:
        return src.select("doc_id", "row_hash").limit(0).selectExpr("doc_id", "row_hash", "0L item_id", "0d cosine", "0d common", "0d answer", "0L first_word", "0 words")
    idf = inverse_frequencies(src.select("text"), size=size)
    names, words, texts = [items[i].item for i in kept], [words[i] for i in kept], [items[i].text for i in kept]
    vocabulary = np.unique(buckets(np.concatenate(words)))
    slot = np.full(SIZE, len(vocabulary), np.int32)
    slot[vocabulary] = np.arange(len(vocabulary))
    energy, top = idf.astype(np.float64) ** 2, float(idf.max()) ** 2
    full, weak = np.zeros(len(words)), set()
    for i, w in enumerate(words):
        _, at, n = np.unique(buckets(w), return_inverse=True, return_counts=True)
        full[i] = np.sqrt((n[at] * energy[buckets(w)]).sum())
        if not surely(n[at] * energy[buckets(w)] / full[i], energy[buckets(w)], 0.0, top, size, cosine):
            weak.add(i)

    def latent(numbers: list[int], directions: int, n_rows: int) -> tuple[list[Block], list[int]]:
        """The items' block in a space of so many directions, and those of them that it does not hold: none if it spans all rows."""
        own = np.unique(buckets(np.concatenate([words[i] for i in numbers])))
        at = np.full(SIZE, -1, np.int32)
        at[own] = np.arange(len(own))
        fitted = spark.createDataFrame([(texts[i],) for i in numbers], "text string").coalesce(1)
        basis = latent_basis(fitted, idf[own], size, min(directions, len(own)), slot=at, whole=True) * idf[own, None]
        columns = [at[buckets(words[i])] for i in numbers]
        vectors = np.stack([basis[x].sum(0) for x in columns])
        length = np.linalg.norm(vectors, axis=1)
        scale = full[numbers] / np.maximum(length**2, held * full[numbers] ** 2)  # a whole copy by itself has 1
        likeness = (basis @ (vectors * scale[:, None]).T).astype(np.float32)
        good = np.ones(len(numbers), bool)
        if directions < n_rows:
            for c, (i, x) in enumerate(zip(numbers, columns, strict=True)):
                good[c] = length[c] ** 2 >= held * full[i] ** 2 and (i in weak or surely(likeness[x, c], energy[own[x]], float(likeness[:, c].min()), top, size, cosine))
        lost = np.array(numbers)[~good].tolist()
        if not good.any():
            return [], lost
        likeness = np.ascontiguousarray(likeness[:, good])
        rows, most = np.full(len(vocabulary) + 1, -1, np.int32), np.zeros(len(vocabulary) + 1, np.float32)
        rows[slot[own]], most[slot[own]] = np.arange(len(own)), likeness.max(1)
        return [Block(np.array(numbers)[good], rows, most, likeness)], lost

    parts, blocks, size_of, lost = [], [], 0, []

    def search() -> None:
        exact = verbatim(words, [i for block in blocks for i in block.numbers.tolist() if i in weak])
        index = shared(spark, Index(names, words, blocks, exact, size, idf, slot))
        parts.append(src.mapInArrow(_search(index, cosine, common, answer_words, answer), FOUND))

    for spans in (False, True):
        todo, lost = lost if spans else list(range(len(words))), []
        for numbers, n in dealt(words, todo, size, rank if spans else 2 * rank):
            got, more = latent(numbers, n if spans else min(n, max(rank, n // 2)), n)
            blocks += got
            size_of += sum(b.likeness.nbytes + b.rows.nbytes + b.most.nbytes for b in got)
            lost += more
            if size_of > 1 << 26:
                search()
                blocks, size_of = [], 0
    if blocks:
        search()
    return reduce(DataFrame.unionByName, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that hold an item; a row is known by its id and text, so repeated rows stay or go together.

    Rows with null texts stay. Columns may have any names; an empty table stays empty, and without items all rows stay.
    """
    own, _, text = keyed(docs, id_col, text_col)
    own = own.withColumn("row_hash", F.xxhash64(text))
    found = leaks(own.select(F.col("row_id").alias("doc_id"), F.col(text).alias("text")), benchmark, **options)
    bad = stored(found.select(F.col("doc_id").alias("bad_id"), F.col("row_hash").alias("bad_hash")).distinct())
    left = own.join(bad, own["row_id"].eqNullSafe(bad["bad_id"]) & (own["row_hash"] == bad["bad_hash"]), "left_anti")
    return left.drop("row_id", "row_hash").toDF(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leaks() of the benchmark in all documents."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("common", 4).alias("lcs_share"), F.round("answer", 4).alias("answer_share"), "first_word")
