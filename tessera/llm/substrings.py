"""Removal of long repeated byte strings by a distributed sparse suffix array.

A string of `length` bytes that occurs twice has the same anchor in both places:
the place of the least hash among the `gram`-byte strings within it. So suffixes are
sorted from anchors alone, each with the bytes around it that windows with this
anchor cover. Anchors whose surroundings can't repeat are dropped first, by counts of
their hashes. The rest are range-partitioned at sampled splitters by the bytes that
lead from the anchor, so equal leads meet in one bucket and suffixes on both sides of a
border differ within their leads. Each bucket sorts a lead's suffixes, and what stands before
them, by multikey quicksort; what neighbours in these two orders have in common tells which windows
repeat. A lead that more suffixes have than a task should hold is not sorted at once: its suffixes are compared
with one of them, and those that leave it at the same byte make new, smaller groups.

The same is done with texts as sequences of words, each its 64-bit hash, for passages of `words` words that stand in more than one document: of
windows that a document has more than once only the first is taken, so that any two that are equal belong to two documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, pick, stored, table
from tessera.llm.shingles import mixed, powers, prefix_hashes, texts_of, words_of

#: Of an anchor and in the lead of a suffix: bytes, and words.
GRAM, WORDS_GRAM = 128, 8
#: Bytes of a word's hash.
WIDTH = 8
_SALT = np.uint64(0xD6E8FEB86659FD93)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size` units, from prefix hashes h."""
    n = max(0, len(h) - size)
    _, down = powers(n + 1)
    return mixed((h[size:] - h[:n]) * down[:n] + np.uint64(size))


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """The place of the least value (ties: the rightmost) in each run of w, by block minima from both sides. Values leave as many
    of the highest bits free as a place within a block needs, w - 1 at most."""
    n, bits = len(x), (w - 1).bit_length()
    shift = np.uint64(bits)
    y = np.full(n + -n % w, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x << shift
    v = y.reshape(-1, w)
    v |= np.arange(w - 1, -1, -1, dtype=np.uint64)
    left = np.minimum.accumulate(v, axis=1).ravel()[w - 1 : n]
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()[: n - w + 1]
    later = left >> shift <= right >> shift
    s = np.arange(n - w + 1)
    back = (np.where(later, left, right) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.where(later, s + w - 1, s) // w * w + (w - 1 - back)


def first_windows(h: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For the windows at 0, 1 and so on, which belong to the texts `owner`: whether its text has none like it before."""
    x = mixed(window_hashes(h, length) ^ mixed(owner.astype(np.uint64) + _SALT))
    first = np.zeros(len(x), bool)
    first[np.unique(x, return_index=True)[1]] = True
    return first


def anchors(h: np.ndarray, at: np.ndarray, length: int, gram: int, once: bool = False) -> tuple[np.ndarray, ...]:
    """Of texts [at[i], at[i + 1]) with prefix hashes h, for each anchor its place, the first and last start of the windows that it belongs to,
    and its text's number. once: without windows that the text has before; what these leave of an anchor's windows may be several rows."""
    none = np.zeros(0, np.int64)
    if len(h) - 1 < length:
        return none, none, none, none
    run = length - gram + 1
    a = sliding_argmin(mixed(window_hashes(h, gram) ^ _SALT) >> np.uint64((run - 1).bit_length()), run)
    # windows that lie within a text
    owner, stop = (np.repeat(x, np.diff(at))[: len(a)] for x in (np.arange(len(at) - 1), at[1:]))
    taken = np.arange(length, len(a) + length) <= stop
    if once:
        taken &= first_windows(h, owner, length)
    new = (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(taken & np.concatenate([[True], new | ~taken[:-1]]))
    last = np.flatnonzero(taken & np.concatenate([new | ~taken[1:], [True]]))
    return a[first], first, last, owner[first]


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of texts raw[at[i]:at[i + 1]], where each text's begin (and the last's end), and prefix hashes."""
    w, cut = words_of(raw, at, lower=False)
    up, _ = powers(len(w) + 1)
    return w, cut, np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)], dtype=np.uint64)])


def _around(h, a, lo, hi, length, gram):
    """Hashes of the bytes that windows of each anchor have in common: on the left or on the right half at least, and of all that they cover."""
    half = (length - gram) // 2
    up = len(h) - 1
    stop_l, start_l = a + gram, np.maximum(a - half, 0)
    start_r, stop_r = a, np.minimum(a + gram + half, up)
    _, down = powers(up + 1)
    left = mixed((h[stop_l] - h[start_l]) * down[start_l] + np.uint64(1))
    right = mixed((h[stop_r] - h[start_r]) * down[start_r] + np.uint64(2))
    whole = mixed((h[hi + length] - h[lo]) * down[lo] + ((hi + length - lo) << 12 | (a - lo)).astype(np.uint64))
    # a window that begins at most `half` before the anchor reaches `half` beyond its gram; others hold the left half
    none = np.uint64(0)
    return np.where(lo <= a - half, left, none), np.where(hi >= a + gram + half - length, right, none), whole


def _anchored(length: int, gram: int, width: int, piece: int = 1 << 20):
    names = ["node", "lo", "hi", "at", "l", "r", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = texts_of(b.column(1))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + piece, "right")) - 1)
                part, begin = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                if width == 1:
                    h = prefix_hashes(part)
                else:
                    _, begin, h = _words(part, begin)
                a, lo, hi, owner = anchors(h, begin, length, gram, once=width > 1)
                if len(a):
                    sides = [x.view(np.int64) for x in _around(h, a, lo, hi, length, gram)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i).take(pa.array(owner)), *[pa.array((x - begin[owner]).astype(np.int32)) for x in (lo, hi, a)], *map(pa.array, sides)], names=names)
                i = j

    return run


def _contexts(length: int, gram: int, width: int):
    names = ["node", "lo", "hi", "at", "key", "around"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, text, spots in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                if width > 1:
                    raw = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=False)[0].tobytes()
                rows = [(s["lo"], s["hi"], s["at"], raw[s["at"] * width : (s["at"] + gram) * width], raw[s["lo"] * width : (s["hi"] + length) * width]) for s in spots]
                lo, hi, at, lead, around = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()] * len(rows), pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(at, pa.int32()), pa.array(lead, pa.binary()), pa.array(around, pa.binary())], names=names)

    return run


def multikey_quicksort(keys: list[bytes]) -> list[int]:
    """The order of byte strings: three-way partitions by one eight-byte symbol at a time."""
    order, todo = list(range(len(keys))), [(0, len(keys), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2:
            continue
        part = order[lo:hi]
        symbol = {i: keys[i][depth : depth + 8] for i in part}
        pivot = symbol[part[len(part) // 2]]
        less = [i for i in part if symbol[i] < pivot]
        same = [i for i in part if symbol[i] == pivot]
        more = [i for i in part if symbol[i] > pivot]
        order[lo:hi] = less + same + more
        todo += [(lo, lo + len(less), depth), (hi - len(more), hi, depth)]
        if len(pivot) == 8:
            todo.append((lo + len(less), hi - len(more), depth + 8))
    return order


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def _neighbours(keys: list[bytes]) -> tuple[list[int], np.ndarray]:
    """The order of the keys, and what each has in common with the next."""
    order = multikey_quicksort(keys)
    return order, np.array([common_prefix(keys[i], keys[j]) for i, j in zip(order, order[1:], strict=False)], np.int64)


def repeated_windows(ahead: list[bytes], behind: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(i, from, to): the windows of suffix i that begin `from` to `to` bytes before it and that another suffix has as well.

    ahead: suffixes; behind: what stands before each, read backwards. Two have the window that begins u bytes before in common if
    they agree in u bytes behind and length - u ahead. In sorted order those that agree in d bytes are the runs in which no two
    neighbours have less than d in common.
    """
    n = len(ahead)
    if n == 2:
        low, high = length - common_prefix(*ahead), common_prefix(*behind)
        if low <= high:
            yield 0, low, high
            yield 1, low, high
        return
    (forth, right), (back, left) = _neighbours(ahead), _neighbours(behind)
    # between two of these numbers of bytes the runs stay the same
    cuts = np.unique(np.concatenate([length - right, left + 1]))
    cuts = cuts[(cuts >= 0) & (cuts <= length)]
    spot, place = np.empty((2, n), np.int64)
    spot[forth], place[back] = np.arange(n), np.arange(n)
    cuts = np.append(cuts, length + 1)
    twice = np.zeros((len(cuts), n), bool)
    for k, u in enumerate(cuts[:-1].tolist()):
        agree = np.concatenate([[0], np.cumsum(right < length - u)])[spot] * n + np.concatenate([[0], np.cumsum(left < u)])[place]
        order = np.argsort(agree, kind="stable")
        same = agree[order][1:] == agree[order][:-1]
        twice[k, order[1:][same]] = True
        twice[k, order[:-1][same]] = True
    edge = np.diff(twice.astype(np.int8), axis=0, prepend=0)
    for i in np.flatnonzero(twice.any(0)).tolist():
        for a, b in zip(np.flatnonzero(edge[:, i] > 0).tolist(), np.flatnonzero(edge[:, i] < 0).tolist(), strict=True):
            yield i, int(cuts[a]), int(cuts[b]) - 1


RUNS, CONTEXT = "node binary, first int, last int", "node binary, lo int, hi int, at int, key binary, around binary"
_RUN_TYPES = (pa.binary(), pa.int32(), pa.int32())


def _batch(rows: list[tuple], names: list[str], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _settled(length: int, width: int):
    """Rows (node, first, last: starts of repeated windows) of groups with equal keys, which come together. Places count units of `width` bytes."""
    names = ["node", "first", "last"]

    def settle(group):
        if len(group) > 1:
            ahead, behind = [r[5][(r[3] - r[1]) * width :] for r in group], [r[5][: (r[3] - r[1]) * width][::-1] for r in group]
            for i, a, b in repeated_windows(ahead, behind, length * width):
                # windows begin and end with whole units
                if (a := -(-a // width)) <= (b := b // width):
                    yield group[i][0], group[i][3] - b, group[i][3] - a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, group, key = [], [], None
        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                if row[4] != key:
                    out += settle(group)
                    group, key = [], row[4]
                group.append(row)
                if len(out) > 50_000:
                    yield _batch(out, names, _RUN_TYPES)
                    out = []
        out += settle(group)
        if out:
            yield _batch(out, names, _RUN_TYPES)

    return run


def _refined(length: int, width: int):
    """Suffixes against one that leads their group: runs (first and last are set) of windows that they have in common, and for those
    beyond these the suffix again, under a key of the byte at which it leaves the leader, on either side."""
    names, types = [x.split()[0] for x in f"{CONTEXT}, first int, last int".split(", ")], (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        led: set[tuple] = set()
        for b in batches:
            out = []
            for node, lo, hi, at, key, around, (node_l, lo_l, hi_l, at_l, around_l) in zip(*[b.column(i).to_pylist() for i in range(6)], (tuple(x.values()) for x in b.column(6).to_pylist()), strict=True):
                if (node, at, lo) == (node_l, at_l, lo_l):
                    continue
                ahead, behind = around[(at - lo) * width :], around[: (at - lo) * width][::-1]
                right, left = common_prefix(ahead, around_l[(at_l - lo_l) * width :]), common_prefix(behind, around_l[: (at_l - lo_l) * width][::-1])
                if length - right // width <= left // width:
                    out.append((node, *[None] * 5, at - left // width, at - length + right // width))
                    leader = (node_l, *[None] * 5, at_l - left // width, at_l - length + right // width)
                    if leader not in led:
                        if len(led) > 1 << 16:
                            led.clear()
                        led.add(leader)
                        out.append(leader)
                for side, n, own in ((b"<", left, behind), (b">", right, ahead)):
                    if n < len(own):
                        out.append((node, lo, hi, at, hashlib.md5(key + side + n.to_bytes(4, "big") + own[n : n + 1]).digest(), around, None, None))
            if out:
                yield _batch(out, names, types)

    return run


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    return merged


def _cut(length: int, words: int):
    names = ["node", "n_bytes", "removed", "kept", "passages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, text, copies, runs, common in zip(b.column(0), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                merged = _merged([(0, len(raw))] if copies > 1 and len(raw) >= length else [(r["first"], r["last"] + length) for r in runs or ()])
                passages = sum(e - s for s, e in _merged([(r["first"], r["last"] + 1) for r in common or ()]))
                if copies > 1:
                    w, _, h = _words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    passages = int(first_windows(h, np.zeros(max(0, len(w) - words + 1), np.int64), words).sum())
                kept, at = [], 0
                for s, e in merged:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.binary()), pa.array([len(raw)], pa.int64()), pa.array([[{"start": s, "stop": e} for s, e in merged]], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([b"".join(kept)], pa.binary()), pa.array([passages], pa.int64())], names=names)

    return run


def _runs(texts: DataFrame, length: int, gram: int, width: int, run_rows: int, keep: list[str]) -> DataFrame:
    """Rows (node, first, last), stored into `keep`: starts of windows of `length` units that stand elsewhere as well. Units are bytes (width 1) or words (WIDTH)."""
    spark, kept, once = texts.sparkSession, [], []
    spots = stored(texts.select("node", "text").mapInArrow(_anchored(length, gram, width), "node binary, lo int, hi int, at int, l long, r long, whole long"), once)

    # surroundings that repeat as a whole repeat in every window: one stays to meet others. What a join takes is stored
    # first, so that adaptive execution can split a hot key
    again = lambda df, c: stored(df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(c, F.lit(True).alias(f"{c}_")), kept).hint("shuffle_hash")
    rows = stored(spots.join(again(spots, "whole"), "whole", "left"), kept)
    dropped(spark, once)
    names = ["node", "lo", "hi", "at", "l", "r"]
    one = rows.where("whole_").groupBy("whole").agg(F.min(F.struct(*names)).alias("one")).select("one.*")
    chosen = stored(rows.where("whole_ is null").select(*names).unionByName(one), kept)
    near = chosen.join(again(chosen.where("l <> 0"), "l"), "l", "left").join(again(chosen.where("r <> 0"), "r"), "r", "left").where("l_ or r_")
    places = near.groupBy("node").agg(F.collect_list(F.struct("lo", "hi", "at")).alias("spots"))
    group = stored(texts.select("node", "text").join(places, "node").mapInArrow(_contexts(length, gram, width), CONTEXT), kept)
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = [rows.where("whole_").select("node", F.col("lo").alias("first"), F.col("hi").alias("last"))]
    while True:
        hot = stored(group.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > run_rows).select("key"), kept)
        some = bool(hot.limit(1).count())
        buckets = (group.join(hot, "key", "left_anti") if some else group).select(*[x.split()[0] for x in CONTEXT.split(", ")])
        found.append(stored(buckets.repartitionByRange(partitions, "key").sortWithinPartitions("key").mapInArrow(_settled(length, width), RUNS), kept))
        if not some:
            break
        many = group.join(hot, "key")
        leaders = stored(many.groupBy("key").agg(F.min(F.struct("node", "lo", "hi", "at", "around")).alias("leader")), kept)
        parts = stored(many.join(leaders, "key").select(*buckets.columns, "leader").mapInArrow(_refined(length, width), f"{CONTEXT}, first int, last int"), kept)
        found.append(parts.where("first is not null").select("node", "first", "last"))
        group = parts.where("first is null").drop("first", "last")
    runs = stored(reduce(DataFrame.unionByName, found), keep)
    dropped(spark, kept)
    return runs


def _removal(docs: DataFrame, id_col: str, text_col: str, length: int, words: int, run_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each document, and (key, n_bytes, removed, kept_sha256, passages) of each distinct text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("node"), text.alias("text"))
    spark, kept = docs.sparkSession, []
    documents = src.select("doc_id", "node")
    texts = stored(src.select("node", "text").groupBy("node").agg(F.first("text").alias("text"), F.count("*").alias("copies")), kept)
    found = [
        _runs(texts, size, gram, width, run_rows, kept).select("node", *[F.when(F.lit(w == width), F.struct("first", "last")).alias(c) for c, w in (("runs", 1), ("common", WIDTH))])
        for size, gram, width in ((words, WORDS_GRAM, WIDTH), (length, GRAM, 1))
    ]
    runs = reduce(DataFrame.unionByName, found).groupBy("node").agg(F.collect_set("runs").alias("runs"), F.collect_set("common").alias("common"))
    results = texts.join(runs, "node", "left").select("node", "text", "copies", "runs", "common")
    results = results.mapInArrow(_cut(length, words), "node binary, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary, passages long")
    results = stored(results.select(F.col("node").alias("key"), "n_bytes", "removed", F.sha2("kept", 256).alias("kept_sha256"), "passages"))
    dropped(spark, kept)
    return documents, results


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, run_rows: int = 20_000, words: int = 51) -> DataFrame:
    """A row for each document: doc_id, n_bytes, removed (array of start, stop in UTF-8 bytes), kept_sha256, passages.

    A byte is removed if a `length`-byte string that covers it also starts anywhere
    else, in the same document or another. Null text: empty. Documents with equal
    texts repeat each other whole, if long enough. Rows with null or equal ids are
    kept, and repeated rows are documents like others. An empty table gives no rows. Other columns are not read. Long
    texts are held a few at a time. Anchors are told apart by 64-bit hashes, windows by their bytes. A group of suffixes that agree in
    their leads is sorted in one task up to `run_rows` of them, and split beyond. `passages` counts the different passages of `words` words
    (at least WORDS_GRAM; between ASCII white space, case counts, told apart by 64-bit hashes of their words) of a document that stand in another document
    as well, whatever their length in bytes: those too short to be removed show there alone.
    """
    documents, results = _removal(docs, id_col, text_col, length, words, run_rows)
    return documents.join(results, F.col("node") == F.col("key")).select("doc_id", "n_bytes", "removed", "kept_sha256", "passages")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeated_bytes() of all documents, in counts."""
    removed = F.col("removed")
    return repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.aggregate(removed, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("n_removed"), F.size(removed).cast("long").alias("n_spans"), "kept_sha256", F.col("passages").alias("n_passages")
    )
