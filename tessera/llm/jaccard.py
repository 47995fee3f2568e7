"""Near-duplicate documents by an exact n-gram Jaccard join.

Texts with equal shingle sets form a class, and classes are joined. Shingles are
ordered by a frequency class and then by hash. A class is indexed under the first
few of its shingles in this order: single ones while they are rare, and beyond
them, in an extended prefix, combinations of two frequent ones that follow one
another. Classes that share a key are checked twice: first all against two of them,
and then, where several components still meet, those outside the largest one
against the others. Sizes, positions and bit maps of the sets leave out most pairs
that can't link; what is left is compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, keyed, pick, stored, table, text_hash
from tessera.llm.components import components
from tessera.llm.shingles import mixed, sets_of

#: Cells of the table that counts in how many sets a hashed shingle occurs; its size does not grow with the data.
CELLS, SLOTS = 1 << 23, 64
#: Frequency class from which a shingle counts as frequent.
FREQUENT = 3
#: Least share at which combinations are sure to meet; below it all keys are single.
COMBINED = 70
#: Words of 64 bits in a set's bit map.
MAP = 8
#: Classes that a task of the index remembers, to index copies once.
SEEN = 1 << 18


def _cells(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(65 - CELLS.bit_length())).astype(np.int64)


def _node(g: np.ndarray) -> bytes | None:
    return hashlib.md5(g).digest() if len(g) else None


def _profile(k: int):
    """The documents' set keys and sizes, and at the end of each task its counts of shingles by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["doc_id", "row_hash", "node", "n", "slot", "part"], (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
        total = np.zeros(CELLS, np.uint8)

        def add(cells):
            at, n = np.unique(np.concatenate(cells), return_counts=True)
            total[at] = np.minimum(total[at] + n, 255)  # a task's share; the sum over tasks has more bits

        for b in batches:
            nodes, sizes, held, cells = [], [], 0, []
            for g in sets_of(b.column(2), k):
                nodes.append(_node(g))
                sizes.append(len(g))
                cells.append(_cells(g))
                held += len(g)
                if held > 1 << 20:
                    add(cells)
                    cells, held = [], 0
            if cells:
                add(cells)
            if nodes:
                none = [None] * len(nodes)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip((nodes, sizes, none, none), types[2:], strict=True)]], names=names)
        for s, part in enumerate(np.split(total, SLOTS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, None, s, part.tobytes()), types, strict=True)], names=names)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for s, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(part.as_py(), np.uint8).astype(np.uint32)
            total[s] = total[s] + x if s in total else x
    for s, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes()], pa.binary())], names=["slot", "part"])


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 for cells of usual count, and then one more for each power of two above it."""
    mean = float(counts.mean())
    usual = np.float32(max(4.0, mean + 3 * mean**0.5))
    out = np.zeros(len(counts), np.uint8)
    above = np.flatnonzero(counts > usual)
    out[above] = np.clip(1 + np.floor(np.log2(counts[above] / usual)), 1, 15)
    return out


def index_keys(g: np.ndarray, classes: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, and for each how many of the set's shingles, first in order, the other set can't have if this is
    the key at which the two meet first.

    Two sets that link have at least ceil(share * n / 100) shingles in common, n the greater size.
    So one has at most `miss` shingles that the other has not, and the first in common is among its
    first miss + 1. If that one is rare, it is a key of both. If it is frequent, so are all in common, since
    frequent ones come last. Both sets together have at most `both` shingles that only one has, the rare
    ones (at least `rare`) among them. So among the first both - rare + 2 in common there are two
    between which neither set has another: they follow one another in both orders, and are a key of both.
    """
    n = len(g)
    order = np.sort(classes[_cells(g)].astype(np.uint64) << np.uint64(60) | mixed(g) >> np.uint64(4))
    miss = n + share * n // -100
    rare = int(np.searchsorted(order, np.uint64(FREQUENT << 60)))
    if rare > miss or share < COMBINED:
        return order[: miss + 1], np.arange(miss + 1)
    last = min(miss + (100 - share) * n // share - rare, n - 2)
    two = mixed(order[rare : last + 1] * np.uint64(0x9E3779B97F4A7C15) + order[rare + 1 : last + 2])
    return np.concatenate([order[:rare], two]), np.concatenate([np.arange(rare), np.full(len(two), rare)])


def bit_map(g: np.ndarray) -> np.ndarray:
    """Bits that each shingle turns over: two sets' maps differ in no more places than the sets do."""
    odd = np.bincount((mixed(g ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - (64 * MAP).bit_length() + 1)).astype(np.int64), minlength=64 * MAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


KEYS = "key long, node binary, pos int, n int, map array<long>"


def _keys(shared, k: int, share: int):
    names = [x.split()[0] for x in KEYS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = np.frombuffer(shared.value, np.uint8), set()
        for b in batches:
            keys, at, nodes, sizes, maps, held = [], [], [], [], [], 0

            def flush():
                times = np.array([len(x) for x in keys])
                total, here = int(times.sum()), pa.array(nodes, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), here.take(pa.array(np.repeat(np.arange(len(nodes)), times))), pa.array(np.concatenate(at).astype(np.int32)), pa.nulls(total, pa.int32()), pa.nulls(total, pa.list_(pa.int64()))], names=names)
                # and one row without a key for each set
                yield pa.RecordBatch.from_arrays([pa.nulls(len(nodes), pa.int64()), here, pa.nulls(len(nodes), pa.int32()), pa.array(sizes, pa.int32()), pa.array([m.tolist() for m in maps], pa.list_(pa.int64()))], names=names)

            for g in sets_of(b.column(0), k):
                node = _node(g)
                if len(g) < 2 or node in seen:
                    continue  # a set of one links with equal ones alone
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                x, pos = index_keys(g, classes, share)
                keys.append(x)
                at.append(pos)
                nodes.append(node)
                sizes.append(len(g))
                maps.append(bit_map(g))
                held += len(x)
                if held > 200_000:
                    yield from flush()
                    keys, at, nodes, sizes, maps, held = [], [], [], [], [], 0
            if keys:
                yield from flush()

    return run


def _verified(k: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ga = None, None
        for b in batches:
            keep = []
            for i, (a, gb) in enumerate(zip(b.column(0), sets_of(b.column(3), k), strict=True)):
                if a != last:
                    last, ga = a, next(sets_of(b.column(2).slice(i, 1), k))
                both = len(np.intersect1d(ga, gb, assume_unique=True))
                keep.append(100 * both >= share * (len(ga) + len(gb) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def _could_link(x: str, y: str, share: int) -> Column:
    """By size, by what is left of both sets from the first shingle in common, and by the places in which their bit maps differ."""
    size, of = F.col(f"{x}n") + F.col(f"{y}n"), lambda s, i: F.col(f"{s}map")[i]
    differ = sum((F.bit_count(of(x, i).bitwiseXOR(of(y, i))) for i in range(1, MAP)), F.bit_count(of(x, 0).bitwiseXOR(of(y, 0))))
    return (
        ((100 + share) * F.least(F.col(f"{x}n") - F.col(f"{x}pos"), F.col(f"{y}n") - F.col(f"{y}pos")) >= share * size)
        & (100 * F.least(f"{x}n", f"{y}n") >= share * F.greatest(f"{x}n", f"{y}n"))
        & ((100 + share) * differ <= (100 - share) * size)
    )


def _grouped(src: DataFrame, words: int, share: int) -> DataFrame:
    """(doc_id, row_hash, n, label) of each row of src (doc_id, row_hash, text): label names the component, null for an empty set."""
    spark = src.sparkSession
    once: list[str] = []
    kept: list[str] = []
    profile = stored(src.mapInArrow(_profile(words), "doc_id long, row_hash binary, node binary, n int, slot int, part binary"), kept)
    kind = "slot int, part binary"
    parts = profile.where("slot is not null").select("slot", "part").repartition(SLOTS, "slot").mapInArrow(_added, kind).collect()
    counts = np.zeros(CELLS, np.uint16)
    for r in parts:
        counts[r.slot * (CELLS // SLOTS) : (r.slot + 1) * (CELLS // SLOTS)] = np.frombuffer(r.part, np.uint16)
    shared = spark.sparkContext.broadcast(frequency_classes(counts).tobytes())
    documents = profile.where("slot is null").select("doc_id", "row_hash", "node", "n")

    every = stored(src.select("text").mapInArrow(_keys(shared, words, share), KEYS), once)
    keys, names = every.where("key is not null").select("key", "node", "pos"), ["node", "pos", "n", "map"]
    # tables that a join takes are stored first, so that adaptive execution can split a hot key on either side
    met = stored(keys.groupBy("key").agg(F.min(F.xxhash64("node")).alias("lo"), F.max(F.xxhash64("node")).alias("hi")).where("lo <> hi").select("key"), once)
    shared_keys = keys.join(met.hint("shuffle_hash"), "key").repartition("node").groupBy("key", "node").agg(F.min("pos").alias("pos"))
    sizes = every.where("key is null").select("node", "n", "map").dropDuplicates(["node"])
    rows = stored(shared_keys.join(sizes, "node").select("key", *names), kept)
    wanted = rows.select("node").distinct()
    chosen = stored(documents.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "row_hash")).alias("row")).select("node", "row.*"), kept)
    same_row = (F.col("t.row_hash") == F.col("c.row_hash")) & F.col("t.doc_id").eqNullSafe(F.col("c.doc_id"))
    # rows with the same id and text may repeat
    texts = stored(src.alias("t").join(chosen.alias("c"), same_row).select("node", "text").dropDuplicates(["node"]), kept)
    dropped(spark, once)

    def candidates(own: DataFrame, other: DataFrame, condition: Column) -> DataFrame:
        met = own.join(other.select("key", *[F.col(c).alias(f"a{c}") for c in other.columns if c != "key"]), "key").where(condition & _could_link("a", "", share))
        return met.select(F.least("anode", "node").alias("a"), F.greatest("anode", "node").alias("b")).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        one = pairs.join(texts.toDF("b", "tb"), "b")
        return one.join(texts.toDF("a", "ta"), "a").select("a", "b", "ta", "tb").mapInArrow(_verified(words, share), "a binary, b binary")

    # under each key, all against the class with the fewest shingles of its own and against a random one
    firsts = [F.min_by(F.struct(*names), by) for by in (F.struct("pos", F.xxhash64("node")), F.xxhash64(F.lit(1), "node"))]
    first = stored(rows.groupBy("key").agg(F.array_distinct(F.array(*firsts)).alias("f")).select("key", F.explode("f").alias("f")).select("key", "f.*"), kept)
    tried = stored(candidates(rows, first, F.col("anode") != F.col("node")), kept)
    links = stored(linked(tried), kept)
    root = components(links, keep=kept)
    # where components still meet, those outside the key's largest one against all of other components
    own = stored(rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), kept)
    main = stored(own.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main"), kept)
    own = stored(own.join(main, "key"), kept)
    apart = (F.col("aroot") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("anode") < F.col("node")))
    rest = candidates(own, own.where("root <> main").drop("main"), apart).join(tried, ["a", "b"], "left_anti")
    more = stored(linked(stored(rest, kept)), kept)
    bridges = more.join(root.toDF("a", "ra"), "a", "left").join(root.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    top = components(bridges, keep=kept)
    first_label = documents.join(root, "node", "left").select("doc_id", "row_hash", "n", F.coalesce("root", "node").alias("node"))
    out = stored(first_label.join(top, "node", "left").select("doc_id", "row_hash", "n", F.coalesce("root", "node").alias("label")))
    dropped(spark, kept)
    shared.unpersist()
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: int = 80) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the least id that links reach).

    Documents link when 100 * |A & B| >= share * |A | B| for their sets of `words`-word
    shingles; shorter texts are one shingle. Null texts and those without words
    have empty sets and link with nothing, so they are their own components. Rows
    with equal ids or texts are kept. A component of null ids alone has a null id.
    An empty table gives no rows. Long texts are whole sets, in tasks that hold a few at a time.
    Other columns are not read. The result is exact: frequency counts only order the shingles.
    Links within a component are not produced, only those that join components.
    """
    src = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("row_hash"), "text")
    labelled = _grouped(src, words, share)
    least = stored(labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")))
    return labelled.join(least, "label", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the least id (ties: the least hash of the text).

    A row is known by its id and text, so rows that share an id with another text are judged by
    themselves, and of rows that agree in both one stays (any, if other columns differ). Rows with null ids and
    those whose texts have no words all stay, and no row goes for their sake. Columns may have any names; an empty table stays empty.
    """
    own, _, text = keyed(docs, id_col, text_col)
    found = _grouped(own.select(F.col("row_id").alias("doc_id"), "row_hash", F.col(text).alias("text")), words, share)
    found = found.where("label is not null and doc_id is not null").groupBy("label", "doc_id", "row_hash").agg(F.count("*").alias("rows"))
    found = stored(found)
    best = stored(found.groupBy("label").agg(F.min(F.struct("doc_id", "row_hash")).alias("best")))
    judged = found.join(best, "label").select(F.col("doc_id").alias("row_id"), "row_hash", "rows", (F.struct("doc_id", "row_hash") == F.col("best")).alias("stays"))
    judged = stored(judged.where("not stays or rows > 1"))
    out = own.join(judged.where("not stays"), ["row_id", "row_hash"], "left_anti")
    again = judged.where("stays").select("row_id", "row_hash")
    if again.limit(1).count():
        out = out.join(again, ["row_id", "row_hash"], "left_anti").unionByName(out.join(again, ["row_id", "row_hash"], "left_semi").dropDuplicates(["row_id", "row_hash"]))
    return out.drop("row_id", "row_hash").toDF(*docs.columns)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents, with four words and a share of 85."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, share=85)


#: op2_jaccard in DuckDB's SQL, by all pairs of documents that share a shingle.
SQL = r"""with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as materialized (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) end as sh from w),
u as materialized (select doc_id, len(sh) as n, unnest(sh) as x from s),
e as materialized (select a.doc_id as a, b.doc_id as b from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, label) as (select doc_id, doc_id from s union select case when e.a = r.doc_id then e.b else e.a end, r.label from r join e on r.doc_id in (e.a, e.b))
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, min(r.label) as component_id from s join r using (doc_id) group by s.doc_id, len(s.sh)"""
