"""Removal of repeated lines and sentences by hashing.

Units are lines, and the sentences within lines, short ones in groups with their
neighbours. Their normalised forms' digests
are grouped over all documents; the earliest occurrence (by document id, then
offset) stays, and the others go, with their offsets in the original text kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import keyed, pick, stored, table

_SENTENCE = re.compile(r"\S(?:.*?[.!?…](?=\s)|.*)", re.S)
UNITS = "doc_id long, text_hash long, start int, stop int, digest binary"


def groups(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """(from, to) of sentences of these sizes: from each on, and up to each that none of those ends with, the fewest that have at least `least` words together."""
    out, n, j = [], 0, 0
    for i, size in enumerate(sizes):
        while j < len(sizes) and n < least:
            n += sizes[j]
            j += 1
        if n < least:
            break
        out.append((i, j))
        n -= size
    ends = {j for _, j in out}
    for j in range(1, len(sizes) + 1):
        if j not in ends:
            i, n = j, 0
            while i and n < least:
                i -= 1
                n += sizes[i]
            if n >= least:
                out.append((i, j))
    return out


def units(text: str, line_words: int, sentence_words: int) -> list[tuple[int, int, bytes]]:
    """(start, stop, digest) of the text's lines, and of groups of its lines' sentences if there are several; short ones are left out."""
    out, at = [], 0
    for line in text.split("\n"):
        words = line.split()
        if len(words) >= line_words:
            begin = at + line.index(words[0])
            out.append((begin, at + len(line.rstrip()), hashlib.md5(" ".join(words).lower().encode("utf-8", "surrogatepass")).digest()))
        if len(words) >= sentence_words:
            found = [(m.start(), m.group().rstrip()) for m in _SENTENCE.finditer(line)]
            sizes = [len(sentence.split()) for _, sentence in found]
            edge = [0, *accumulate(sizes)]
            for i, j in groups(sizes, max(1, sentence_words)) if len(found) > 1 else ():
                if j - i < len(found) or len(words) < line_words:
                    w = words[edge[i] : edge[j]]
                    out.append((at + found[i][0], at + found[j - 1][0] + len(found[j - 1][1]), hashlib.md5(" ".join(w).lower().encode("utf-8", "surrogatepass")).digest()))
        at += len(line) + 1
    return out


def _units(line_words: int, sentence_words: int):
    names = [x.split()[0] for x in UNITS.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows.append((d, h, -1, -1, None))  # one for the document itself
                rows += [(d, h, *u) for u in units(text.as_py() or "", line_words, sentence_words)]
                if len(rows) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = 3, sentence_words: int = 8) -> DataFrame:
    """A row for each document: doc_id, text_hash, n_units, removed (array of start, stop; merged, in code points).

    Lines of fewer than `line_words` words are not removed by themselves, nor are sentences of
    fewer than `sentence_words`: they go with neighbours that make up as many words and repeat with
    them. Of each sentence that goes, an earlier occurrence stays. Case and white space are ignored. Null and empty
    texts have no units. Rows with the same id and text are one document in two
    rows: both get the same result. Null ids rank first. Long texts are cut
    into units whole. An empty table gives no rows. Other columns are not read.
    """
    text = F.col("text")
    src = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), "text")
    every = stored(src.mapInArrow(_units(line_words, sentence_words), UNITS))
    real = every.where("digest is not null")
    rank = F.struct("doc_id", "text_hash", "start")
    # most units occur once, so the join keeps few; stored, so that adaptive execution can split a frequent digest
    first = stored(real.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    later = real.join(first, "digest").where(rank != F.col("first")).select("doc_id", "text_hash", "start", "stop")
    sizes = every.groupBy("doc_id", "text_hash").agg(F.count_if(F.col("start") < 0).alias("rows"), F.count_if(F.col("start") >= 0).alias("units"))
    spans = later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans")).toDF("id", "hash", "spans")
    both = sizes.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    kind = "array<struct<start:int,stop:int>>"
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, s: F.array(F.struct(last(acc)["start"], F.greatest(last(acc)["stop"], s["stop"]))).cast(kind)
    none = F.array().cast(kind)
    merged = F.aggregate(F.coalesce("spans", none), none, lambda acc, s: F.when((F.size(acc) > 0) & (last(acc)["stop"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), joined(acc, s))).otherwise(F.concat(acc, F.array(s))))
    return both.select("doc_id", "text_hash", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("_"), (F.col("units") / F.col("rows")).cast("long").alias("n_units"), merged.alias("removed")).drop("_")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the repeated units cut out of their texts; all rows stay, null texts stay null, and columns may have any names."""
    own, _, text = keyed(docs, id_col, text_col)
    own = own.withColumn("row_hash", F.xxhash64(text))
    found = repeated(own.select(F.col("row_id").alias("doc_id"), F.col(text).alias("text")), **options)
    found = found.select(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), "removed").dropDuplicates(["cut_id", "cut_hash"])
    whole = F.col(text)
    starts = F.concat(F.array(F.lit(0)), F.transform("removed", lambda s: s["stop"]))
    stops = F.concat(F.transform("removed", lambda s: s["start"]), F.array(F.length(whole)))
    kept = F.array_join(F.zip_with(starts, stops, lambda a, b: F.substring(whole, a + 1, b - a)), "")
    joined = own.join(found, own["row_id"].eqNullSafe(found["cut_id"]) & (own["row_hash"] == found["cut_hash"]), "left")
    return joined.withColumn(text, F.when(F.size("removed") > 0, kept).otherwise(whole)).drop("row_id", "row_hash", "cut_id", "cut_hash", "removed").toDF(*docs.columns)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeated() of all documents; spans as text, start:stop and comma-joined."""
    r = F.col("removed")
    return repeated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_units", F.size(r).cast("long").alias("n_spans"), F.aggregate(r, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("n_removed"),
        F.array_join(F.transform(r, lambda s: F.concat_ws(":", s["start"], s["stop"])), ",").alias("removed_spans"),
    )
