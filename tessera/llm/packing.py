"""Packing documents into fixed-length token sequences.

First-fit decreasing, run independently in randomised groups of documents. Each
group keeps its bins' free capacities in a tournament tree, so that the first bin
with room for a piece is found in a logarithmic number of steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pick, table

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_STATE: dict = {}


def tokenizer(ranks: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    """A function from text to its ids (little-endian unsigned 32-bit), made once in each worker.

    Ranks and pattern give the ids of the byte-level BPE that they were taken from, in a third
    of its time. `added` are tokens that stand in texts as they are, with their ids.
    """
    if (ranks, pattern, added) not in _STATE:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=dict(added)).encode_to_numpy
        _STATE[ranks, pattern, added] = lambda text: encode(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes()
    return _STATE[ranks, pattern, added]


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The tokens that a tokenizer's JSON file adds to its vocabulary, and their ids."""
    import json

    with open(path, encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """A bin for each length: the first with room, in order of falling length (ties: as given)."""
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    tree = [capacity] * (2 * size)
    where = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, node = lengths[i], 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        where[i] = node - size
        tree[node] -= need
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return where


def filled(bins: list[list[list[int]]], capacity: int) -> list[list[list[int]]]:
    """The bins without padding: the emptiest bins' pieces are cut to fill the others' gaps, and
    what is left in the last open bin goes into sequences whose lengths are powers of two.

    A piece is [row, start, length]."""
    room = lambda b: capacity - sum(p[2] for p in b)
    done = [b for b in bins if not room(b)]
    opened = sorted((b for b in bins if room(b)), key=lambda b: (-room(b), b[0][:2]))
    i, j = 0, len(opened) - 1
    while i < j:
        gap, to = room(opened[j]), opened[j]
        while gap and i < j:
            row, start, length = opened[i].pop()
            took = min(gap, length)
            to.append([row, start + length - took, took])
            gap -= took
            if took < length:
                opened[i].append([row, start, length - took])
            elif not opened[i]:
                i += 1
        if not gap:
            done.append(to)
            j -= 1
    for b in opened[i : j + 1]:
        while b:
            want, out = 1 << (sum(p[2] for p in b).bit_length() - 1), []
            while want:
                row, start, length = b.pop()
                took = min(want, length)
                out.append([row, start + length - took, took])
                want -= took
                if took < length:
                    b.append([row, start, length - took])
            done.append(out)
    return done


def _tokenized(ranks: str, pattern: str, added: tuple, capacity: int, end_id: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        ids, end, step, n = tokenizer(ranks, pattern, added), int(end_id).to_bytes(4, "little"), 4 * capacity, 0
        names = ["doc_id", "start", "length", "doc_tokens", "ids", "grp"]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=names)

        rows, held = [], 0
        for d, text in ((d, x) for b in batches for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True)):
            data = ids(text.as_py() or "") + end
            n += 1
            for at in range(0, len(data), step):
                part = data[at : at + step]
                rows.append((d, at // 4, len(part) // 4, len(data) // 4, part, zlib.crc32(f"{d} {at} {zlib.crc32(part)} {n} {task}".encode()) % groups))
                held += len(part)
                if held > 8 << 20:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def _packed(capacity: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")])
        docs, starts, lengths, totals = (t.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens"))
        blobs = t.column("ids")
        whole = [i for i, n in enumerate(lengths) if n == capacity]
        rest = [i for i, n in enumerate(lengths) if n != capacity]
        bins: dict[int, list] = {}
        for i, b in zip(rest, first_fit_decreasing([lengths[i] for i in rest], capacity), strict=True):
            bins.setdefault(b, []).append([i, 0, lengths[i]])
        sequences = [[[i, 0, capacity]] for i in whole] + filled(list(bins.values()), capacity)
        out = []
        for s, pieces in enumerate(sequences):
            at = 0
            for i, start, length in pieces:
                out.append((docs[i], starts[i] + start, length, blobs[i].as_py()[4 * start : 4 * (start + length)], totals[i], key[0].as_py() << 32 | s, at))
                at += length
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, ranks: str | None = None, pattern: str | None = None, added: tuple[tuple[str, int], ...] = (), group_mb: int = 12) -> DataFrame:
    """Pieces of documents in sequences of at most `capacity` tokens: a row a piece, with its ids.

    A document is its text's ids and then `end_id`. Documents are cut at every
    `capacity` ids; the remainders, dealt at random into groups of about
    `group_mb` MB of text, are packed in each by first-fit decreasing.
    Null or empty text: the end id alone. Repeated rows: each is packed, and they are dealt into different
    groups. Null ids are kept. An empty table gives no pieces. Long texts are dealt piece by
    piece. Other columns are not read. `added` tokens in a text have their own ids; without `ranks` the public
    50,000 vocabulary and what its JSON file adds are taken.
    """
    if ranks is None:
        import public_tokenizers

        ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
        added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    src = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = 1 + total // (group_mb << 20)
    cut = src.mapInArrow(_tokenized(ranks, pattern, added, capacity, end_id, groups), "doc_id long, start long, length long, doc_tokens long, ids binary, grp long")
    return cut.groupBy("grp").applyInArrow(_packed(capacity), PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents, in sequences of 1,024 tokens."""
    return digests(pack(table(spark, sf_dir, "documents")))
