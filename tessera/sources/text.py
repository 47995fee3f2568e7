"""Text sources and sinks: lines, delimited fields, sorted and partitioned output, sequence files, and shell pipes."""

from __future__ import annotations

import re
import subprocess
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.core import Collection
from tessera.functions import opaque


def read_lines(spark: SparkSession, *paths: str, partitioned: bool = False) -> Collection:
    """A record for each line; gzip by extension. Partitioned: keyed by file."""
    df = spark.read.text(list(paths))
    return Collection(df.withColumn("split", F.col("_metadata.file_path")), ("split",)) if partitioned else Collection(df)


def declared(columns: str | int | list) -> StructType:
    """Columns by a DDL string, by names or (name, type) pairs, by types alone, or by their number; what has no type is a string."""
    if isinstance(columns, str):
        return StructType.fromDDL(columns)
    if isinstance(columns, int):
        columns = ["string"] * columns
        return StructType.fromDDL(", ".join(f"_{i} {t}" for i, t in enumerate(columns)))
    types = {"string", "int", "long", "bigint", "double", "float", "boolean", "short", "byte", "date", "timestamp"}
    if all(isinstance(c, str) and c in types for c in columns):
        return StructType.fromDDL(", ".join(f"_{i} {t}" for i, t in enumerate(columns)))
    return StructType.fromDDL(", ".join(f"{c} string" if isinstance(c, str) else f"{c[0]} {c[1]}" for c in columns))


def split_fields(lines: DataFrame, columns: str | int | list, separator: str = "\t", ignore_overflow: bool = False, ignore_illegal_line: bool = False, keys: tuple[str, ...] = ()) -> Collection:
    """Fields of each line with declared types. Empty fields stay; too many or too few fail unless ignored."""
    schema = declared(columns)
    parts, n = F.split("value", re.escape(separator), -1), len(schema)
    df = lines.select(*keys, parts.alias("p"))
    if ignore_illegal_line:
        df = df.where(F.size("p") >= n)
    bad = F.size("p") < n if ignore_overflow else F.size("p") != n
    fields = F.when(bad, F.raise_error(F.concat(F.lit("a line has other than the declared fields: "), F.array_join("p", separator)))).otherwise(F.col("p"))
    return Collection(df.select(*keys, fields.alias("p")).select(*keys, *[F.col("p")[i].cast(f.dataType).alias(f.name) for i, f in enumerate(schema)]), keys)


def read_fields(spark: SparkSession, *paths: str, columns: str | int | list, separator: str = "\t", ignore_overflow: bool = False, ignore_illegal_line: bool = False, partitioned: bool = False) -> Collection:
    """Delimited text; see split_fields()."""
    lines = read_lines(spark, *paths, partitioned=partitioned)
    return split_fields(lines.df, columns, separator, ignore_overflow, ignore_illegal_line, lines.keys)


def write_lines(c: Collection, path: str, line: Column | str, overwrite: bool = True, gzip: bool = False, sort_by: list[Column] | None = None, partitions: int | None = None, partition_id: Column | None = None, separator: str = "\n") -> None:
    """A line for each record. With partition_id record i goes to file i; sort_by orders each file."""
    df = c.df
    if partition_id is not None:
        df = df.repartitionById(partitions, partition_id.cast("int"))
    elif partitions:
        df = df.repartition(partitions)
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    out = df.select((F.col(line) if isinstance(line, str) else line).cast("string").alias("value"))
    out.write.mode("overwrite" if overwrite else "error").option("lineSep", separator).option("compression", "gzip" if gzip else "none").text(path)


def joined_fields(columns: list[str], separator: str = "\t") -> Column:
    """The columns as text, separated; null as empty."""
    return F.concat_ws(separator, *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in columns])


def write_fields(c: Collection, path: str, columns: list[str], separator: str = "\t", **options) -> None:
    write_lines(c, path, joined_fields(columns, separator), **options)


def _both(key, value) -> None:
    if (key is None) != (value is None):
        raise ValueError("give a function for both key and value, or for neither")


def write_sequence(c: Collection, path: str, key: str, value: str, encode_key: Callable | None = None, encode_value: Callable | None = None) -> None:
    """Pairs of bytes in a Hadoop sequence file, which Spark has for RDDs alone. The functions give bytes of the fields' values."""
    _both(encode_key, encode_value)
    if encode_key is None:
        pairs = c.df.select(F.col(key).cast("binary"), F.col(value).cast("binary")).rdd.map(tuple)
    else:
        pairs = c.df.select(key, value).rdd.map(lambda r: (bytearray(encode_key(r[0])), bytearray(encode_value(r[1]))))
    pairs.saveAsSequenceFile(path)


def read_sequence(spark: SparkSession, *paths: str, decode_key: Callable | None = None, decode_value: Callable | None = None, returns: str = "key binary, value binary", partitioned: bool = False) -> Collection:
    """Pairs of sequence files, as bytes or as the functions give them for the fields that `returns` declares. Partitioned: keyed by path."""
    _both(decode_key, decode_value)
    key, value = decode_key or bytes, decode_value or bytes
    out = None
    for path in paths:
        pairs = spark.sparkContext.sequenceFile(path).map(lambda kv, path=path: (path, key(bytes(kv[0])), value(bytes(kv[1]))))
        df = spark.createDataFrame(pairs, f"split string, {returns}")
        out = df if out is None else out.unionAll(df)
    return Collection(out, ("split",)) if partitioned else Collection(out.drop("split"))


def as_type(c: Collection, decode: Callable, returns: str) -> Collection:
    """Pairs of a sequence file as records: decode(key, value)."""
    return c.map(lambda r: decode(*r), returns=returns)


def _piped(command: str, frame: Callable, unframe: Callable, names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = subprocess.Popen(["/bin/sh", "-c", command], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        failed: list[BaseException] = []

        def feed():
            try:
                for b in batches:
                    for row in zip(*[b.column(b.schema.names.index(n)).to_pylist() for n in names], strict=True):
                        p.stdin.write(frame(row))
                p.stdin.close()
            except BrokenPipeError:
                pass  # the command has read enough
            except BaseException as error:  # noqa: BLE001
                failed.append(error)
                p.kill()

        thread = threading.Thread(target=feed, daemon=True)
        thread.start()
        rows = []
        for row in unframe(p.stdout):
            rows.append(row)
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        thread.join()
        if failed:
            raise failed[0]
        if (status := p.wait()) != 0:
            raise RuntimeError(f"the command ended with status {status}: {command}")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def pipe(c: Collection, command: str, fields: list[str], into: str = "value", delimiter: str = "\t", returns: str | None = None, binary: bool = False) -> Collection:
    """Records through a shell command in each partition; a status other than 0 fails the job.

    As lines of fields, null as empty; empty lines of the output are dropped, and others give one field `into`, or those strings that
    `returns` names, the last of which takes the rest of a line. Binary: each field goes both ways as its length (4 bytes, little-endian) and its bytes,
    and `returns` names the fields of a record. Under keys, these are sent first and a key's records are together; the output's keys are
    its first fields.
    """
    keys = list(c.keys)
    names = [*keys, *([f.split()[0] for f in returns.split(",")] if returns else [into])]
    if keys and not returns:
        names, keyed = [into], ()
    else:
        keyed = c.keys
    df = c.df.select(*[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(f"f{i}") for i, n in enumerate([*keys, *fields])])
    if keys:
        by = [f"f{i}" for i in range(len(keys))]
        df = df.repartition(*by).sortWithinPartitions(*by)
    schema = StructType.fromDDL(", ".join(f"{n} string" for n in names))
    arrow = opaque._arrow(schema)

    def frame(row) -> bytes:
        return (delimiter.join(row) + "\n").encode()

    def unframe(stream) -> Iterator[list]:
        for line in stream:
            text = line.decode().rstrip("\n")
            if text:
                own = text.split(delimiter, len(names) - 1) if len(names) > 1 else [text]
                yield own + [None] * (len(names) - len(own))

    def framed(row) -> bytes:
        return b"".join(len(raw := x.encode()).to_bytes(4, "little") + raw for x in row)

    def unframed(stream) -> Iterator[list]:
        row: list = []
        while size := stream.read(4):
            raw = stream.read(int.from_bytes(size, "little"))
            row.append(raw.decode())
            if len(row) == len(names):
                yield row
                row = []
        if row:
            raise ValueError("the command's output ends within a record")

    run = _piped(command, framed if binary else frame, unframed if binary else unframe, df.columns, arrow)
    return Collection(df.mapInArrow(run, schema), keyed)
