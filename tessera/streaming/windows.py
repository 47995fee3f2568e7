"""File streams, and windows over event time. Batch frames take the same functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import Collection


def read_line_stream(spark: SparkSession, path: str, files_per_round: int = 1, bytes_per_round: str | None = None, pattern: str | None = None, pairs: bool = False) -> DataFrame:
    """An endless source of the lines of files that appear in a folder, oldest first, and of those that match a glob pattern alone.

    A round takes so many files, or files of so many bytes at most. Rounds come at the times that the query's trigger says.
    pairs: lines are split at their first tab into key and value.
    """
    source = spark.readStream.option("maxFilesPerTrigger", files_per_round)
    if bytes_per_round:
        source = spark.readStream.option("maxBytesPerTrigger", bytes_per_round)
    if pattern:
        source = source.option("pathGlobFilter", pattern)
    df = source.text(path)
    if not pairs:
        return df
    at = F.instr("value", "\t")
    return df.select(F.when(at > 0, F.expr("substring(value, 1, instr(value, '\t') - 1)")).otherwise(F.col("value")).alias("key"), F.when(at > 0, F.expr("substring(value, instr(value, '\t') + 1)")).alias("value"))


def repeated_lines(spark: SparkSession, path: str, rows_per_second: int = 1) -> DataFrame:
    """An endless source of a folder's lines, all of them again for every tick of a clock: (tick, value)."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("tick"))
    return ticks.crossJoin(spark.read.text(path))


def window_into(c: Collection, time: str, size: str | None = None, slide: str | None = None, gap: str | None = None, late: str | None = None) -> Collection:
    """Grouped by windows [start, end) of one size, which overlap if they slide, or by sessions with a gap, within the groups that there are."""
    if (size is None) == (gap is None):
        raise ValueError("windows have a size, or a gap")
    df = c.df.withColumn(time, F.col(time).cast("timestamp"))
    df = df.withWatermark(time, late) if late else df
    if size is not None:
        return Collection(df.withColumn("window", F.window(time, size, slide) if slide else F.window(time, size)), (*c.keys, "window"))
    # a session's window is known from all its rows together, so an aggregate has to follow
    return Sessions(df, c.keys, None, (), None, None, time, gap)


class Sessions(Collection):
    """Rows in sessions of each group: agg() and count() close them."""

    def __init__(self, df, keys, universe, order, raw, outer, time, gap):
        super().__init__(df, keys, universe, order, raw, outer)
        object.__setattr__(self, "by", F.session_window(time, gap).alias("window"))

    def agg(self, **fields: Column) -> Collection:
        return Collection(self.df.groupBy(*self.keys, self.by).agg(*[c.alias(n) for n, c in fields.items()]), (*self.keys, "window"))

    def count(self, into: str = "count") -> Collection:
        return self.agg(**{into: F.count(F.lit(1))})


def _flat(out: Collection, keys: tuple[str, ...], names) -> DataFrame:
    return out.df.select(F.col("window.start").alias("window_start"), *keys, *names)


def tumbling(df: DataFrame, time: str, size: str, late: str | None = None, keys: tuple[str, ...] = (), slide: str | None = None, **aggs: Column) -> DataFrame:
    """Aggregates of windows [start, end) of one size; with `slide` they overlap. Late rows are waited for as long as `late` says."""
    windows = window_into(Collection(df, keys), time, size, slide, late=late)
    return _flat(Collection(windows.df.groupBy(*windows.keys).agg(*[c.alias(n) for n, c in aggs.items()]), windows.keys), keys, aggs)


def sessions(df: DataFrame, time: str, gap: str, keys: tuple[str, ...], late: str | None = None, **aggs: Column) -> DataFrame:
    """Aggregates of sessions: rows of a key that lie less than `gap` apart."""
    return _flat(window_into(Collection(df, keys), time, gap=gap, late=late).agg(**aggs), keys, aggs)
