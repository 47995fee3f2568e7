"""User-defined sources and sinks on Spark's Python data source interface."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.core import Collection


def read_user(spark: SparkSession, splits: list, load: Callable[[object], Iterator[tuple]], schema: str, keyed: bool = False, post_process: Callable[[Collection], Collection] | None = None) -> Collection:
    """load(split) gives the rows of each split, each in a task of its own; keyed: grouped by the split's number.
    post_process takes the collection and gives the one that is returned."""
    name = f"tessera_user_{uuid.uuid4().hex}"
    full = f"split_id int, {schema}"

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(len(splits))]

        def read(self, partition):
            for row in load(splits[partition.value]):
                yield (partition.value, *row)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return full

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    df = spark.read.format(name).load()
    out = Collection(df, ("split_id",)) if keyed else Collection(df.drop("split_id"))
    return out if post_process is None else post_process(out)


class Sink:
    """Base of user sinks. In each task open(partition) is called, sink(row) for each row, and close(), whose result goes to commit().

    commit(results) runs on the driver when all tasks have ended well, and abort() if not. A task that is tried again opens again.
    partition_number and partition_fn(row) (a number below it) deal the rows.
    """

    partition_number: int | None = None
    partition_fn: Callable | None = None

    def pre_process(self, c: Collection) -> Collection:
        return c

    def open(self, partition: int) -> None:
        pass

    def sink(self, row) -> None:
        raise NotImplementedError

    def close(self):
        return None

    def commit(self, results: list) -> None:
        pass

    def abort(self) -> None:
        pass


def write_user(c: Collection, sink: Sink | Callable[[Iterator], None]) -> None:
    """A Sink, or a function that takes the rows of each partition; a task that is tried again calls it again."""
    if not isinstance(sink, Sink):
        c.df.foreachPartition(sink)
        return
    name, df = f"tessera_sink_{uuid.uuid4().hex}", sink.pre_process(c).df
    if sink.partition_number:
        if sink.partition_fn is not None:
            from pyspark.sql import functions as F

            fn, names = sink.partition_fn, df.columns
            placed = Collection(df).map(lambda r: (*(r if len(names) > 1 else (r,)), int(fn(r))), returns=", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", __part int")
            df = placed.df.repartitionById(sink.partition_number, F.col("__part")).drop("__part")
        else:
            df = df.repartition(sink.partition_number)

    class Message(WriterCommitMessage):
        def __init__(self, result):
            self.result = result

    class Writer(DataSourceWriter):
        def write(self, iterator):
            from pyspark import TaskContext

            sink.open(TaskContext.get().partitionId())
            for row in iterator:
                sink.sink(row)
            return Message(sink.close())

        def commit(self, messages):
            sink.commit([m.result for m in messages if m is not None])

        def abort(self, messages):
            sink.abort()

    class Target(DataSource):
        @classmethod
        def name(cls):
            return name

        def writer(self, schema, overwrite):
            return Writer()

    c.df.sparkSession.dataSource.register(Target)
    df.write.format(name).mode("append").save()
