"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name first, so that other columns cannot clash."""
    lower = [c.lower() for c in df.columns]
    at = [df.columns.index(n) if n in df.columns else lower.index(n.lower()) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(lower))]).select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from the columns of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """docs with its columns renamed c0, c1 and so on, and two more: the row's id as a long, `row_id`, and `row_hash`,
    the MD5 of its text (null for null). toDF(*docs.columns) after dropping these gives docs back."""
    at = {n: docs.columns.index(n) if n in docs.columns else [c.lower() for c in docs.columns].index(n.lower()) for n in (id_col, text_col)}
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return out.withColumns({"row_id": F.col(f"c{at[id_col]}").cast("long"), "row_hash": text_hash(F.col(f"c{at[text_col]}"))}), f"c{at[id_col]}", f"c{at[text_col]}"


def text_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a session in one process that names none gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again, which cuts its lineage.

    The paths written go into `keep`, for dropped().
    """
    spark = df.sparkSession
    path = scratch(spark)
    # what a finished write has shuffled is of no more use
    was = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if was is None else spark.conf.set(_CLEAN, was)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that stored() wrote and nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    paths.clear()


def shared(spark: SparkSession, value) -> Broadcast:
    """value for all tasks, with the classes of this subpackage by value: a broadcast itself names them, and executors may not have them."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def taken(b: Broadcast):
    """What shared() was given; a task calls it once."""
    return pickle.loads(b.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
