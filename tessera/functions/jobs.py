"""What surrounds a run: files for executors, hooks, and errors of user functions."""

from __future__ import annotations

import builtins
import re
from collections.abc import Callable
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def add_file(spark: SparkSession, path: str) -> None:
    """A file that executors find by pyspark.SparkFiles.get(name)."""
    spark.sparkContext.addFile(path)


def add_directory(spark: SparkSession, path: str) -> None:
    spark.sparkContext.addFile(path, recursive=True)


def add_python(spark: SparkSession, path: str) -> None:
    """A module, or an archive of modules, that functions on executors can import."""
    spark.sparkContext.addPyFile(path)


def add_archive(spark: SparkSession, path: str) -> None:
    """An archive that is unpacked on executors."""
    spark.sparkContext.addArchive(path)


class Hooks:
    """Functions to be called by name order before and after a run on the driver."""

    def __init__(self):
        self.before: dict[str, Callable] = {}
        self.after: dict[str, Callable] = {}

    @contextmanager
    def run(self):
        for _, fn in sorted(self.before.items()):
            fn()
        try:
            yield
        finally:
            for _, fn in sorted(self.after.items()):
                fn()


@contextmanager
def own_errors():
    """An exception of a user's function is raised again with its type, if that is a built-in one; the job's failure is its cause."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as error:
        # the message of a failed task ends with the worker's traceback
        for name, text in reversed(re.findall(r"^(?:pyspark\.errors\.[\w.]+: )?([A-Z]\w+): (.*)$", str(error), re.M)):
            kind = getattr(builtins, name, None)
            if isinstance(kind, type) and issubclass(kind, Exception):
                raise kind(text) from error
        raise
