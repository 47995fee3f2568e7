"""Targets for write(): one call for every sink."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.core import Collection
from tessera.sources import text, user


@dataclass
class TextTarget:
    """A line for each record: its one field, or its fields separated."""

    path: str
    overwrite: bool = True
    separator: str = "\t"
    columns: list[str] | None = None
    options: dict = field(default_factory=dict)

    def with_compression(self, kind: str = "gzip") -> TextTarget:
        if kind != "gzip":
            raise ValueError("gzip is the one compression of text output")
        self.options["gzip"] = True
        return self

    def sort(self, reverse: bool = False) -> TextTarget:
        self.options["sort"] = reverse
        return self

    def sort_by(self, *by: Column) -> TextTarget:
        self.options["sort_by"] = list(by)
        return self

    def partition(self, n: int, partition_id: Column | None = None) -> TextTarget:
        self.options |= {"partitions": n, "partition_id": partition_id}
        return self


@dataclass
class SequenceTarget:
    path: str
    key: str = "key"
    value: str = "value"


def write(c: Collection, target: TextTarget | SequenceTarget | user.Sink) -> None:
    """Write a collection: to lines or fields, to a sequence file, or to a user's sink."""
    if isinstance(target, user.Sink):
        user.write_user(c, target)
    elif isinstance(target, SequenceTarget):
        text.write_sequence(c, target.path, target.key, target.value)
    else:
        options, names = dict(target.options), target.columns or c.fields
        if "sort" in options:
            down = options.pop("sort")
            options["sort_by"] = [F.desc(n) if down else F.asc(n) for n in names]
        text.write_lines(c, target.path, text.joined_fields(names, target.separator), overwrite=target.overwrite, **options)
