"""Arithmetic of scalars as the collection API has it, and helpers for functions that run on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column, integers: bool = True) -> Column:
    """Integers divide downwards, exactly."""
    if not integers:
        return a / b
    rest = a % b
    return F.call_function("div", a, b) - F.when((rest != 0) & ((rest < 0) != (b < 0)), 1).otherwise(0)


def mod(a: Column, b: Column) -> Column:
    """The sign of the result is the divisor's."""
    rest = a % b
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


class LazyVar:
    """A value that each worker makes once, when it first needs it."""

    def __init__(self, make: Callable):
        self.make = make

    def __getstate__(self):
        return {"make": self.make}

    def get(self):
        if "value" not in self.__dict__:
            self.value = self.make()
        return self.value


class Counters:
    """Named counters that functions on executors increase; exact for actions, at least once for transformations."""

    def __init__(self, spark):
        self.context, self.each = spark.sparkContext, {}

    def of(self, name: str, group: str = "default"):
        """The accumulator of a name, or of a group and a name between which a vertical bar stands."""
        if "|" in name:
            group, name = name.split("|", 1)
        return self.each.setdefault((group, name), self.context.accumulator(0))

    def increase(self, name: str, by: int = 1) -> None:
        self.of(name).add(by)

    def values(self) -> dict:
        return {k: a.value for k, a in self.each.items()}

    def reset(self, name: str | None = None) -> None:
        """Begin anew from 0; functions that were given an accumulator before keep the old one."""
        group, _, own = name.rpartition("|") if name else ("", "", None)
        for k in [k for k in self.each if own is None or k == (group or "default", own)]:
            self.each[k] = self.context.accumulator(0)
