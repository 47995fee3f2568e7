"""Operators on records with named, typed fields.

Field lists are given as "a,b", a list or a tuple. Functions of fields take Columns by name (cols.a or cols["a"]) and give
a dict of Columns and constants; each(array) among them stands for several values, and several such give their product.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.core import Collection
from tessera.functions.opaque import Fields
from tessera.operators import relational as rel


class each:  # noqa: N801
    """Several values of a field: the elements of an array Column."""

    def __init__(self, array: Column):
        self.array = array


def names(fields: str | list | tuple) -> list[str]:
    return [f.strip() for f in fields.split(",")] if isinstance(fields, str) else list(fields)


def of(*fields: tuple[str, str] | str) -> StructType:
    """A record type: names with DDL types; a name alone is a string."""
    pairs = [(f, "string") if isinstance(f, str) else f for f in fields]
    return StructType.fromDDL(", ".join(f"{n} {t}" for n, t in pairs))


def describe(p: Collection) -> dict[str, str]:
    """The type of each field."""
    return {f.name: f.dataType.simpleString() for f in p.df.schema if f.name not in p.keys}


def as_schema(p: Collection, fields: StructType | str | dict) -> Collection:
    """The fields by place, with names and types. A value that its type can't hold is an error; a dict changes types by name."""
    if isinstance(fields, dict):
        return p._with(p.df.withColumns({n: F.col(n).cast(t) for n, t in fields.items()}))
    kind = fields if isinstance(fields, StructType) else StructType.fromDDL(fields)
    if len(kind) != len(p.fields):
        raise ValueError(f"{len(kind)} types are given for the fields {p.fields}")
    return p._with(p.df.select(*p.keys, *[F.col(n).cast(f.dataType).alias(f.name) for n, f in zip(p.fields, kind, strict=True)]))


def tuple_to_dict(p: Collection, fields: str | list | StructType) -> Collection:
    """Names (and types) for the fields of tuples: of columns by place, or of one struct column."""
    only = p.df.schema[p.fields[0]].dataType if len(p.fields) == 1 else None
    if isinstance(only, StructType):
        p = p._with(p.df.select(*p.keys, f"`{p.fields[0]}`.*"))
    if isinstance(fields, StructType):
        return as_schema(p, fields)
    wanted = [f if isinstance(f, str) else f[0] for f in names(fields)]
    if len(wanted) != len(p.fields):
        raise ValueError(f"{len(wanted)} names are given for {len(p.fields)} fields")
    out = p.df.select(*p.keys, *[F.col(a).alias(b) for a, b in zip(p.fields, wanted, strict=True)])
    types = {f[0]: f[1] for f in names(fields) if not isinstance(f, str)}
    return p._with(out.withColumns({n: F.col(n).cast(t) for n, t in types.items()}) if types else out)


def dict_to_tuple(p: Collection, fields: str | list | None = None, into: str = "value") -> Collection:
    """The fields, in the order given, as one struct of _0, _1 and so on."""
    if len(p.fields) == 1 and isinstance(p.df.schema[p.fields[0]].dataType, StructType):
        raise ValueError("the records are tuples already")
    return p._with(p.df.select(*p.keys, F.struct(*[F.col(f).alias(f"_{i}") for i, f in enumerate(names(fields or p.fields))]).alias(into)))


def _values(p: Collection, made: dict, keep: list[str]) -> Collection:
    """p with what a function of fields gave: Columns and constants at once, then several values one after another."""
    df = p.df.select(*p.keys, *keep, *[(v.array if isinstance(v, each) else v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in made.items()])
    for n in [n for n, v in made.items() if isinstance(v, each)]:
        df = df.withColumn(n, F.explode(n))
    return p._thinned(df) if any(isinstance(v, each) for v in made.values()) else p._with(df)


def _cols(p: Collection, fields: list[str] | None = None) -> Fields:
    return Fields({n: F.col(n) for n in fields or p.fields})


def _made(p: Collection, what: Callable | dict, sides: tuple) -> tuple[Collection, dict]:
    p, own = p._sided(sides)
    if callable(what):
        return p, what(_cols(p, [f for f in p.fields if f not in own]), *[F.col(s) for s in own])
    # a field's function takes that field alone, or as a tuple those that it names
    call = lambda n, v: v[0](*[F.col(x) for x in v[1:]]) if isinstance(v, tuple) else v(F.col(n)) if callable(v) and not isinstance(v, Column) else v
    return p, {n: call(n, v) for n, v in what.items()}


def select(p: Collection, what: str | list | tuple | dict | Callable, *sides) -> Collection:
    """Fields by name (those that are missing are null), by a dict, or by a function of all fields and side inputs."""
    if isinstance(what, str | list | tuple):
        return p._with(p.df.select(*p.keys, *[F.col(n) if n in p.df.columns else F.lit(None).cast("string").alias(n) for n in names(what)]))
    p, made = _made(p, what, sides)
    return _values(p, made, [])


def update(p: Collection, what: dict | Callable, *sides) -> Collection:
    """Fields replaced or added; the others stay."""
    keep = p.fields
    p, made = _made(p, what, sides)
    return _values(p, made, [f for f in keep if f not in made])


def agg(p: Collection, what: Callable, *sides) -> Collection:
    """One record for each group: a function of fields gives aggregates of them, each() of an aggregate for several values.

    All constants: a record of them for every record of p.
    """
    p._finite("agg")
    p, made = _made(p, what, sides)
    if not any(isinstance(v, Column | each) for v in made.values()):
        return p._with(p.df.select(*p.keys, *[F.lit(v).alias(n) for n, v in made.items()]))
    df = p.df.groupBy(*p.keys).agg(*[(v.array if isinstance(v, each) else v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in made.items()])
    for n in [n for n, v in made.items() if isinstance(v, each)]:
        df = df.withColumn(n, F.explode(n))
    return Collection(df, p.keys, p._kept())


def group_by(p: Collection, fields: str | list | tuple, kept: str | list | tuple | None = None) -> Collection:
    """By fields; of the others, those of `kept` stay (default all). A number stands for the field at that place."""
    by = [p.fields[f] if isinstance(f, int) else f for f in names(fields)]
    out = p.group_by(*by)
    return out if kept is None else out._with(out.df.select(*out.keys, *[k for k in names(kept) if k not in out.keys]))


def flatten(t: Collection) -> Collection:
    """Keys and fields as one record; what is no table stays as it is."""
    return t if not t.keys else Collection(t.df)


def cogroup(*ps: Collection, fields: str | list) -> rel.CoTable:
    return rel.cogroup(*ps, on=names(fields))


def join(*ps: Collection, fields: str | list, merge: bool = False, how: str = "inner") -> Collection:
    """merge: one record of both inputs' fields; else each input's record as a struct."""
    return rel.merge_join(*ps, on=names(fields), how=how) if merge else rel.record_join(*ps, on=names(fields), how=how)


def left_join(*ps: Collection, fields: str | list, merge: bool = False) -> Collection:
    return join(*ps, fields=fields, merge=merge, how="left")


def right_join(*ps: Collection, fields: str | list, merge: bool = False) -> Collection:
    return join(*ps, fields=fields, merge=merge, how="right")


def full_join(*ps: Collection, fields: str | list, merge: bool = False) -> Collection:
    return join(*ps, fields=fields, merge=merge, how="full")


def distinct(p: Collection, columns: str | list | None = None) -> Collection:
    """One record, any, for each value of the columns."""
    p._finite("distinct")
    return p.distinct() if columns is None else replace(p._with(p.df.dropDuplicates([*p.keys, *names(columns)])), universe=p.universe)


def _arrow(spec: str) -> tuple[list[str], list[str]]:
    left, arrow, right = spec.partition("=>")
    if not arrow:
        raise ValueError("the fields are given as 'taken => given'")
    return names(left), names(right)


def _placed(given: list[str], out) -> dict:
    out = out if isinstance(out, tuple | list) else (out,)
    if len(out) != len(given):
        raise ValueError(f"the function gave {len(out)} values for {given}")
    return dict(zip(given, out, strict=True))


def select_as(p: Collection, spec: str, fn: Callable, *sides) -> Collection:
    """select("a,b => c,d", fn): fn takes the Columns of a and b and gives those of c and d."""
    taken, given = _arrow(spec)
    return select(p, lambda cols, *s: _placed(given, fn(*[cols[t] for t in taken], *s)), *sides)


def agg_as(p: Collection, spec: str, fn: Callable, *sides) -> Collection:
    taken, given = _arrow(spec)
    return agg(p, lambda cols, *s: _placed(given, fn(*[cols[t] for t in taken], *s)), *sides)


def typed(p: Collection) -> list[StructField]:
    return [f for f in p.df.schema if f.name not in p.keys]
