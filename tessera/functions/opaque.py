"""Python functions over records, in Arrow batches on executors.

A record of one field is its value; of several, a Row. A result is a value for one field that is
declared, and a tuple, Row or dict for several.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The state of a reduction that has seen nothing.
NOTHING = "\0nothing"
#: Groups whose states a task holds before it passes them on.
HELD = 50_000


class Fields(dict):
    """Columns by name, as attributes, and by place."""

    def __getattr__(self, name: str):
        try:
            return self[name]
        except KeyError as error:
            raise AttributeError(name) from error

    def __getitem__(self, at):
        return list(self.values())[at] if isinstance(at, int) else super().__getitem__(at)


def kinds(df: DataFrame, keys: list[str], returns: str) -> StructType:
    """The schema of the keys and of the declared fields."""
    return StructType([df.schema[k] for k in keys] + list(StructType.fromDDL(returns)))


def _records(b: pa.RecordBatch, fields: list[str]) -> list:
    columns = [b.column(b.schema.names.index(f)).to_pylist() for f in fields]
    if len(fields) == 1:
        return columns[0]
    make = Row(*fields)
    return [make(*x) for x in zip(*columns, strict=True)]


def _values(result, names: list[str]) -> list:
    if isinstance(result, dict):
        return [result.get(n) for n in names]
    if len(names) == 1 and not (isinstance(result, tuple) and len(result) == 1):
        return [result]
    return list(result)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def mapped(df: DataFrame, keys: list[str], fields: list[str], sides: list[str], fn: Callable, returns: str, many: bool) -> DataFrame:
    schema = kinds(df, keys, returns)
    arrow, names = _arrow(schema), [f.name for f in StructType.fromDDL(returns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [b.column(b.schema.names.index(k)).to_pylist() for k in keys]
            side = [b.column(b.schema.names.index(s)).to_pylist() for s in sides]
            out = []
            for i, x in enumerate(_records(b, fields)):
                got = fn(x, *[s[i] for s in side])
                if many and got is None:
                    raise ValueError("flat_map's function gave None, not an iterable")
                out += [[*[k[i] for k in own], *_values(y, names)] for y in (got if many else (got,))]
                if len(out) > 10_000:
                    yield _batch(out, arrow)
                    out = []
            if out:
                yield _batch(out, arrow)

    return df.mapInArrow(run, schema)


def filtered(df: DataFrame, fields: list[str], sides: list[str], fn: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side = [b.column(b.schema.names.index(s)).to_pylist() for s in sides]
            yield b.filter(pa.array([bool(fn(x, *[s[i] for s in side])) for i, x in enumerate(_records(b, fields))], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _partial(keys: list[str], fields: list[str], make: Callable, step: Callable, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, object] = {}

        def flush():
            return _batch([[*k, pickle.dumps(s)] for k, s in states.items()], arrow)

        for b in batches:
            own = list(zip(*[b.column(b.schema.names.index(k)).to_pylist() for k in keys], strict=True)) if keys else [()] * b.num_rows
            for k, x in zip(own, _records(b, fields), strict=True):
                states[k] = step(states[k] if k in states else make(), x)
            if len(states) > HELD:
                yield flush()
                states.clear()
        if states:
            yield flush()

    return run


def folded(df: DataFrame, keys: list[str], fields: list[str], make: Callable, step: Callable, combine: Callable, returns: str) -> DataFrame:
    """A state for each group: partial ones in each task, then combined. States travel pickled."""
    schema = kinds(df, keys, returns)
    arrow, names = _arrow(schema), [f.name for f in StructType.fromDDL(returns)]
    between = StructType([*[df.schema[k] for k in keys], *StructType.fromDDL("__state binary")])
    partial = df.mapInArrow(_partial(keys, fields, make, step, _arrow(between)), between)

    def final(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        state = None
        for i, s in enumerate(t.column("__state")):
            x = pickle.loads(s.as_py())
            state = x if i == 0 else combine(state, x)
        return pa.Table.from_batches([_batch([[*[k.as_py() for k in key][: len(keys)], *_values(state, names)]], arrow)])

    by = [F.col(k) for k in keys] or [F.lit("all")]
    return partial.groupBy(*by).applyInArrow(final, schema)


def combined(df: DataFrame, keys: list[str], fields: list[str], fn: Callable, returns: str, pre_combine: bool) -> DataFrame:
    """fn over a task's values of a group, at most 10,000 at a time, and over the results; or over all of a group's values, which then are held together."""
    if not pre_combine:
        return _whole(df, keys, fields, fn, returns)

    def step(state, x):
        state.append(x)
        return [fn(state)] if len(state) >= 10_000 else state

    schema = kinds(df, keys, returns)
    arrow, names = _arrow(schema), [f.name for f in StructType.fromDDL(returns)]
    between = StructType([*[df.schema[k] for k in keys], *StructType.fromDDL("__state binary")])
    partial = df.mapInArrow(_partial(keys, fields, list, step, _arrow(between)), between)

    def final(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        got = fn([fn(pickle.loads(s.as_py())) for s in t.column("__state")])
        return pa.Table.from_batches([_batch([[*[k.as_py() for k in key][: len(keys)], *_values(got, names)]], arrow)])

    return partial.groupBy(*([F.col(k) for k in keys] or [F.lit("all")])).applyInArrow(final, schema)


def _whole(df: DataFrame, keys: list[str], fields: list[str], fn: Callable, returns: str) -> DataFrame:
    schema = kinds(df, keys, returns)
    arrow, names = _arrow(schema), [f.name for f in StructType.fromDDL(returns)]

    def final(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        got = fn([x for b in t.to_batches() for x in _records(b, fields)])
        return pa.Table.from_batches([_batch([[*[k.as_py() for k in key][: len(keys)], *_values(got, names)]], arrow)])

    return df.groupBy(*([F.col(k) for k in keys] or [F.lit("all")])).applyInArrow(final, schema)


def streamed(df: DataFrame, keys: list[str], fields: list[str], begin: Callable, each: Callable, end: Callable, returns: str) -> DataFrame:
    """Rows of a partition in order, where those of a group follow one another: begin(emit), each(state, emit, record), end(state, emit)."""
    schema = kinds(df, keys, returns)
    arrow, names = _arrow(schema), [f.name for f in StructType.fromDDL(returns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, state = [], None, None
        emit = lambda y: out.append([*now, *_values(y, names)])
        for b in batches:
            own = list(zip(*[b.column(b.schema.names.index(k)).to_pylist() for k in keys], strict=True)) if keys else [()] * b.num_rows
            for k, x in zip(own, _records(b, fields), strict=True):
                if now is None or k != now:
                    if now is not None:
                        end(state, emit)
                    now = k
                    state = begin(emit)
                state = each(state, emit, x)
                if len(out) > 10_000:
                    yield _batch(out, arrow)
                    out.clear()
        if now is None and not keys:
            now = ()
            state = begin(emit)
        if now is not None:
            end(state, emit)
        if out:
            yield _batch(out, arrow)

    return df.mapInArrow(run, schema)
