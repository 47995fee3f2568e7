"""Collections, scalars and tables of groups, as lazily built Spark plans.

A Collection is a DataFrame whose columns are the record's fields, with zero or
more key columns in front. Grouping only adds key columns: every operator then works
inside each group, so a function written for a whole collection runs unchanged under
apply_values, at any depth. Groups that an operator empties are kept in `universe`,
which costs nothing until a count or another aggregate with a zero asks for it.

Functions come in three tiers. Columns, and functions that can be called with Columns, are planned by
Catalyst. Some known callables (operator.add, max, min, sum, len) have built-in aggregates. Any other
function needs `returns`, a DDL string of its result's fields; it runs on Arrow batches in Python workers.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce as fold

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, StringType, StructType

from tessera.functions import opaque
from tessera.functions.scalars import div, mod


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


class ASC:
    """A sort key, ascending."""

    down = False

    def __init__(self, by: str | Column):
        self.by = by


class DESC(ASC):
    """A sort key, descending."""

    down = True


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null keys are equal. The key columns of the result are the left's, or for a full join either's.
    Without keys each row meets each."""
    if not keys:
        return left.join(right, F.lit(True), "left" if how == "left" else "inner") if how in ("left", "inner") else left.crossJoin(right)
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    out = left.join(r, fold(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]), how)
    if how in ("left_semi", "left_anti"):
        return out
    if how == "full":
        out = out.withColumns({k: F.coalesce(k, f"__r_{k}") for k in keys})
    return out.drop(*[f"__r_{k}" for k in keys])


@dataclass(frozen=True)
class Collection:
    df: DataFrame
    keys: tuple[str, ...] = ()
    #: All groups there are, where df may lack some; None: those of df.
    universe: DataFrame | None = None
    order: tuple = ()
    #: What a filter under keys was applied to, and its condition, so that a count after it needs one pass.
    raw: tuple[DataFrame, Column] | None = None
    #: Universe of the outer levels of a nested table.
    outer: DataFrame | None = None
    #: Of a scalar: what it is an aggregate of, and steps (names, function of a frame and a window) that make it beside those records.
    origin: tuple[DataFrame, tuple] | None = None

    # guards
    def __reduce__(self):
        raise TypeError("a collection cannot be captured by a function; pass it as a side input")

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys]

    @property
    def _only(self) -> str:
        if len(self.fields) != 1:
            raise ValueError(f"this needs one field, or the name of one of {self.fields}")
        return self.fields[0]

    def _finite(self, what: str) -> None:
        if self.df.isStreaming:
            raise ValueError(f"{what} needs a finite input")

    def _with(self, df: DataFrame, order: tuple = ()) -> Collection:
        return replace(self, df=df, order=order, raw=None, origin=None)

    def _kept(self) -> DataFrame | None:
        """The groups, to keep those that an operator may empty."""
        return None if not self.keys else self.universe if self.universe is not None else self.df.select(*self.keys).distinct()

    def _thinned(self, df: DataFrame) -> Collection:
        return replace(self._with(df), universe=self._kept())

    def _plain(self, fields: dict[str, object]) -> list[Column]:
        return [col(v).alias(n) if isinstance(v, str | Column) else F.lit(v).alias(n) for n, v in fields.items()]

    # record-wise
    def _traced(self, fn: Callable, sides: tuple) -> dict[str, object]:
        """The Columns that fn gives for this collection's fields, as fields of the result."""
        names = self.fields
        record = F.col(names[0]) if len(names) == 1 else opaque.Fields({n: F.col(n) for n in names})
        try:
            out = fn(record, *[F.col(s) for s in sides])
        except (PySparkException, TypeError, AttributeError) as error:
            raise TypeError("the function can't be called with Columns; say what it `returns`, and it runs as Python") from error
        return out if isinstance(out, dict) else {f"_{i}": v for i, v in enumerate(out)} if isinstance(out, tuple | list) else {"value": out}

    def _sided(self, sides: tuple) -> tuple[Collection, list[str]]:
        """This with a column for each side input: a scalar's value, or a collection as an array."""
        out, names = self, []
        for i, side in enumerate(sides):
            one = side if isinstance(side, Scalar) else side.to_list() if isinstance(side, Collection) else None
            names.append(f"__side{i}")
            if one is None:
                out = out._with(out.df.withColumn(names[-1], F.lit(side)), out.order)
            else:
                out = replace(out, df=same(out.df, one.df.select(*[k for k in one.keys if k in self.keys], F.col(one._only).alias(names[-1])), [k for k in self.keys if k in one.keys], "left"), raw=None)
        return out, names

    def map(self, fn: Callable | None = None, *sides, returns: str | None = None, **fields) -> Collection:
        """map(name=Column, ...), or map(fn, *side_inputs), where fn takes a record (of one field: its value)."""
        if fn is None:
            return self._with(self.df.select(*self.keys, *self._plain(fields)))
        of, names = self._sided(sides)
        if returns is None:
            return self._with(of.df.select(*self.keys, *self._plain(self._traced(fn, names))))
        return self._with(opaque.mapped(of.df, list(self.keys), self.fields, names, fn, returns, many=False))

    select = map

    def update(self, **fields) -> Collection:
        return self._with(self.df.withColumns({n: col(c) if isinstance(c, str | Column) else F.lit(c) for n, c in fields.items()}))

    def flat_map(self, into: str | Callable, values: Column | None = None, *sides, returns: str | None = None, keep: bool = False) -> Collection:
        """flat_map(name, array Column), or flat_map(fn, None, *side_inputs, returns=...): fn gives an iterable of records.
        With `keep` the other fields stay beside the new one."""
        if callable(into):
            of, names = self._sided(sides)
            if returns is not None:
                return self._thinned(opaque.mapped(of.df, list(self.keys), self.fields, names, into, returns, many=True))
            traced = self._traced(into, names)
            if len(traced) != 1:
                raise ValueError("a traced flat_map gives one array")
            return self._thinned(of.df.select(*self.keys, F.explode(next(iter(traced.values()))).alias(next(iter(traced)))))
        rest = [c for c in self.fields if c != into] if keep else []
        return self._thinned(self.df.select(*self.keys, *rest, F.explode(values).alias(into)))

    def filter(self, condition: Column | str | Callable, *sides, opaquely: bool = False) -> Collection:
        """By a Column, a SQL string or a function (of a record and side inputs); opaquely: the function runs as Python."""
        if callable(condition) and not isinstance(condition, Column):
            of, names = self._sided(sides)
            if opaquely:
                return self._thinned(opaque.filtered(of.df, self.fields, names, condition).drop(*names))
            kept = next(iter(of._traced_over(self.fields, condition, names).values()))
            return self._thinned(of.df.where(kept).drop(*names))
        condition = F.expr(condition) if isinstance(condition, str) else condition
        raw = None
        if self.keys and self.raw is not None:
            raw = (self.raw[0], self.raw[1] & condition)
        elif self.keys and self.universe is None:
            raw = (self.df, condition)
        return replace(self._thinned(self.df.where(condition)), raw=raw)

    def _traced_over(self, names: list[str], fn: Callable, sides: list[str]) -> dict:
        return replace(self, df=self.df.select(*self.keys, *names))._traced(fn, tuple(sides))

    def foreach(self, fn: Callable) -> None:
        """fn for each record, for its side effects; a task that is tried again calls it again."""
        names, one = self.fields, len(self.fields) == 1
        self.df.select(*names).foreachPartition(lambda rows: [fn(r[0] if one else r) for r in rows] and None)

    def apply(self, fn: Callable, *args):
        return fn(self, *args)

    def with_side(self, scalar: Collection) -> Collection:
        """A scalar's fields beside each record: of the same group, or the one value there is."""
        shared = [k for k in self.keys if k in scalar.keys]
        side = scalar.df if shared or isinstance(scalar, Scalar) else scalar.df.limit(1)  # one row, whatever the side holds
        return replace(self, df=same(self.df, side, shared, "left"), universe=self._kept(), raw=None)

    def as_scalar(self) -> Scalar:
        """This collection of one record (of which any one counts) as a scalar."""
        one = self if isinstance(self, Scalar) else self.take(1)
        return Scalar(one.df, self.keys, self.universe)

    as_pobject = as_scalar

    def as_collection(self) -> Collection:
        return Collection(self.df, self.keys, self.universe, self.order)

    as_pcollection = as_collection

    # grouping
    def group_by(self, *keys: str, value: Callable | None = None, **computed) -> Collection:
        """By fields, or by computed ones (name=Column, or name=function of a record); `value` maps the records."""
        df = self.df
        for name, how in computed.items():
            df = df.withColumn(name, next(iter(self._traced(how, ()).values())) if callable(how) and not isinstance(how, Column) else col(how))
        out = replace(self, df=df, keys=self.keys + keys + tuple(computed), universe=None, raw=None, outer=self.universe if self.universe is not None else self.outer)
        return out if value is None else out.map(value)

    def group_by_key(self) -> Collection:
        """Records of exactly two fields, key and value."""
        if len(self.fields) != 2:
            raise ValueError(f"records must have two fields, not {self.fields}")
        return self.group_by(self.fields[0])

    def group_by_every_record(self, into: str = "record_id") -> Collection:
        return self._with(self.df.withColumn(into, F.monotonically_increasing_id())).group_by(into)

    def apply_values(self, fn: Callable, *args) -> Collection:
        """fn inside each group. A whole collection among args is there in every group, as a collection; tables can't be side inputs."""
        return fn(self, *[self._in_scope(a) for a in args])

    def apply_key_values(self, fn: Callable, *args) -> Collection:
        """fn(key, values, *args); key is a scalar that has the innermost key."""
        name = self.keys[-1]
        key = Scalar(self._kept().withColumn("key", F.col(name)), self.keys)
        return fn(key, self, *[self._in_scope(a) for a in args])

    def _in_scope(self, side):
        if not isinstance(side, Collection) or isinstance(side, Scalar) and not side.keys:
            return side
        if isinstance(side, Scalar):
            return side
        if side.keys:
            raise ValueError("a table of groups cannot be a side input")
        return Collection(self._kept().crossJoin(side.df), self.keys, self._kept())

    def ungroup(self) -> Collection:
        """The innermost key becomes a field again."""
        return replace(self._with(self.df), keys=self.keys[:-1], universe=self.outer if self.keys[:-1] else None, outer=None)

    def flatten(self) -> DataFrame:
        return self.df

    def extract_keys(self, depth: int = 1) -> DataFrame:
        return (self.universe if self.universe is not None else self.df).select(*self.keys[:depth]).distinct()

    def flatten_values(self) -> Collection:
        return Collection(self.df.select(*self.fields))

    extract_values = flatten_values

    @property
    def nested_level(self) -> int:
        return len(self.keys)

    @property
    def inner_most_type(self) -> type:
        return type(self)

    def to_list(self, into: str = "list") -> Scalar:
        """The records of a group (of one field: its values) as an array, nulls too, in the order of a sort before it."""
        self._finite("to_list")
        out = self._listed(F.struct(*self.fields) if len(self.fields) != 1 else F.col(self.fields[0]), into)
        return Scalar(self._zeroed(out, {into: F.array().cast(out.schema[into].dataType)}), self.keys)

    def _listed(self, record: Column, into: str) -> DataFrame:
        """An array of the records of each group, in the order of a sort before it."""
        df, ranks = self.df, [col(c).alias(f"__o{i}") for i, (c, _) in enumerate(self.order)]
        if any(down for _, down in self.order):
            df, ranks = df.withColumn("__rn", F.row_number().over(self._window())), [F.col("__rn")]
        every = F.collect_list(F.struct(*ranks, record.alias("v")))
        return df.groupBy(*self.keys).agg(F.transform(F.array_sort(every) if ranks else every, lambda x: x["v"]).alias(into))

    to_list_pobject = to_list

    def to_dict(self, into: str = "dict") -> Scalar:
        """A nested map from the keys, level by level, to the innermost scalar or list."""
        if not self.keys:
            return self.to_list(into)
        one = self if isinstance(self, Scalar) else self.to_list("__v")
        df, name = one.df, one._only
        for k in range(len(self.keys) - 1, -1, -1):
            df = df.groupBy(*self.keys[:k]).agg(F.map_from_entries(F.collect_list(F.struct(self.keys[k], F.col(name)))).alias("__m"))
            name = "__m"
        return Scalar(df.select(F.col(name).alias(into)))

    to_pobject = to_dict

    # aggregates
    def _zeroed(self, out: DataFrame, zeros: dict[str, Column]) -> DataFrame:
        """out with rows of zeros for groups of the universe that it lacks."""
        if not self.keys or self.universe is None:
            return out
        out = same(self.universe.select(*self.keys), out.withColumn("__there", F.lit(True)), list(self.keys), "left")
        return out.withColumns({n: F.when(F.col("__there"), F.col(n)).otherwise(z) for n, z in zeros.items()}).drop("__there")

    def agg(self, **fields: Column) -> Collection:
        self._finite("agg")
        return Collection(self.df.groupBy(*self.keys).agg(*[c.alias(n) for n, c in fields.items()]), self.keys, self.universe)

    def count(self, into: str = "count") -> Scalar:
        """0 for groups and collections that are empty."""
        self._finite("count")
        if self.raw is not None:
            return Scalar(self.raw[0].groupBy(*self.keys).agg(F.count_if(self.raw[1]).alias(into)), self.keys)
        step = ((into,), lambda df, w: df.withColumn(into, F.count(F.lit(1)).over(w)))
        out = self._zeroed(self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias(into)), {into: F.lit(0).cast("long")})
        return Scalar(out, self.keys, origin=(self.df, (step,)) if self.keys else None)

    def _reduced(self, made: Column, name: str) -> Scalar:
        """An aggregate that gives nothing for nothing."""
        self._finite("an aggregate")
        if self.keys:
            return Scalar(self.df.groupBy(*self.keys).agg(made.alias(name)), self.keys, self.universe)
        return Scalar(self.df.agg(made.alias(name), F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n"))

    def sum(self, field: str | None = None, into: str | None = None) -> Scalar:
        """Numbers are added, strings and arrays joined (in the order of a sort before)."""
        field = field or self._only
        kind = self.df.schema[field].dataType
        if isinstance(kind, StringType | ArrayType):
            self._finite("sum")
            out = self._listed(F.col(field), "__p").where(F.size("__p") > 0)
            joined = F.array_join("__p", "") if isinstance(kind, StringType) else F.flatten("__p")
            return Scalar(out.select(*self.keys, joined.alias(into or field)), self.keys, self.universe)
        return self._reduced(F.sum(field), into or field)

    def max(self, field: str | None = None, into: str | None = None, by: str | Column | None = None) -> Scalar:
        """Of ties (by a key) any one."""
        field = field or self._only
        return self._reduced(F.max(field) if by is None else F.max_by(field, col(by)), into or field)

    def min(self, field: str | None = None, into: str | None = None, by: str | Column | None = None) -> Scalar:
        field = field or self._only
        return self._reduced(F.min(field) if by is None else F.min_by(field, col(by)), into or field)

    def floor_avg(self, field: str, into: str) -> Scalar:
        """The quotient of integers, rounded down."""
        self._finite("avg")
        whole = isinstance(self.df.schema[field].dataType, IntegralType)
        return self._reduced(div(F.sum(field), F.count(field)) if whole else F.floor(F.sum(field) / F.count(field)), into)

    def rollup(self, *by: str, **fields: Column) -> Collection:
        """The same aggregates for every leading part of the keys `by`, within the groups there are; null stands for all."""
        self._finite("rollup")
        if not self.keys:
            return Collection(self.df.rollup(*by).agg(*[c.alias(n) for n, c in fields.items()]))
        sets = [[*self.keys, *by[:k]] for k in range(len(by) + 1)]
        return Collection(self.df.groupingSets(sets, *self.keys, *by).agg(*[c.alias(n) for n, c in fields.items()]), self.keys, self.universe)

    def distinct(self) -> Collection:
        self._finite("distinct")
        return replace(self._with(self.df.distinct()), universe=self.universe)

    def distinct_count(self, field: str | None = None, into: str = "count") -> Scalar:
        """Null counts as a value."""
        self._finite("distinct_count")
        field = field or self._only
        out = self.agg(**{into: F.count_distinct(field) + F.coalesce(F.max(F.col(field).isNull().cast("int")), F.lit(0))})
        return Scalar(self._zeroed(out.df, {into: F.lit(0).cast("long")}), self.keys)

    def first(self) -> Collection:
        return self.take(1)

    def is_empty(self, into: str = "empty") -> Scalar:
        c = self.count("__c")
        return Scalar(c.df.select(*self.keys, (F.col("__c") == 0).alias(into)), self.keys)

    def fold(self, zero: Column, step: Callable, into: str, values: Column) -> Collection:
        """Sequential accumulation of Columns in the order of a sort before it; the values of a group are held together."""
        self._finite("fold")
        rank = F.struct(*[c for c, _ in self._ranks()], values.alias("__v")) if self.order else F.struct(values.alias("__v"))
        out = F.aggregate(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["__v"]), zero, step)
        return self.agg(**{into: out})

    def _ranks(self) -> list[tuple[Column, bool]]:
        if any(desc for _, desc in self.order):
            raise ValueError("fold takes an ascending order")
        return [(col(c).alias(f"__o{i}"), d) for i, (c, d) in enumerate(self.order)]

    def aggregate(self, zero, step: Callable, combine: Callable, returns: str) -> Scalar:
        """Python: step(state, record) in each partition, combine(state, state) across them; the zero for what is empty.
        zero may be a function that makes it."""
        self._finite("aggregate")
        out = opaque.folded(self.df, list(self.keys), self.fields, lambda: zero() if callable(zero) else zero, step, combine, returns)
        made, names = zero() if callable(zero) else zero, [f.name for f in StructType.fromDDL(returns)]
        zeros = dict(zip(names, made if isinstance(made, tuple) else (made,), strict=True))
        types = {f.name: f.dataType for f in out.schema}
        literal = {n: F.lit(z).cast(types[n]) for n, z in zeros.items()}
        if self.keys:
            return Scalar(self._zeroed(out, literal), self.keys)
        there = out.sparkSession.range(1).select().join(out.withColumn("__there", F.lit(True)), F.lit(True), "left")
        return Scalar(there.select(*[F.when(F.col("__there"), F.col(n)).otherwise(z).alias(n) for n, z in literal.items()]))

    def reduce(self, fn: Callable, field: str | None = None, returns: str | None = None) -> Scalar:
        """fn(value, value), in each partition and then across them; nothing for nothing. operator.add, max and min are built in."""
        known = {operator.add: self.sum, max: self.max, min: self.min}
        if returns is None:
            if fn not in known:
                raise TypeError("say what the function `returns`, and it runs as Python")
            return known[fn](field)
        self._finite("reduce")
        of = self if field is None else self.map(**{field: field})
        some = lambda a, b: b if a is opaque.NOTHING else a if b is opaque.NOTHING else fn(a, b)
        return Scalar(opaque.folded(of.df, list(of.keys), of.fields, lambda: opaque.NOTHING, some, some, returns), self.keys, self.universe)

    def combine(self, fn: Callable, returns: str | None = None, pre_combine: bool = True) -> Scalar:
        """fn(values), of an iterable: in each partition and then over the results, or once over a whole group. sum, max, min and len are built in."""
        known = {sum: self.sum, max: self.max, min: self.min, len: self.count}
        if returns is None:
            if fn not in known:
                raise TypeError("say what the function `returns`, and it runs as Python")
            return known[fn]()
        self._finite("combine")
        return Scalar(opaque.combined(self.df, list(self.keys), self.fields, fn, returns, pre_combine), self.keys, self.universe)

    def accumulate(self, zero, step: Callable, returns: str) -> Scalar:
        """Python: step(state, record) over a group's records in the order of a sort before it, one after another."""
        self._finite("accumulate")
        make = zero if callable(zero) else lambda: zero
        out = self._in_order(lambda emit: make(), lambda state, emit, x: step(state, x), lambda state, emit: emit(state), returns)
        return Scalar(out.df, self.keys, self.universe)

    # order
    def sort_by(self, *by: str | Column | ASC, reverse: bool = False) -> Collection:
        """Global order without keys; under keys the order that take, fold and running use. ASC(x) and DESC(x) mix; reverse turns all."""
        self._finite("sort")
        order = tuple((c.by, c.down != reverse) if isinstance(c, ASC) else (c, reverse) for c in by)
        df = self.df if self.keys else self.df.orderBy(*[col(c).desc() if d else col(c).asc() for c, d in order])
        return replace(self, df=df, order=order, raw=None)

    def sort(self, reverse: bool = False) -> Collection:
        """By all fields, one after another."""
        return self.sort_by(*self.fields, reverse=reverse)

    def _window(self):
        by = [col(c).desc() if d else col(c).asc() for c, d in self.order] or [F.lit(0)]
        return Window.partitionBy(*self.keys).orderBy(*by)

    def take(self, n: int | Collection) -> Collection:
        self._finite("take")
        if isinstance(n, int) and not self.keys:
            return self._with(self.df.limit(n))
        if isinstance(n, int):
            ranked = self.df.withColumn("__rn", F.row_number().over(self._window())).where(F.col("__rn") <= n)
            return replace(self._with(ranked.drop("__rn")), universe=self.universe)
        size = n._only
        if n.origin is not None and n.origin[0] is self.df and n.keys == self.keys and not {x for names, _ in n.origin[1] for x in names} & set(self.df.columns):
            # an aggregate of the same groups: one sort gives it beside the ranks
            whole, df = self._window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), self.df
            for _, step in n.origin[1]:
                df = step(df, whole)
            ranked = df.withColumn("__rn", F.row_number().over(self._window())).where(F.col("__rn") <= F.col(size))
            return self._thinned(ranked.select(*self.df.columns))
        ranked = self.with_side(n.map(__n=F.col(size))).df.withColumn("__rn", F.row_number().over(self._window())).where(F.col("__rn") <= F.col("__n"))
        return self._thinned(ranked.drop("__rn", "__n"))

    def top(self, n: int | Collection, *by: str, reverse: bool = True) -> Collection:
        """The n greatest (or least) records, by a bounded heap in each partition first; n may be a scalar."""
        self._finite("top")
        order = [F.desc(b) if reverse else F.asc(b) for b in by or self.fields]
        if not isinstance(n, int):
            return self.sort_by(*(by or self.fields), reverse=reverse).take(n)
        if not self.keys:
            return self._with(self.df.orderBy(*order).limit(n))
        w = Window.partitionBy(*self.keys).orderBy(*order)
        return replace(self._with(self.df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")), universe=self.universe)

    max_elements = top

    def min_elements(self, n: int | Collection, *by: str) -> Collection:
        return self.top(n, *by, reverse=False)

    def running(self, **fields: Column) -> Collection:
        """Running aggregates over the order of a sort before it; without keys all records go through one task."""
        self._finite("running")
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self._with(self.df.withColumns({n: c.over(w) for n, c in fields.items()}))

    def _in_order(self, begin: Callable, each: Callable, end: Callable, returns: str) -> Collection:
        """Rows of a group stream through one task in order, so no group is held; without keys all rows do."""
        by = [col(c).desc() if d else col(c).asc() for c, d in self.order]
        df = self.df.repartition(*self.keys) if self.keys else self.df.repartition(1)
        df = df.sortWithinPartitions(*self.keys, *by) if self.keys or by else df
        return self._thinned(opaque.streamed(df, list(self.keys), self.fields, begin, each, end, returns))

    def transform(self, *how, returns: str | None = None) -> Collection:
        """Stateful code over each group's records, in the order of a sort before it.

        transform(begin, step, finish, returns=...): begin(emit) gives a state, step(state, emit, record) the next one,
        finish(state, emit) ends; emit(record) puts out. transform(Transformer(), returns=...): an object whose begin_process(),
        process(record) and end_process() give iterables. transform(fn, schema): fn takes and gives a pandas frame of one whole group.
        """
        self._finite("transform")
        if len(how) == 1 and isinstance(how[0], Transformer):
            make = how[0]

            def begin(emit):
                import copy

                own = copy.deepcopy(make)
                for x in own.begin_process():
                    emit(x)
                return own

            def each(own, emit, x):
                for y in own.process(x):
                    emit(y)
                return own

            def end(own, emit):
                for y in own.end_process():
                    emit(y)

            return self._in_order(begin, each, end, returns)
        if len(how) == 3:
            return self._in_order(*how, returns)
        fn, schema = how
        if not self.keys:
            raise ValueError("transform with a frame works inside groups")
        by = [c for c, _ in self.order]
        asc = [not d for _, d in self.order]
        run = (lambda pdf: fn(pdf.sort_values(by, ascending=asc))) if by else fn
        return self._with(self.df.groupBy(*self.keys).applyInPandas(run, schema))

    # actions
    def get(self, nested: bool = False):
        """The rows; nested: a list of records, under keys in a dict for each level."""
        rows = self.df.collect()
        if not nested:
            return rows
        fields = self.fields
        value = lambda r: r[fields[0]] if len(fields) == 1 else tuple(r[f] for f in fields)
        if not self.keys:
            return [value(r) for r in rows]
        out: dict = {}
        every = [] if self.universe is None else self.universe.select(*self.keys).collect()
        for r in [*every, *rows]:
            at = out
            for k in self.keys[:-1]:
                at = at.setdefault(r[k], {})
            own = at.setdefault(r[self.keys[-1]], [])
            if len(r) > len(self.keys):
                own.append(value(r))
        return out

    def cache(self) -> Collection:
        return replace(self._with(self.df.persist(), self.order), universe=self.universe)


class Transformer:
    """Base of objects for transform()."""

    def begin_process(self) -> Iterable:
        return ()

    def process(self, record) -> Iterable:
        return ()

    def end_process(self) -> Iterable:
        return ()


class Scalar(Collection):
    """One record for each group, or one in all; of one field, it takes part in arithmetic and comparisons.

    The operand of a scalar may be a constant or another scalar: of the same groups, or of none.
    """

    def _with(self, df: DataFrame, order: tuple = ()) -> Collection:
        return Collection(df, self.keys, self.universe, order, None, self.outer)

    def map(self, fn: Callable | None = None, *sides, returns: str | None = None, **fields) -> Scalar:
        out = super().map(fn, *sides, returns=returns, **fields)
        origin = None
        if fn is None and self.origin is not None:
            plain = self._plain(fields)
            origin = (self.origin[0], (*self.origin[1], (tuple(fields), lambda df, w: df.withColumns(dict(zip(fields, plain, strict=True))))))
        return Scalar(out.df, self.keys, self.universe, origin=origin)

    select = map

    @property
    def kind(self) -> DataType:
        return self.df.schema[self._only].dataType

    def _op(self, fn: Callable, other=None, unary: bool = False) -> Scalar:
        name = self._only
        if unary:
            return Scalar(self.df.select(*self.keys, fn(F.col(name)).alias(name)), self.keys, self.universe)
        if isinstance(other, Collection):
            shared = [k for k in self.keys if k in other.keys]
            side = other.df.select(*shared, F.col(other._only).alias("__other"))
            if other.keys and not self.keys:
                turned = same(other.df.select(*other.keys, F.col(other._only).alias("__other")), self.df, [], "inner")
                return Scalar(turned.select(*other.keys, fn(F.col(name), F.col("__other")).alias(name)), other.keys, other.universe)
            return Scalar(same(self.df, side, shared, "inner").select(*self.keys, fn(F.col(name), F.col("__other")).alias(name)), self.keys, self.universe)
        return Scalar(self.df.select(*self.keys, fn(F.col(name), F.lit(other)).alias(name)), self.keys, self.universe)

    def _whole(self, other) -> bool:
        return isinstance(self.kind, IntegralType) and (isinstance(other, int) or isinstance(other, Scalar) and isinstance(other.kind, IntegralType))

    def __truediv__(self, other):
        """Integers divide downwards."""
        return self._op((lambda a, b: div(a, b)) if self._whole(other) else lambda a, b: a / b, other)

    def __rtruediv__(self, other):
        return self._op((lambda a, b: div(b, a)) if self._whole(other) else lambda a, b: b / a, other)

    def __floordiv__(self, other):
        return self._op((lambda a, b: div(a, b)) if self._whole(other) else lambda a, b: F.floor(a / b), other)

    def __rfloordiv__(self, other):
        return self._op((lambda a, b: div(b, a)) if self._whole(other) else lambda a, b: F.floor(b / a), other)

    def __mod__(self, other):
        return self._op(mod, other)

    def __rmod__(self, other):
        return self._op(lambda a, b: mod(b, a), other)

    def __pow__(self, other):
        whole = self._whole(other)
        return self._op(lambda a, b: F.pow(a, b).cast("long") if whole else F.pow(a, b), other)

    def __neg__(self):
        return self._op(lambda a: -a, unary=True)

    def __pos__(self):
        return self

    def __abs__(self):
        return self._op(F.abs, unary=True)

    def __invert__(self):
        return self._op(F.bitwise_not, unary=True)

    def not_(self):
        return self._op(lambda a: ~a if self.df.schema[self._only].dataType.typeName() == "boolean" else a == 0, unary=True)

    def ceil(self):
        return self._op(F.ceil, unary=True)

    def floor(self):
        return self._op(F.floor, unary=True)

    def round(self, n: int = 0):
        """Halves go away from zero."""
        return self._op(lambda a: F.round(a, n), unary=True)

    def cartesian(self, *others: Scalar) -> Scalar:
        return make_tuple(self, *others)

    def get(self, nested: bool = False):
        """The value (of several fields: a row); under keys a dict for each level. There must be one."""
        rows, fields = self.df.collect(), self.fields
        value = lambda r: r[fields[0]] if len(fields) == 1 else tuple(r[f] for f in fields)
        if self.keys:
            out: dict = {}
            for r in rows:
                at = out
                for k in self.keys[:-1]:
                    at = at.setdefault(r[k], {})
                at[r[self.keys[-1]]] = value(r)
            return out
        if not rows:
            raise ValueError("the scalar is empty: there was nothing to reduce; an aggregate with a zero has a value for that")
        return value(rows[0])


def _operator(fn: Callable, reverse: bool = False):
    return lambda self, other: self._op((lambda a, b: fn(b, a)) if reverse else fn, other)


for _name, _fn in {
    "add": operator.add, "sub": operator.sub, "mul": operator.mul, "and": lambda a, b: a.bitwiseAND(b), "or": lambda a, b: a.bitwiseOR(b), "xor": lambda a, b: a.bitwiseXOR(b),
    "lshift": lambda a, b: F.call_function("shiftleft", a, b.cast("int")), "rshift": lambda a, b: F.call_function("shiftright", a, b.cast("int")),
}.items():
    setattr(Scalar, f"__{_name}__", _operator(_fn))
    setattr(Scalar, f"__r{_name}__", _operator(_fn, reverse=True))
for _name in ("lt", "le", "gt", "ge"):
    setattr(Scalar, f"__{_name}__", _operator(getattr(operator, _name)))


def equals(a: Scalar, b) -> Scalar:
    """If the values are equal; == itself compares plans."""
    return a._op(lambda x, y: x.eqNullSafe(y), b)


def make_tuple(*scalars: Scalar, into: str = "tuple") -> Scalar:
    """The scalars' values in one struct (_0, _1 and so on); of the same groups, or of none."""
    keyed = next((s for s in scalars if s.keys), scalars[0])
    df = keyed._kept() if keyed.keys else keyed.df.sparkSession.range(1).select()
    for i, s in enumerate(scalars):
        df = same(df, s.df.select(*s.keys, F.col(s._only).alias(f"_{i}")), list(s.keys), "inner")
    return Scalar(df.select(*keyed.keys, F.struct(*[f"_{i}" for i in range(len(scalars))]).alias(into)), keyed.keys, keyed.universe)


def parallelize(spark: SparkSession, rows: list | dict, schema: str, keys: tuple[str, ...] = ()) -> Collection:
    """Rows in memory; a dict, nested for each of `keys`, gives groups (also empty ones)."""
    if not isinstance(rows, dict):
        return Collection(spark.createDataFrame(rows, schema))
    kind = StructType.fromDDL(schema)
    flat, groups = [], []

    def walk(at, path):
        if len(path) < len(keys):
            for k, v in at.items():
                walk(v, (*path, k))
        else:
            groups.append(path)
            flat.extend((*path, *(x if isinstance(x, tuple) else (x,))) for x in at)

    walk(rows, ())
    df = spark.createDataFrame(flat, kind)
    return Collection(df, keys, spark.createDataFrame(groups, df.select(*keys).schema))


def read(spark: SparkSession, path: str, form: str = "parquet", **options) -> Collection:
    return Collection(spark.read.format(form).options(**options).load(path))
