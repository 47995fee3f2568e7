"""Joins, set operations and products of collections.

Inside groups all of them work group by group: the inputs share their group keys, or have none and then are in
every group. Groups that become empty are kept.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import Collection, same


def _several(ps: tuple, what: str) -> None:
    if len(ps) < 2 or not all(isinstance(p, Collection) for p in ps):
        raise ValueError(f"{what} takes two collections or more")
    for p in ps:
        p._finite(what)


def _scoped(*ps: Collection) -> tuple[list[Collection], tuple[str, ...], DataFrame | None]:
    """The inputs in one scope, its keys, and all groups of it."""
    scopes = {p.keys for p in ps if p.keys}
    if not scopes:
        return list(ps), (), None
    if len(scopes) > 1:
        raise ValueError(f"the inputs are grouped by different keys: {sorted(scopes)}")
    keys = scopes.pop()
    groups = fold(lambda a, b: a.union(b), [p._kept().select(*keys) for p in ps if p.keys])
    groups = groups.distinct() if sum(bool(p.keys) for p in ps) > 1 else groups
    return [p if p.keys else Collection(groups.crossJoin(p.df), keys, groups) for p in ps], keys, groups


def _named(ps: list[Collection], on: list[str]) -> list[DataFrame]:
    """Each input's other fields, numbered by input where names clash."""
    every = [c for p in ps for c in p.df.columns if c not in on]
    return [p.df.withColumnsRenamed({c: f"{c}_{i}" for c in p.df.columns if c not in on and every.count(c) > 1}) for i, p in enumerate(ps)]


def join(*ps: Collection, on: list[str], how: str = "inner", partitions: int | None = None, hint: str | None = None) -> Collection:
    """inner and full join all inputs on equal keys (null equals null); left keeps the first input's keys, right the last's.

    partitions deals all inputs by the keys into so many parts before; hint is Spark's name of a join strategy, for all inputs but the first.
    """
    _several(ps, "join")
    ps, keys, groups = _scoped(*ps)
    on = [*keys, *on]
    dfs = _named(ps, on)
    order = [*on, *[c for d in dfs for c in d.columns if c not in on]]
    if partitions:
        dfs = [d.repartition(partitions, *on) for d in dfs]
    if hint:
        dfs = [dfs[0], *[d.hint(hint) for d in dfs[1:]]]
    if how == "right":
        dfs, how = dfs[::-1], "left"
    return Collection(fold(lambda a, b: same(a, b, on, how), dfs).select(*order), keys, groups)


def merge_join(*ps: Collection, on: list[str] | None = None, how: str = "inner") -> Collection:
    """One record of both sides' fields. Where names clash the left's value stays, in a right join the right's;
    rows of the right alone have null keys in a full join."""
    if on is None and len(ps) > 2 and isinstance(ps[2], list):
        (*ps, on), how = ps[:3], ps[3] if len(ps) > 3 else how
    if len(ps) != 2:
        raise ValueError("a merging join takes exactly two collections")
    _several(tuple(ps), "join")
    (a, b), keys, groups = _scoped(*ps)
    on = [*keys, *on]
    clash = [c for c in b.df.columns if c in a.df.columns and c not in on]
    left, right = a.df.withColumn("__l", F.lit(True)), b.df.withColumnsRenamed({c: f"__b_{c}" for c in clash}).withColumn("__r", F.lit(True))
    out = same(right, left, on, "left") if how == "right" else same(left, right, on, how)
    if how == "full":
        out = out.withColumns({k: F.when(F.col("__l"), F.col(k)) for k in on if k not in keys})
    pick = {c: F.col(f"__b_{c}" if how == "right" else c) for c in clash}
    return Collection(out.withColumns(pick).select(*keys, *sorted({*a.df.columns, *b.df.columns, *on} - {*keys})), keys, groups)


def record_join(*ps: Collection, on: list[str], how: str = "inner") -> Collection:
    """Each input's whole record as a struct, _0, _1 and so on; of an input without a match all its fields are null."""
    _several(ps, "join")
    ps, keys, groups = _scoped(*ps)
    dfs = [p.df.select(*keys, *[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], F.struct(*p.fields).alias(f"_{n}")) for n, p in enumerate(ps)]
    by, nothing = [*keys, *[f"__k{i}" for i in range(len(on))]], {f"_{n}": F.struct(*[F.lit(None).cast(p.df.schema[f].dataType).alias(f) for f in p.fields]) for n, p in enumerate(ps)}
    if how == "right":
        dfs, how = dfs[::-1], "left"
    out = fold(lambda a, b: same(a, b, by, how), dfs)
    return Collection(out.select(*keys, *[F.coalesce(c, empty).alias(c) for c, empty in nothing.items()]), keys, groups)


def cartesian(*ps: Collection) -> Collection:
    """Each record with each, inside groups those of the same group."""
    for p in ps:
        p._finite("cartesian")
    ps, keys, groups = _scoped(*ps)
    return Collection(fold(lambda a, b: same(a, b, list(keys), "inner"), _named(ps, list(keys))), keys, groups)


def semi(a: Collection, b: Collection, on: list[str]) -> Collection:
    (a, b), keys, _ = _scoped(a, b)
    return a._thinned(same(a.df, b.df.select(*keys, *on).distinct(), [*keys, *on], "left_semi"))


def anti(a: Collection, b: Collection, on: list[str]) -> Collection:
    (a, b), keys, _ = _scoped(a, b)
    return a._thinned(same(a.df, b.df.select(*keys, *on).distinct(), [*keys, *on], "left_anti"))


def one_per_key(a: Collection, b: Collection, on: list[str]) -> Collection:
    """Keys that both have, once each."""
    (a, b), keys, groups = _scoped(a, b)
    return Collection(a.df.select(*keys, *on).distinct().intersect(b.df.select(*keys, *on).distinct()), keys, groups)


def union(*ps: Collection) -> Collection:
    """All records, copies too; numbers are widened. Inputs of the same fields in another order are taken by name, others by place."""
    ps, keys, groups = _scoped(*ps)
    names = ps[0].df.columns
    dfs = [p.df if set(p.df.columns) == set(names) else p.df.toDF(*names) for p in ps]
    return Collection(fold(lambda a, b: a.unionByName(b), dfs), keys, groups if any(p.universe is not None for p in ps) else None)


def intersection(a: Collection, b: Collection, duplicated: bool = False) -> Collection:
    _several((a, b), "intersection")
    (a, b), keys, groups = _scoped(a, b)
    right = b.df.select(*a.df.columns)
    return Collection(a.df.intersectAll(right) if duplicated else a.df.intersect(right), keys, groups)


def subtract(a: Collection, b: Collection) -> Collection:
    """The records of a that b does not have; a's duplicates stay."""
    _several((a, b), "subtract")
    return anti(a, b, a.fields)


def diff(a: Collection, b: Collection) -> Collection:
    """Records whose counts differ, with both counts."""
    _several((a, b), "diff")
    (a, b), keys, groups = _scoped(a, b)
    names = a.df.columns
    tagged = a.df.withColumn("__t", F.lit(1)).unionByName(b.df.withColumn("__t", F.lit(0)))
    out = tagged.groupBy(*names).agg(F.sum("__t").alias("count_a"), F.sum(1 - F.col("__t")).alias("count_b"))
    return Collection(out.where("count_a <> count_b"), keys, groups)


class CoTable(list):
    """Collections under common keys."""

    def apply_values(self, fn, *args):
        return fn(*self, *args)

    def flatten(self):
        raise TypeError("several collections under one key can't be flattened; join or reduce them first")


def cogroup(*ps: Collection, on: list[str]) -> CoTable:
    """The inputs under common keys: each has all keys in its universe, so its empty groups are kept."""
    _several(ps, "cogroup")
    ps, keys, _ = _scoped(*ps)
    by = (*keys, *on)
    every = fold(lambda a, b: a.union(b), [p.df.select(*by) for p in ps]).distinct()
    return CoTable(Collection(p.df, by, every) for p in ps)


def pagerank(edges: DataFrame, rounds: int, start: int | Column = 1) -> DataFrame:
    """Sums of neighbours' values, passed along (src, dst) for a number of rounds.

    Each round's plan is checkpointed if the session names a folder for that; without one the plan grows with the rounds.
    """
    rank = edges.select(F.col("dst").alias("node")).union(edges.select("src")).distinct().withColumn("value", (F.lit(start) if isinstance(start, int) else start).cast("long"))
    cut = edges.sparkSession.conf.get("spark.checkpoint.dir", None)
    for _ in range(rounds):
        rank = edges.join(rank, edges["src"] == rank["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum("value").alias("value"))
        rank = rank.checkpoint() if cut else rank
    return rank
