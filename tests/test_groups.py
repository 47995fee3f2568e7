"""Semantics of groups, scalars and order."""

import operator

import pytest
from pyspark.sql import functions as F

from tessera.core import ASC, DESC, Collection, Scalar, Transformer, equals, make_tuple, parallelize
from tessera.functions import udf
from tessera.functions.jobs import Hooks, own_errors
from tessera.functions.scalars import Counters, div, mod
from tessera.operators import relational as rel


def rows(c):
    return sorted(map(tuple, (c.df if isinstance(c, Collection) else c).collect()), key=str)


def values(spark, xs, name="x"):
    return parallelize(spark, [(x,) for x in xs], f"{name} long")


def table(spark, groups, kind="k string, v long"):
    return parallelize(spark, groups, kind, ("k",))


def test_empty_groups_stay_through_a_chain_of_aggregates(spark):
    t = values(spark, [0, 1, 2]).update(k=F.col("x") % 2).group_by("k")
    assert rows(t.sum("x").filter("x = 1").sum("x").count()) == [(0, 0), (1, 1)]
    assert rows(t.filter("x = 1").count()) == [(0, 0), (1, 1)]
    assert rows(t.filter("x >= 1").filter("x < 2").count()) == [(0, 0), (1, 1)]
    assert rows(t.filter("x = 1").max("x").count()) == [(0, 0), (1, 1)]
    assert rows(t.filter("x = 1").distinct().count()) == [(0, 0), (1, 1)]
    assert rows(t.filter("x = 1").is_empty()) == [(0, True), (1, False)]
    both = rel.union(t.filter("x = 1"), t.filter("x = 1"))
    assert rows(both.count()) == [(0, 0), (1, 2)]
    assert rows(t.flat_map("y", F.when(F.col("x") > 0, F.array("x"))).count()) == [(0, 1), (1, 1)]
    assert t.filter("x = 1").get(nested=True) == {0: [], 1: [1]}
    inner = table(spark, {"a": [1, 2], "b": []})
    assert inner.count().get() == {"a": 2, "b": 0}


def test_relations_work_group_by_group(spark):
    a, b = table(spark, {"p": [1, 2, 2], "q": [1]}), table(spark, {"p": [2, 3], "q": [2], "r": [5]})
    assert rows(rel.cartesian(a, b)) == sorted([("p", x, y) for x in (1, 2, 2) for y in (2, 3)] + [("q", 1, 2)], key=str)
    assert rows(rel.cartesian(a, b).count()) == [("p", 6), ("q", 1), ("r", 0)]
    one, two = a.update(w=F.lit(1)), b.update(z=F.lit(2))
    assert rows(rel.join(one, two, on=["v"])) == [("p", 2, 1, 2), ("p", 2, 1, 2)]
    assert rows(rel.join(one, two, on=["v"]).count()) == [("p", 2), ("q", 0), ("r", 0)]
    assert rows(rel.intersection(a, b)) == [("p", 2)] and rel.intersection(a, b).keys == ("k",)
    assert rows(rel.subtract(a, b)) == [("p", 1), ("q", 1)]
    assert rows(rel.diff(a, b)) == sorted([("p", 1, 1, 0), ("p", 2, 2, 1), ("p", 3, 0, 1), ("q", 1, 1, 0), ("q", 2, 0, 1), ("r", 5, 0, 1)], key=str)
    # a whole collection is in every group
    assert rows(a.apply_values(lambda p, more: rel.union(p, more), values(spark, [9], "v"))) == sorted([("p", 1), ("p", 2), ("p", 2), ("q", 1), ("p", 9), ("q", 9)], key=str)
    with pytest.raises(ValueError):
        a.apply_values(lambda p, t: p, b)
    with pytest.raises(ValueError):
        rel.union(a, b.update(j=F.lit(1)).group_by("j"))
    with pytest.raises(TypeError):
        rel.cogroup(one.as_collection(), two, on=["v"]).flatten()


def test_side_inputs_in_groups(spark):
    t = table(spark, {"A": [1, 2, 3, 1, 2], "B": [4, 5, 3, 4, 5]})
    kept = t.filter(lambda v, side: F.array_contains(side, v), values(spark, [1, 3, 4]))
    assert rows(kept) == [("A", 1), ("A", 1), ("A", 3), ("B", 3), ("B", 4), ("B", 4)]
    assert rows(t.filter(lambda v, side: v in side, values(spark, [1, 3, 4]), opaquely=True)) == rows(kept)
    assert rows(t.map(lambda v, n: v * n, t.count())) == sorted([(k, 5 * v) for k, vs in {"A": [1, 2, 3, 1, 2], "B": [4, 5, 3, 4, 5]}.items() for v in vs], key=str)
    assert rows(t.apply_key_values(lambda k, p: p.map(lambda v, key: F.concat(key, v), k))) == sorted([(k, f"{k}{v}") for k, vs in {"A": [1, 2, 3, 1, 2], "B": [4, 5, 3, 4, 5]}.items() for v in vs], key=str)
    assert t.apply_values(udf.count()).get() == {"A": 5, "B": 5}


def test_scalars(spark):
    n = lambda x: Scalar(spark.createDataFrame([(x,)], "v long" if isinstance(x, int) else "v double"))
    one, two = n(1), n(2)
    assert (one + two * 16).get() == 33 and ((two * 1 + 1) / 2).get() == 1 and (~two).get() == -3 and (-two).get() == -2
    assert (n(-7) / 2).get() == -4 and (n(-7) // two).get() == -4 and (n(-7) % 2).get() == 1 and (7 / two).get() == 3 and (two**3).get() == 8
    assert (two << 3).get() == 16 and (n(16) >> 2).get() == 4 and (n(6) & 3).get() == 2 and (n(6) | 3).get() == 7 and (n(6) ^ 3).get() == 5
    assert n(1.356).round(2).get() == 1.36 and n(1.356).ceil().get() == 2 and n(-1.2).floor().get() == -2 and abs(n(-1)).get() == 1
    assert (one < two).get() and equals(one, 1).get() and not one.not_().get() and (5 - two).get() == 3
    assert make_tuple(one, two).get() == (1, 2) or tuple(make_tuple(one, two).get()) == (1, 2)
    assert values(spark, [1, 2, 2]).sum().get() == 5 and (values(spark, [1, 2, 2]).sum() / values(spark, [1, 2, 2]).count()).get() == 1
    with pytest.raises(ValueError, match="empty"):
        values(spark, []).sum().get()
    t = table(spark, {"a": [1, 2], "b": [5]})
    assert (t.sum() / t.count()).get() == {"a": 1, "b": 5} and (t.sum() + one).get() == {"a": 4, "b": 6}
    assert (one + t.sum()).get() == {"a": 4, "b": 6}
    r = spark.range(1).select(div(F.lit(9007199254740993), F.lit(1)).alias("a"), div(F.lit(-9007199254740993), F.lit(2)).alias("b"), mod(F.lit(7), F.lit(-2)).alias("c")).first()
    assert tuple(r) == (9007199254740993, -4503599627370497, -1)


def test_lists_dicts_and_sums_of_text(spark):
    t = table(spark, {"a": [3, 1, None], "b": []})
    assert t.sort_by("v").to_list().get() == {"a": [None, 1, 3], "b": []}
    assert t.sort_by("v", reverse=True).to_list().get() == {"a": [3, 1, None], "b": []}
    assert t.count().to_dict().get() == {"a": 3, "b": 0}
    nested = parallelize(spark, {"x": {"y": [1, 2], "z": [3]}}, "k string, j string, v long", ("k", "j"))
    assert nested.sum().to_dict().get() == {"x": {"y": 3, "z": 3}} and nested.nested_level == 2 and nested.inner_most_type is Collection
    assert nested.ungroup().count().get() == {"x": 3}
    words = parallelize(spark, [("a", "x", [1]), ("a", "b", [2, 3])], "k string, s string, l array<int>").group_by("k")
    assert words.sort_by("s").sum("s").get() == {"a": "bx"} and words.sort_by("s").sum("l").get() == {"a": [2, 3, 1]}
    assert words.max("s", by=F.size("l")).get() == {"a": "b"} and words.min("s", by=F.size("l")).get() == {"a": "x"}


def test_orders_and_tops(spark):
    pairs = [(12, 23), (15, 6), (10, 21), (10, 11), (15, 2), (15, 9), (34, 1)]
    p = parallelize(spark, pairs, "a long, b long")
    assert [tuple(r) for r in p.sort().get()] == sorted(pairs) and [tuple(r) for r in p.sort(reverse=True).get()] == sorted(pairs, reverse=True)
    assert [tuple(r) for r in p.sort_by(ASC("a"), DESC("b")).get()] == sorted(pairs, key=lambda r: (r[0], -r[1]))
    assert [tuple(r) for r in p.sort_by(ASC("a"), DESC("b"), reverse=True).get()] == sorted(pairs, key=lambda r: (-r[0], r[1]))
    xs = values(spark, [4, 3, 1, 2, 5, 8, 4, 0, 9, 6, 9, 7])
    assert [r.x for r in xs.max_elements(8).get()] == [9, 9, 8, 7, 6, 5, 4, 4]
    assert sorted(r.x for r in xs.min_elements(8).get()) == [0, 1, 2, 3, 4, 4, 5, 6]
    t = table(spark, {"A": [3, 7, 1, 9, 2, 8], "B": [2]})
    half = t.count("n").map(half=F.floor(F.col("n") / 2))
    assert rows(t.sort_by("v").take(half)) == [("A", 1), ("A", 2), ("A", 3)] == rows(t.sort_by("v").take(half.as_scalar()))
    assert rows(t.update(n=F.lit(1)).sort_by("v").take(half).map(v="v")) == [("A", 1), ("A", 2), ("A", 3)]
    assert len(rows(t.take(t.count()))) == 7 and rows(t.top(t.count() / 2)) == [("A", 7), ("A", 8), ("A", 9)]


def test_python_functions(spark):
    p = values(spark, [1, 2, 3])
    assert rows(p.map(lambda x: x + 1)) == [(2,), (3,), (4,)]
    assert rows(p.map(lambda x: x * 2 if x > 1 else 0, returns="y long")) == [(0,), (4,), (6,)]
    with pytest.raises(TypeError, match="returns"):
        p.map(lambda x: 1 if x > 1 else 0)
    assert rows(p.map(lambda x, s: x + s, p.sum(), returns="y long")) == [(7,), (8,), (9,)]
    assert rows(p.flat_map(lambda x: range(x), returns="y long")) == sorted([(y,) for x in (1, 2, 3) for y in range(x)], key=str)
    with own_errors(), pytest.raises(Exception, match="None"):
        p.flat_map(lambda x: None, returns="y long").get()
    with pytest.raises(ZeroDivisionError), own_errors():
        p.map(lambda x: 1 // (x - 2), returns="y long").get()
    assert rows(p.filter(lambda x: x > 1)) == rows(p.filter(lambda x: bool(x > 1 and True), opaquely=True)) == [(2,), (3,)]
    assert p.reduce(operator.add).get() == 6 and p.reduce(lambda a, b: a * b, returns="x long").get() == 6
    with pytest.raises(TypeError):
        p.reduce(lambda a, b: a)
    assert rows(values(spark, []).reduce(lambda a, b: a, returns="x long")) == []
    mean = lambda q: q.aggregate((0, 0), lambda s, x: (s[0] + x, s[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), "total long, n long")
    assert mean(p).get() == (6, 3) and mean(values(spark, [])).get() == (0, 0)
    t = table(spark, {"a": [1, 2], "b": []})
    assert mean(t).get() == {"a": (3, 2), "b": (0, 0)}
    assert parallelize(spark, [("2",), ("3",), ("4",)], "x string").combine(lambda xs: sum(int(x) for x in xs), "x long", pre_combine=False).get() == 9
    assert p.combine(max).get() == 3 and t.combine(lambda xs: max(xs), "v long").get() == {"a": 2}
    assert t.sort_by("v", reverse=True).accumulate("", lambda s, x: s + str(x), "s string").get() == {"a": "21"}
    pairs = parallelize(spark, [("b", 1), ("a", 2)], "k string, v long")
    assert rows(pairs.map(lambda r: r.v + 1)) == [(2,), (3,)] and rows(pairs.map(lambda r: {"k": r["k"], "w": r.v * 2}, returns="k string, w long")) == [("a", 4), ("b", 2)]
    assert pairs.group_by_key().count().get() == {"a": 1, "b": 1}
    with pytest.raises(ValueError):
        p.group_by_key()
    assert len(p.group_by_every_record().count().get()) == 3
    assert rows(p.group_by(odd=lambda x: x % 2).count()) == [(0, 1), (1, 2)]
    seen = Counters(spark)
    count = seen.of("mine|n")
    p.foreach(lambda x: count.add(x))
    assert seen.values() == {("mine", "n"): 6}
    seen.reset("mine|n")
    assert seen.values() == {("mine", "n"): 0}


def test_stateful_code(spark):
    t = values(spark, [4, 3, 2, 1]).update(k=F.lit(0)).group_by("k").sort_by("x", reverse=True)

    def step(state, emit, x):
        emit(state + x)
        return state + x

    out = t.transform(lambda emit: 0, step, lambda state, emit: emit(-state), returns="y long")
    assert [r.y for r in out.df.collect()] == [4, 7, 9, 10, -10]

    class Pairs(Transformer):
        def begin_process(self):
            self.last = None
            return []

        def process(self, x):
            if self.last is not None:
                yield (self.last, x)
            self.last = x

        def end_process(self):
            yield (self.last, None)

    want = [(4, 3), (3, 2), (2, 1), (1, None)]
    assert [(r.a, r.b) for r in t.transform(Pairs(), returns="a long, b long").df.collect()] == want
    whole = values(spark, [3, 1, 2]).sort_by("x").transform(lambda emit: 0, step, lambda s, emit: None, returns="y long")
    assert [r.y for r in whole.df.collect()] == [1, 3, 6]
    assert rows(values(spark, []).transform(lambda emit: 0, step, lambda s, emit: emit(s), returns="y long")) == [(0,)]
    done = []
    hooks = Hooks()
    hooks.before["a"], hooks.after["b"] = lambda: done.append(1), lambda: done.append(2)
    with hooks.run():
        done.append(0)
    assert done == [1, 0, 2]


def test_rollup_inside_groups(spark):
    p = parallelize(spark, [("g", "a", "x", 1), ("g", "a", "y", 2), ("h", "b", "x", 4)], "g string, i string, j string, v long")
    assert len(rows(p.rollup("i", "j", n=F.sum("v")))) == 6
    assert rows(p.group_by("g").rollup("i", n=F.sum("v"))) == [("g", "a", 3), ("g", None, 3), ("h", "b", 4), ("h", None, 4)]
