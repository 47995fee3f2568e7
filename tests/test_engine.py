import gzip

import pytest
from pyspark.sql import functions as F

from tessera.core import Collection, parallelize
from tessera.functions.scalars import LazyVar, div, mod
from tessera.operators import relational as rel
from tessera.sources import text, user
from tessera.streaming import windows


def rows(c):
    return sorted(map(tuple, (c.df if isinstance(c, Collection) else c).collect()), key=str)


def values(spark, xs, name="x"):
    return parallelize(spark, [(x,) for x in xs], f"{name} long")


def test_joins_of_several_inputs(spark):
    a = parallelize(spark, [("key1", 1), ("key2", 2), ("key2", 3), ("key3", 4)], "k string, v long")
    b = parallelize(spark, [("key0", 5.0), ("key1", 6.0), ("key2", 7.0), ("key2", 8.0)], "k string, v double")
    c = parallelize(spark, [("key0", "A"), ("key2", "C"), ("key3", "D"), ("key4", "E")], "k string, v string")
    four = {("key2", x, y, "C") for x in (2, 3) for y in (7.0, 8.0)}
    join = lambda how: {tuple(r) for r in rel.join(a, b, c, on=["k"], how=how).df.collect()}
    assert join("inner") == four
    assert join("left") == four | {("key3", 4, None, "D"), ("key1", 1, 6.0, None)}
    assert join("right") == four | {("key4", None, None, "E"), ("key3", 4, None, "D"), ("key0", None, 5.0, "A")}
    assert join("full") == join("left") | join("right")
    with pytest.raises(ValueError):
        rel.join(a, on=["k"])


def test_merge_joins(spark):
    a = parallelize(spark, [("a", 2), ("e", 4), ("c", 6)], "websites string, clicknum long")
    b = parallelize(spark, [("a", 9), ("b", 8), ("d", 7)], "websites string, click long")
    merge = lambda how: {tuple(r) for r in rel.merge_join(a, b, ["websites"], how).df.collect()}
    assert merge("inner") == {(9, 2, "a")}
    assert merge("left") == {(9, 2, "a"), (None, 4, "e"), (None, 6, "c")}
    assert merge("right") == {(8, None, "b"), (7, None, "d"), (9, 2, "a")}
    assert merge("full") == {(None, 4, "e"), (8, None, None), (7, None, None), (9, 2, "a"), (None, 6, "c")}


def test_null_keys_are_equal(spark):
    a, b = parallelize(spark, [(None, 1), (2, 2)], "k int, a int"), parallelize(spark, [(None, 3)], "k int, b int")
    assert rows(rel.join(a, b, on=["k"])) == [(None, 1, 3)]
    assert rows(rel.anti(a, b, ["k"])) == [(2, 2)] and rows(rel.semi(a, b, ["k"])) == [(None, 1)]


def test_set_operations(spark):
    a, b = values(spark, [1, 2, 3, 1, 3, 5]), values(spark, [1, 2, 1, 4, 2, 3])
    assert rows(rel.intersection(a, b)) == [(1,), (2,), (3,)]
    assert rows(rel.intersection(a, b, duplicated=True)) == [(1,), (1,), (2,), (3,)]
    assert rows(rel.subtract(values(spark, [1, 2, 3, 1, 3]), values(spark, [1, 2, 4, 5, 4]))) == [(3,), (3,)]
    assert rows(rel.diff(values(spark, [1, 2, 3, 1, 4]), values(spark, [1, 2, 1, 2, 3]))) == [(2, 1, 2), (4, 1, 0)]
    assert len(rows(rel.union(a, b))) == 12


def test_empty_groups_stay(spark):
    t = values(spark, [0, 1, 2]).update(k=F.col("x") % 2).group_by("k").sum("x").filter("x = 1").count()
    assert rows(t) == [(0, 0), (1, 1)]
    assert rows(values(spark, []).count()) == [(0,)] and rows(values(spark, []).sum("x")) == []
    assert rows(values(spark, []).is_empty()) == [(True,)]


def test_top_take_and_order_in_groups(spark):
    t = values(spark, range(1, 16)).update(k=F.col("x") % 4).group_by("k")
    assert rows(t.top(3, "x").map(x="x").flatten()) == sorted([(k, x) for k, xs in {0: (4, 8, 12), 1: (5, 9, 13), 2: (6, 10, 14), 3: (7, 11, 15)}.items() for x in xs], key=str)
    assert len(rows(t.take(t.count("n")))) == 15
    assert [r.x for r in values(spark, [4, 3, 1, 2]).top(2, "x").get()] == [4, 3]
    s = values(spark, [4, 3, 2, 1]).update(k=F.lit(0)).group_by("k").sort_by("x", reverse=True).running(y=F.sum("x"))
    assert sorted(r.y for r in s.get()) == [4, 7, 9, 10]
    folded = values(spark, [3, 1, 2]).update(k=F.lit(0)).group_by("k").sort_by("x").fold(F.lit(0).cast("long"), lambda a, x: a * 10 + x, "y", F.col("x"))
    assert rows(folded) == [(0, 123)]


def test_opaque_transform_inside_groups(spark):
    t = values(spark, [3, 1, 2]).update(k=F.lit(1)).group_by("k").sort_by("x")
    out = t.transform(lambda pdf: pdf.assign(x=pdf.x.cumsum())[["x", "k"]], "x long, k int")
    assert sorted(r.x for r in out.get()) == [1, 3, 6]


def test_nested_groups_and_guards(spark):
    c = parallelize(spark, [("a", "x", 1), ("a", "y", 2), ("b", "x", None)], "k string, j string, v int")
    assert rows(c.group_by("k").apply_values(lambda t: t.group_by("j").count())) == [("a", "x", 1), ("a", "y", 1), ("b", "x", 1)]
    assert rows(c.group_by("k").distinct_count("v")) == [("a", 2), ("b", 1)]
    assert rows(c.group_by("k", "j").extract_keys()) == [("a",), ("b",)]
    with pytest.raises(TypeError):
        __import__("pickle").dumps(c)


def test_arithmetic(spark):
    r = spark.range(1).select(div(F.lit(-7), F.lit(2)).alias("a"), mod(F.lit(-7), F.lit(2)).alias("b"), div(F.lit(5), F.lit(3)).alias("c")).first()
    assert tuple(r) == (-4, 1, 1)
    v = LazyVar(lambda: object())
    assert v.get() is v.get()


def test_text_files(spark, tmp_path):
    lines = parallelize(spark, [("|a|b||",), ("x|1",)], "value string")
    with pytest.raises(Exception, match="declared fields"):
        text.split_fields(lines.df, "p string, q string, r string", "|").get()
    assert rows(text.split_fields(lines.df, "p string, q string", "|", ignore_overflow=True)) == [("", "a"), ("x", "1")]
    assert rows(text.split_fields(lines.df, "p string, q string, r string, s string, t string", "|", ignore_illegal_line=True)) == [("", "a", "b", "", "")]
    out = str(tmp_path / "o")
    text.write_lines(values(spark, range(6)), out, "x", gzip=True, sort_by=[F.desc("x")], partitions=2, partition_id=F.col("x") % 2)
    got = [gzip.open(p, "rt").read().replace("\n", "") for p in sorted((tmp_path / "o").glob("part-*"))]
    assert got == ["420", "531"] and len(rows(text.read_lines(spark, out))) == 6
    assert len(text.read_lines(spark, out, partitioned=True).count().get()) == 2
    text.write_fields(parallelize(spark, [("a", None, 1)], "a string, b string, c int"), str(tmp_path / "f"), ["a", "b", "c"])
    assert rows(text.read_lines(spark, str(tmp_path / "f"))) == [("a\t\t1",)]


def test_sequence_files_pipes_and_user_sources(spark, tmp_path):
    kv = parallelize(spark, [("k1", "v1"), ("k2", "v2")], "k string, v string")
    text.write_sequence(kv, str(tmp_path / "s"), "k", "v")
    assert sorted(bytes(r.value) for r in text.read_sequence(spark, str(tmp_path / "s")).get()) == [b"v1", b"v2"]
    assert rows(text.pipe(kv, "cat", ["k", "v"])) == [("k1\tv1",), ("k2\tv2",)]
    with pytest.raises(Exception):
        text.pipe(kv, "false", ["k"]).get()
    t = user.read_user(spark, [1, 2, 3], lambda n: ((i,) for i in range(n)), "x int", keyed=True)
    assert rows(t.sum("x")) == [(0, 0), (1, 1), (2, 3)]


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / str(i)).write_text(f"{i}\n{i}\n")
    stream = windows.read_line_stream(spark, str(tmp_path / "in"))
    with pytest.raises(ValueError):
        Collection(stream).distinct()
    q = stream.groupBy("value").count().writeStream.outputMode("complete").format("memory").queryName("lines").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("lines")) == [("0", 2), ("1", 2), ("2", 2)]


def test_entry_module_names_match(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
