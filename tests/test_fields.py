"""Operators on named fields, and sources and sinks."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.core import Collection, parallelize
from tessera.operators import fields as fs
from tessera.operators import relational as rel
from tessera.sources import targets, text, user
from tessera.streaming import windows


def rows(c):
    return sorted(map(tuple, (c.df if isinstance(c, Collection) else c).collect()), key=str)


def clicks(spark):
    return parallelize(spark, [("a,b,c", 1), ("b,c", 2), ("a,c", 3), ("a,b", 2), ("a,d", 1)], "websites string, clicknum long")


def test_types_and_shapes(spark):
    p = parallelize(spark, [("1", "x")], "a string, b string")
    assert fs.describe(fs.as_schema(p, fs.of(("n", "long"), "s"))) == {"n": "bigint", "s": "string"}
    assert fs.describe(fs.as_schema(p, {"a": "int"})) == {"a": "int", "b": "string"}
    assert fs.describe(fs.tuple_to_dict(p, "c,d")) == {"c": "string", "d": "string"}
    t = fs.dict_to_tuple(p, ["b", "a"])
    assert [tuple(r.value) for r in t.get()] == [("x", "1")]
    assert rows(fs.tuple_to_dict(t, ["x", ("y", "long")])) == [("x", 1)]
    with pytest.raises(ValueError):
        fs.dict_to_tuple(t)
    with pytest.raises(ValueError):
        fs.tuple_to_dict(p, "a,b,c")
    assert [f.name for f in fs.typed(p)] == ["a", "b"]


def test_select_and_update(spark):
    p = clicks(spark)
    assert rows(fs.select(p, "clicknum,nothing")) == [(1, None), (1, None), (2, None), (2, None), (3, None)]
    assert rows(fs.select(p, {"clicknum": lambda c: c + 1, "one": 1, "two": (lambda a, b: F.concat(b, a.cast("string")), "clicknum", "websites")}))[0] == (2, 1, "a,b,c1")
    split = fs.select(p, lambda c: {"website": fs.each(F.split(c.websites, ",")), "clicknum": c.clicknum})
    assert rows(fs.group_by(split, "website").sum("clicknum")) == [("a", 7), ("b", 5), ("c", 6), ("d", 1)]
    product = fs.select(p, lambda c: {"x": fs.each(F.split(c.websites, ",")), "y": fs.each(F.array(F.lit(1), F.lit(2)))})
    assert len(rows(product)) == 22
    assert rows(fs.update(p, lambda c: {"clicknum": c.clicknum * 2}))[0] == ("a,b", 4)
    assert rows(fs.select(p, lambda c, total: {"share": c.clicknum * 10 / total}, p.sum("clicknum")))[0] == (10 / 9,)
    assert rows(fs.select_as(p, "websites, clicknum => w, n", lambda a, b: (fs.each(F.split(a, ",")), b)))[0] == ("a", 1)
    assert rows(fs.agg_as(p, "clicknum => total, most", lambda c: (F.sum(c), F.max(c)))) == [(9, 3)]
    with pytest.raises(ValueError):
        fs.select_as(p, "websites", lambda a: a)


def test_aggregates_of_fields(spark):
    split = fs.select(clicks(spark), lambda c: {"website": fs.each(F.split(c.websites, ",")), "clicknum": c.clicknum})
    out = fs.agg(fs.group_by(split, "website"), lambda c: {"total": F.sum(c.clicknum), "most": F.max(c.clicknum), "each": fs.each(F.array_sort(F.collect_set(c.clicknum)))})
    assert rows(fs.flatten(out)) == sorted([("a", 7, 3, 1), ("a", 7, 3, 2), ("a", 7, 3, 3), ("b", 5, 2, 1), ("b", 5, 2, 2), ("c", 6, 3, 1), ("c", 6, 3, 2), ("c", 6, 3, 3), ("d", 1, 1, 1)], key=str)
    assert rows(fs.agg(clicks(spark), lambda c: {"one": 1})) == [(1,)] * 5
    assert fs.flatten(clicks(spark)).keys == () and len(rows(fs.distinct(split, "website"))) == 4 and len(rows(fs.distinct(split))) == 9
    assert fs.group_by(split, [0]).keys == ("website",) and fs.group_by(split, "website", "clicknum").fields == ["clicknum"]


def test_joins_of_records(spark):
    a = parallelize(spark, [("a", 2), ("e", 4), ("c", 6)], "websites string, clicknum long")
    b = parallelize(spark, [("a", 9), ("b", 8), ("d", 7)], "websites string, click long")
    pairs = lambda how: sorted([(tuple(r._0), tuple(r._1)) for r in fs.join(a, b, fields="websites", how=how).get()], key=str)
    none = (None, None)
    assert pairs("inner") == [(("a", 2), ("a", 9))]
    assert pairs("left") == sorted([(("a", 2), ("a", 9)), (("e", 4), none), (("c", 6), none)], key=str)
    assert pairs("right") == sorted([(("a", 2), ("a", 9)), (none, ("b", 8)), (none, ("d", 7))], key=str)
    assert len(pairs("full")) == 5
    assert {tuple(r) for r in fs.right_join(a, b, fields="websites", merge=True).get()} == {(8, None, "b"), (7, None, "d"), (9, 2, "a")}
    assert len(fs.left_join(a, b, fields="websites").get()) == 3 and len(fs.full_join(a, b, fields="websites", merge=True).get()) == 5
    with pytest.raises(ValueError):
        fs.join(a, b, a, fields="websites", merge=True)
    x, y = fs.cogroup(a, b, fields="websites")
    assert rows(x.count()) == [("a", 1), ("b", 0), ("c", 1), ("d", 0), ("e", 1)] and rows(rel.join(a, b, on=["websites"], partitions=2, hint="merge")) == [("a", 2, 9)]


def test_delimited_text_and_targets(spark, tmp_path):
    p = parallelize(spark, [("a", None, 1), ("b", "x", 2)], "a string, b string, c int")
    out = str(tmp_path / "fields")
    targets.write(p, targets.TextTarget(out, separator="|").sort(reverse=True).partition(1).with_compression())
    assert [r.value for r in text.read_lines(spark, out).get()] == ["b|x|2", "a||1"]
    assert rows(text.read_fields(spark, out, columns="a string, b string, c int", separator="|")) == [("a", "", 1), ("b", "x", 2)]
    assert rows(text.read_fields(spark, out, columns=3, separator="|")) == [("a", "", "1"), ("b", "x", "2")]
    assert rows(text.read_fields(spark, out, columns=["string", "string", "int"], separator="|")) == [("a", "", 1), ("b", "x", 2)]
    assert rows(text.read_fields(spark, out, columns=["k", ("m", "string"), ("n", "long")], separator="|", partitioned=True).count().flatten().select("count")) == [(2,)]
    kv = parallelize(spark, [("k1", 1), ("k2", 2)], "key string, value int")
    targets.write(kv.map(key="key", value=F.col("value").cast("string")), targets.SequenceTarget(str(tmp_path / "s")))
    assert rows(text.read_sequence(spark, str(tmp_path / "s"))) == [(bytearray(b"k1"), bytearray(b"1")), (bytearray(b"k2"), bytearray(b"2"))]
    one, two = str(tmp_path / "s1"), str(tmp_path / "s2")
    for path in (one, two):
        text.write_sequence(kv, path, "key", "value", str.encode, lambda v: v.to_bytes(2, "big"))
    back = text.read_sequence(spark, one, two, decode_key=bytes.decode, decode_value=lambda b: int.from_bytes(b, "big"), returns="k string, v int", partitioned=True)
    assert sorted(back.sum("v").get().values()) == [3, 3]
    raw = text.read_sequence(spark, one)
    assert rows(text.as_type(raw, lambda k, v: (bytes(k).decode(), len(v)), "k string, n int")) == [("k1", 2), ("k2", 2)]
    with pytest.raises(ValueError):
        text.read_sequence(spark, one, decode_key=bytes.decode)


def test_pipes(spark):
    p = parallelize(spark, [("a", None, "c"), ("b", "y", "z w")], "x string, y string, z string")
    assert rows(text.pipe(p, "cat", ["x", "y", "z"], returns="x string, y string, z string")) == [("a", "", "c"), ("b", "y", "z w")]
    assert rows(text.pipe(p, "cat", ["x", "y", "z"], returns="x string, rest string")) == [("a", "\tc"), ("b", "y\tz w")]
    assert rows(text.pipe(p, "cat", ["x", "z"], returns="x string, z string", binary=True)) == [("a", "c"), ("b", "z w")]
    t = text.pipe(p.group_by("x"), "sed s/z/Z/", ["z"], returns="out string")
    assert t.keys == ("x",) and rows(t) == [("a", "c"), ("b", "Z w")]
    assert rows(text.pipe(p.group_by("x"), "cat", ["z"])) == [("a\tc",), ("b\tz w",)]
    assert rows(text.pipe(p, "head -n 0; cat > /dev/null", ["x"])) == []


def test_user_sinks(spark, tmp_path):
    folder = str(tmp_path)

    class ToFiles(user.Sink):
        partition_number = 2

        def partition_fn(self, row):
            return row % 2

        def open(self, partition):
            self.out, self.n = open(f"{folder}/{partition}", "w"), 0

        def sink(self, row):
            self.out.write(f"{row[0]}\n")
            self.n += 1

        def close(self):
            self.out.close()
            return self.n

        def commit(self, results):
            with open(f"{folder}/done", "w") as f:
                f.write(str(sum(results)))

    targets.write(parallelize(spark, [(i,) for i in range(6)], "x long"), ToFiles())
    assert (tmp_path / "done").read_text() == "6"
    assert sorted((tmp_path / "0").read_text().split()) == ["0", "2", "4"] and sorted((tmp_path / "1").read_text().split()) == ["1", "3", "5"]
    twice = user.read_user(spark, [1, 2], lambda n: ((n,),), "x int", post_process=lambda c: c.map(x=F.col("x") * 2))
    other = user.read_user(spark, [1, 2], lambda n: ((n + 10,),), "x int")
    assert rows(twice) == [(2,), (4,)] and rows(other) == [(11,), (12,)]


def test_windows(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    p = parallelize(spark, [("u", at(0)), ("u", at(4)), ("u", at(20)), ("v", at(9))], "k string, ts string").group_by("k")
    n = lambda c: sorted((r.k, r.window.start.minute, r["count"]) for r in c.count().df.collect())
    assert n(windows.window_into(p, "ts", "10 minutes")) == [("u", 0, 2), ("u", 20, 1), ("v", 0, 1)]
    assert n(windows.window_into(p, "ts", "10 minutes", slide="5 minutes")) == [("u", 0, 2), ("u", 15, 1), ("u", 20, 1), ("u", 55, 2), ("v", 0, 1), ("v", 5, 1)]
    assert n(windows.window_into(p, "ts", gap="5 minutes")) == [("u", 0, 2), ("u", 20, 1), ("v", 9, 1)]
    with pytest.raises(ValueError):
        windows.window_into(p, "ts")


def test_lines_again_and_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("x\ny\n")
    q = windows.repeated_lines(spark, str(tmp_path / "in"), rows_per_second=5).writeStream.format("memory").queryName("again").trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            ticks = {}
            for r in spark.table("again").collect():
                ticks.setdefault(r.tick, []).append(r.value)
            if len(ticks) > 2:
                break
    finally:
        q.stop()
    assert len(ticks) > 2 and all(sorted(v) == ["x", "y"] for v in ticks.values())


def test_late_rows_and_pair_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, lines in enumerate([["a\t2024-01-01 00:01:00"], ["a\t2024-01-01 01:00:00"], ["a\t2024-01-01 01:01:00"], ["a\t2024-01-01 00:02:00", "a\t2024-01-01 02:00:00"]]):
        path = tmp_path / "in" / f"part-{i:05d}"
        path.write_text("\n".join(lines) + "\n")
        import os

        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    (tmp_path / "in" / "other").write_text("no\n")
    stream = windows.read_line_stream(spark, str(tmp_path / "in"), pattern="part-*", pairs=True)
    counts = windows.tumbling(stream, "value", "10 minutes", late="5 minutes", keys=("key",), n=F.count(F.lit(1)))
    q = counts.writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(90)
    # the row of 00:02 came when its window had been closed
    assert sorted((r.window_start.hour, r.n) for r in spark.table("late").collect())[:2] == [(0, 1), (1, 2)]
    with pytest.raises(ValueError):
        rel.cartesian(Collection(stream), Collection(stream))
