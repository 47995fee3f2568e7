"""Registered queries, each with SQL that gives the same rows."""

from __future__ import annotations

import operator
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import ASC, DESC, Collection, Transformer, make_tuple
from tessera.functions import udf
from tessera.operators import fields
from tessera.operators import relational as rel
from tessera.sources import targets, text, user
from tessera.streaming import windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return register


def of(spark: SparkSession, d: str, table: str, *columns: str) -> Collection:
    df = spark.read.parquet(f"{d}/{table}.parquet")
    return Collection(df.select(*columns) if columns else df)


@query("""select l_returnflag, l_linestatus, count(*) n, cast(sum(cast(l_quantity as bigint)) as bigint) sum_qty, max(l_extendedprice) max_price
from lineitem group by 1, 2""")
def agg_flag_status(s, d) -> DataFrame:
    return of(s, d, "lineitem").group_by("l_returnflag", "l_linestatus").agg(n=F.count(F.lit(1)), sum_qty=F.sum(F.col("l_quantity").cast("long")), max_price=F.max("l_extendedprice")).flatten()


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) net from lineitem where l_quantity >= 45")
def filter_map(s, d):
    return of(s, d, "lineitem").filter("l_quantity >= 45").map(l_orderkey="l_orderkey", l_linenumber="l_linenumber", net=F.col("l_extendedprice") * (1 - F.col("l_discount"))).df


@query("select word, count(*) as count from (select unnest(string_split(text, ' ')) as word from documents) where word <> '' group by word")
def flat_map_words(s, d):
    return of(s, d, "documents", "text").flat_map("word", F.split("text", " ")).filter("word <> ''").group_by("word").count().df


@query("select event_type, count(distinct user_id) users from events group by 1")
def uv_nested_distinct(s, d):
    return of(s, d, "events").group_by("event_type").apply_values(lambda p: p.distinct_count("user_id", "users")).flatten()


@query("""select o_custkey, o_orderkey, o_totalprice from orders
qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) <= 5""")
def grouped_top5(s, d):
    return of(s, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").group_by("o_custkey").top(5, "o_totalprice", "o_orderkey").flatten()


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 5")
def global_min5(s, d):
    return of(s, d, "orders", "o_orderkey", "o_totalprice").top(5, "o_totalprice", "o_orderkey", reverse=False).df


@query("""select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) rn,
count(*) over (partition by o_custkey) n from orders) where rn <= n // 2""")
def take_scalar_n(s, d):
    orders = of(s, d, "orders", "o_custkey", "o_orderkey").group_by("o_custkey")
    half = orders.count("c").map(half=F.floor(F.col("c") / 2))
    return orders.sort_by("o_orderkey").take(half).flatten()


@query("select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def join3(s, d):
    orders = of(s, d, "orders", "o_orderkey", "o_custkey").map(custkey="o_custkey", o_orderkey="o_orderkey")
    customers = of(s, d, "customer").map(custkey="c_custkey", c_name="c_name", nationkey="c_nationkey")
    nations = of(s, d, "nation").map(nationkey="n_nationkey", n_name="n_name")
    return rel.join(rel.join(orders, customers, on=["custkey"]), nations, on=["nationkey"]).map(o_orderkey="o_orderkey", c_name="c_name", n_name="n_name").df


def _by_key(s, d):
    """Three inputs by customer key, of which each has keys that others lack."""
    customers = of(s, d, "customer").map(k="c_custkey", c_name="c_name")
    orders = Collection(of(s, d, "orders").group_by(k=F.col("o_custkey")).count("n_orders").df)
    suppliers = of(s, d, "supplier").map(k="s_suppkey", s_name="s_name")
    return customers, orders, suppliers


_KEYED = """with c as (select c_custkey k, c_name from customer), o as (select o_custkey k, count(*) n_orders from orders group by 1), s as (select s_suppkey k, s_name from supplier) """


@query(_KEYED + "select o.k, n_orders, c_name, s_name from o left join c on o.k = c.k left join s on o.k = s.k")
def left_join_pivot(s, d):
    customers, orders, suppliers = _by_key(s, d)
    return rel.join(orders, customers, suppliers, on=["k"], how="left").df


@query(_KEYED + "select s.k, c_name, n_orders, s_name from s left join c on c.k = s.k left join o on o.k = s.k")
def right_join_pivot(s, d):
    return rel.join(*_by_key(s, d), on=["k"], how="right").df


@query(_KEYED + "select k, c_name, n_orders, s_name from c full join o using (k) full join s using (k)")
def full_join(s, d):
    return rel.join(*_by_key(s, d), on=["k"], how="full").df


@query("""select c.c_custkey as key, coalesce(c.c_acctbal, s.s_acctbal) as balance, c.c_name, s.s_name from customer c full join supplier s on c.c_custkey = s.s_suppkey + 7""")
def schema_join_merge(s, d):
    a = of(s, d, "customer").map(key="c_custkey", balance="c_acctbal", c_name="c_name")
    b = of(s, d, "supplier").map(key=F.col("s_suppkey") + 7, other="s_acctbal", s_name="s_name")
    out = rel.merge_join(a, b, ["key"], "full")
    return out.map(key="key", balance=F.coalesce("balance", "other"), c_name="c_name", s_name="s_name").df


@query("select o_custkey as k from orders where o_custkey not in (select s_suppkey from supplier)")
def subtract_dups(s, d):
    return rel.subtract(of(s, d, "orders").map(k="o_custkey"), of(s, d, "supplier").map(k="s_suppkey")).df


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def intersect(s, d):
    return rel.intersection(of(s, d, "customer").map(k="c_nationkey"), of(s, d, "supplier").map(k="s_nationkey")).df


@query("select c_nationkey as k from customer intersect all select s_nationkey from supplier")
def intersect_dups(s, d):
    return rel.intersection(of(s, d, "customer").map(k="c_nationkey"), of(s, d, "supplier").map(k="s_nationkey"), duplicated=True).df


@query("""select k, cast(sum(a) as bigint) count_a, cast(sum(b) as bigint) count_b from (select c_nationkey k, 1 a, 0 b from customer union all select s_nationkey, 0, 1 from supplier)
group by k having sum(a) <> sum(b)""")
def diff_counts(s, d):
    return rel.diff(of(s, d, "customer").map(k="c_nationkey"), of(s, d, "supplier").map(k="s_nationkey")).df


@query("select o_orderkey as k from orders where o_totalprice > 200000 union all select l_orderkey from lineitem where l_quantity = 50")
def union_bags(s, d):
    return rel.union(of(s, d, "orders").filter("o_totalprice > 200000").map(k="o_orderkey"), of(s, d, "lineitem").filter("l_quantity = 50").map(k="l_orderkey")).df


@query("""select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')
and o_custkey not in (select c_custkey from customer where c_nationkey = 3)""")
def white_black(s, d):
    customers = of(s, d, "customer").map(o_custkey="c_custkey", c_mktsegment="c_mktsegment", c_nationkey="c_nationkey")
    white = rel.semi(of(s, d, "orders", "o_orderkey", "o_custkey"), customers.filter("c_mktsegment = 'BUILDING'"), ["o_custkey"])
    return rel.anti(white, customers.filter("c_nationkey = 3"), ["o_custkey"]).df


@query("select l_suppkey, cast(floor(sum(l_linenumber) / count(*)) as bigint) avg_line from lineitem group by 1")
def floor_avg(s, d):
    return of(s, d, "lineitem").group_by("l_suppkey").floor_avg("l_linenumber", "avg_line").flatten()


@query("select o_custkey, count(*) filter (where o_totalprice > 300000) as count from orders group by 1")
def empty_group_count(s, d):
    return of(s, d, "orders", "o_custkey", "o_totalprice").group_by("o_custkey").filter("o_totalprice > 300000").count().flatten()


@query("select event_id, user_id, cast(sum(cast(floor(value) as bigint)) over (partition by user_id order by ts, event_id) as bigint) running from events")
def running_sum(s, d):
    e = of(s, d, "events").update(v=F.floor("value")).group_by("user_id").sort_by("ts", "event_id").running(running=F.sum("v"))
    return e.df.select("event_id", "user_id", "running")


@query("select * from (select o_orderstatus, count(*) orders from orders group by 1), (select l_returnflag, count(*) lines from lineitem group by 1)")
def cartesian(s, d):
    orders = Collection(of(s, d, "orders").group_by("o_orderstatus").count("orders").df)
    return rel.cartesian(orders, Collection(of(s, d, "lineitem").group_by("l_returnflag").count("lines").df)).df


@query("select distinct o_custkey, o_orderstatus from orders")
def distinct_cols(s, d):
    return of(s, d, "orders", "o_custkey", "o_orderstatus").distinct().df


@query("""with a as (select event_type, nullif(event_type, 'click') k, count(*) n from events group by 1, 2), b as (select distinct nullif(event_type, 'click') k from events)
select a.event_type, a.n from a join b on a.k is not distinct from b.k""")
def null_key_join(s, d):
    e = of(s, d, "events").update(k=F.nullif(F.col("event_type"), F.lit("click")))
    a = Collection(e.group_by("event_type", "k").count("n").df)
    return rel.join(a, Collection(e.df.select("k").distinct()), on=["k"]).map(event_type="event_type", n="n").df


@query("""with recursive e as (select o_custkey src, o_orderkey dst from orders), r(i, node, value) as (
select 0, node, cast(1 as bigint) from (select src node from e union select dst from e) union all
select i + 1, dst, cast(sum(value) as bigint) from (select r.i, e.dst, r.value from r join e on e.src = r.node where r.i < 3) group by i, dst)
select node, value from r where i = 3""")
def pagerank3(s, d):
    return rel.pagerank(of(s, d, "orders").df.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), 3)


@query("""select l_returnflag, l_linestatus, count(*) n, cast(sum(l_linenumber) as bigint) lines from lineitem group by rollup (l_returnflag, l_linestatus)""")
def rollup_levels(s, d):
    return of(s, d, "lineitem").rollup("l_returnflag", "l_linestatus", n=F.count(F.lit(1)), lines=F.sum("l_linenumber")).df


@query("select l_suppkey, max(l_extendedprice) max_price, min(l_extendedprice) min_price from lineitem group by 1")
def max_min(s, d):
    t = fields.group_by(of(s, d, "lineitem", "l_suppkey", "l_extendedprice"), "l_suppkey")
    return fields.agg(t, lambda c: {"max_price": F.max(c.l_extendedprice), "min_price": F.min(c.l_extendedprice)}).df


@query("select o_custkey, string_agg(o_orderstatus, '>' order by o_orderkey) statuses from orders group by 1")
def fold_ordered(s, d):
    t = of(s, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").group_by("o_custkey").sort_by("o_orderkey")
    return t.fold(F.lit(""), lambda acc, x: F.when(acc == "", x).otherwise(F.concat(acc, F.lit(">"), x)), "statuses", F.col("o_orderstatus")).flatten()


@query("select o_custkey, o_orderkey, o_totalprice - (select round(max(o_totalprice), 2) from orders) gap from orders where o_totalprice > 400000")
def scalar_side_input(s, d):
    orders = of(s, d, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    top = orders.max("o_totalprice", "top").map(top=F.round("top", 2))
    return orders.filter("o_totalprice > 400000").with_side(top).map(o_custkey="o_custkey", o_orderkey="o_orderkey", gap=F.col("o_totalprice") - F.col("top")).df


@query("""select c_mktsegment, c_nationkey, count(*) as count from customer group by 1, 2""")
def nested_two_levels(s, d):
    count = lambda p: p.count()
    return of(s, d, "customer").group_by("c_mktsegment").apply_values(lambda t: t.group_by("c_nationkey").apply_values(count)).flatten()


@query("""select coalesce(a.k, b.k) k, coalesce(a.n, 0) orders, coalesce(b.n, 0) suppliers from (select o_custkey k, count(*) n from orders group by 1) a
full join (select s_suppkey k, count(*) n from supplier group by 1) b on a.k = b.k""")
def cogroup_counts(s, d):
    a, b = rel.cogroup(of(s, d, "orders").map(k="o_custkey"), of(s, d, "supplier").map(k="s_suppkey"), on=["k"])
    return rel.join(Collection(a.count("orders").df), Collection(b.count("suppliers").df), on=["k"]).df


@query("select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) n from events group by 1, 2")
def window_tumbling(s, d):
    out = windows.tumbling(of(s, d, "events").df, "ts", "1 hour", keys=("event_type",), n=F.count(F.lit(1)))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""select min(ts) window_start, user_id, count(*) n from (select *, sum(fresh) over (partition by user_id order by ts, event_id) g from (select *,
case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end fresh from events)) group by user_id, g""")
def window_session(s, d):
    out = windows.sessions(of(s, d, "events").df, "ts", "30 minutes", ("user_id",), n=F.count(F.lit(1)))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select o_custkey, case when sum(cast(o_totalprice as bigint)) > 500000 then 1 else 0 end as count from orders group by 1")
def empty_group_chain(s, d):
    t = of(s, d, "orders").map(o_custkey="o_custkey", price=F.col("o_totalprice").cast("long")).group_by("o_custkey").sum("price")
    return t.filter("price > 500000").sum("price").count().flatten()


_GROUPED = """with a as (select o_orderpriority p, o_custkey k from orders where o_orderstatus = 'F'), b as (select o_orderpriority p, o_custkey k from orders where o_orderstatus = 'O') """


def _statuses(s, d):
    t = of(s, d, "orders", "o_orderpriority", "o_custkey", "o_orderstatus")
    part = lambda status: t.filter(F.col("o_orderstatus") == status).map(p="o_orderpriority", k="o_custkey").group_by("p")
    return part("F"), part("O")


@query(_GROUPED + "select p, k from a intersect all select p, k from b")
def grouped_intersection(s, d):
    return rel.intersection(*_statuses(s, d), duplicated=True).flatten()


@query(_GROUPED + "select p, k from a where not exists (select 1 from b where b.p = a.p and b.k = a.k)")
def grouped_subtract(s, d):
    return rel.subtract(*_statuses(s, d)).flatten()


@query(_GROUPED + """select p, k, cast(sum(x) as bigint) count_a, cast(sum(y) as bigint) count_b from (select p, k, 1 x, 0 y from a union all select p, k, 0, 1 from b) group by 1, 2 having sum(x) <> sum(y)""")
def grouped_diff(s, d):
    return rel.diff(*_statuses(s, d)).flatten()


@query(_GROUPED + "select a.p, a.k, n, m from (select p, k, count(*) n from a group by 1, 2) a join (select p, k, count(*) m from b group by 1, 2) b on a.p = b.p and a.k = b.k")
def grouped_join(s, d):
    a, b = _statuses(s, d)
    a, b = (t.group_by("k").count(n).ungroup() for t, n in ((a, "n"), (b, "m")))
    return rel.join(a, b, on=["k"]).flatten()


@query(_GROUPED + "select * from (select p, min(k) lo, max(k) hi from a group by 1) join (select p, count(*) n from b group by 1) using (p)")
def grouped_cartesian(s, d):
    a, b = _statuses(s, d)
    return rel.cartesian(fields.agg(a, lambda c: {"lo": F.min(c.k), "hi": F.max(c.k)}), b.count("n")).flatten()


@query(_GROUPED + "select p, count(*) as count from (select * from a union all select * from b) group by 1")
def grouped_union(s, d):
    return rel.union(*_statuses(s, d)).count().flatten()


@query("""select l_suppkey, cast(floor(sum(l_linenumber) / count(*)) as bigint) whole, cast(sum(l_linenumber) % count(*) as bigint) rest, count(*) > 50 as many from lineitem group by 1""")
def scalar_arithmetic(s, d):
    t = of(s, d, "lineitem", "l_suppkey", "l_linenumber").group_by("l_suppkey")
    total, n = t.sum("l_linenumber"), t.count()
    out = make_tuple(total / n, total % n, n > 50).df
    return out.select("l_suppkey", F.col("tuple._0").alias("whole"), F.col("tuple._1").alias("rest"), F.col("tuple._2").alias("many"))


@query("""select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderpriority, o_totalprice desc, o_orderkey) <= 3""")
def sort_mixed_take(s, d):
    t = of(s, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice").group_by("o_custkey")
    return t.sort_by(ASC("o_orderpriority"), DESC("o_totalprice"), "o_orderkey").take(3).map(o_orderkey="o_orderkey").flatten()


@query("select o_custkey, max_by(o_orderkey, o_totalprice * 100000000 + o_orderkey) dearest, min_by(o_orderkey, o_totalprice * 100000000 + o_orderkey) cheapest from orders group by 1")
def max_by_key(s, d):
    t = of(s, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").group_by("o_custkey")
    by = F.col("o_totalprice") * 100000000 + F.col("o_orderkey")
    return rel.cartesian(t.max("o_orderkey", "dearest", by=by), t.min("o_orderkey", "cheapest", by=by)).flatten()


@query("select o_custkey, string_agg(o_orderstatus, '' order by o_orderkey) as text from orders group by 1")
def sum_of_text(s, d):
    return of(s, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").group_by("o_custkey").sort_by("o_orderkey").sum("o_orderstatus", "text").flatten()


@query("select user_id, string_agg(event_type, ',' order by ts, event_id) as kinds from events group by 1")
def to_list_ordered(s, d):
    t = of(s, d, "events", "user_id", "event_id", "ts", "event_type").group_by("user_id").sort_by("ts", "event_id")
    return t.to_list("l").df.select("user_id", F.array_join(F.transform("l", lambda x: x["event_type"]), ",").alias("kinds"))


@query("""select c_mktsegment, string_agg(c_nationkey || ':' || n, ',' order by c_nationkey) as counts from (select c_mktsegment, c_nationkey, count(*) n from customer group by 1, 2) group by 1""")
def to_dict_nested(s, d):
    t = of(s, d, "customer", "c_mktsegment", "c_nationkey").update(one=F.lit(1)).group_by("c_mktsegment", "c_nationkey").count()
    return t.to_dict().df.select(F.explode("dict").alias("c_mktsegment", "m")).select("c_mktsegment", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("counts"))


@query("select o_orderpriority || '/' || o_orderstatus as label, count(*) n from orders group by 1")
def apply_key_values(s, d):
    t = of(s, d, "orders", "o_orderpriority", "o_orderstatus").group_by("o_orderpriority")
    labelled = t.apply_key_values(lambda key, p: p.map(lambda status, k: {"label": F.concat_ws("/", k, status)}, key))
    return Collection(labelled.df).map(label="label").group_by("label").count("n").flatten()


@query("select o_custkey, count(*) n from orders where o_orderpriority in (select o_orderpriority from orders group by 1 having count(*) > (select count(*) / 5 from orders)) group by 1")
def collection_side_input(s, d):
    orders = of(s, d, "orders", "o_custkey", "o_orderpriority")
    usual = Collection(of(s, d, "orders", "o_orderpriority").group_by("o_orderpriority").count("n").df)
    fifth = of(s, d, "orders").count().map(f=F.col("count") / 5)
    frequent = usual.filter(lambda r, f: r.n > f, fifth).map(o_orderpriority="o_orderpriority")
    return orders.filter(lambda r, side: F.array_contains(side, r.o_orderpriority), frequent).group_by("o_custkey").apply_values(udf.count("n")).flatten()


@query("select date_trunc('month', o_orderdate) as month, count(*) n from orders group by 1")
def group_by_function(s, d):
    return of(s, d, "orders", "o_orderdate").group_by(month=lambda at: F.date_trunc("month", at).cast("timestamp_ntz")).count("n").flatten()


@query("select lower(n) as name, x from (select c_name n, unnest([c_custkey, c_nationkey]) x from customer)")
def select_product(s, d):
    return fields.select(of(s, d, "customer"), lambda c: {"name": F.lower(c.c_name), "x": fields.each(F.array(c.c_custkey, c.c_nationkey.cast("long")))}).df


@query("""select l_suppkey, n, flag from (select l_suppkey, count(*) n from lineitem group by 1) join (select distinct l_suppkey, l_returnflag flag from lineitem) using (l_suppkey)""")
def agg_product(s, d):
    t = fields.group_by(of(s, d, "lineitem", "l_suppkey", "l_returnflag"), "l_suppkey")
    return fields.flatten(fields.agg_as(t, "l_returnflag => n, flag", lambda flag: (F.count(flag), fields.each(F.collect_set(flag))))).df


@query("select c_custkey, c_name, s_suppkey, s_name from customer left join supplier on c_nationkey = s_nationkey and c_custkey % 100 = s_suppkey % 100")
def record_join(s, d):
    a = fields.update(of(s, d, "customer", "c_custkey", "c_name", "c_nationkey"), lambda c: {"n": c.c_nationkey, "m": c.c_custkey % 100})
    b = fields.update(of(s, d, "supplier", "s_suppkey", "s_name", "s_nationkey"), lambda c: {"n": c.s_nationkey, "m": c.s_suppkey % 100})
    return fields.left_join(a, b, fields="n, m").df.select("_0.c_custkey", "_0.c_name", "_1.s_suppkey", "_1.s_name")


@query("select distinct o_custkey, o_orderpriority from orders")
def distinct_by_fields(s, d):
    return fields.select(fields.distinct(of(s, d, "orders"), "o_custkey, o_orderpriority"), "o_custkey, o_orderpriority").df


@query("select cast(c_custkey as varchar) as key, c_acctbal > 0 as positive from customer")
def typed_fields(s, d):
    p = fields.tuple_to_dict(of(s, d, "customer", "c_custkey", "c_acctbal"), "key, balance")
    return fields.as_schema(fields.update(p, lambda c: {"balance": c.balance > 0}), fields.of("key", ("positive", "boolean"))).df


# functions that run as Python


@query("select l_returnflag, count(*) n from lineitem where cast(l_quantity as bigint) % 7 = 3 group by 1")
def python_filter_map(s, d):
    p = of(s, d, "lineitem", "l_returnflag", "l_quantity").filter(lambda r: int(r.l_quantity) % 7 == 3, opaquely=True)
    return p.map(lambda r: r.l_returnflag, returns="l_returnflag string").update(one=F.lit(1)).group_by("l_returnflag").count("n").flatten()


@query("select word, count(*) n from (select unnest(string_split(lower(props), ',')) as word from events) group by 1")
def python_flat_map(s, d):
    p = of(s, d, "events", "props").filter("props is not null").flat_map(lambda props: props.lower().split(","), returns="word string")
    return p.update(one=F.lit(1)).group_by("word").count("n").flatten()


@query("select l_suppkey, cast(sum(l_linenumber) as bigint) total, count(*) n from lineitem group by 1")
def python_aggregate(s, d):
    t = of(s, d, "lineitem", "l_suppkey", "l_linenumber").group_by("l_suppkey")
    return t.aggregate((0, 0), lambda a, x: (a[0] + x, a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), "total long, n long").flatten()


@query("select o_custkey, bit_xor(o_orderkey) x, cast(sum(o_orderkey) as bigint) total from orders group by 1")
def python_reduce_combine(s, d):
    t = of(s, d, "orders", "o_custkey", "o_orderkey").group_by("o_custkey")
    return rel.cartesian(t.reduce(lambda a, b: a ^ b, returns="x long"), t.combine(lambda xs: sum(xs), "total long")).flatten()


@query("select l_suppkey, cast(sum(l_linenumber) as bigint) l_linenumber from lineitem group by 1")
def builtin_reduce(s, d):
    return of(s, d, "lineitem", "l_suppkey", "l_linenumber").group_by("l_suppkey").reduce(operator.add).flatten()


@query("select event_id, user_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)), 0) gap from events")
def python_transform(s, d):
    class Gaps(Transformer):
        def begin_process(self):
            self.last = None
            return ()

        def process(self, r):
            yield (r.event_id, 0 if self.last is None else (r.ts - self.last) // timedelta(microseconds=1))
            self.last = r.ts

    t = of(s, d, "events", "user_id", "event_id", "ts").group_by("user_id").sort_by("ts", "event_id")
    return t.transform(Gaps(), returns="event_id long, gap long").flatten()


@query("select user_id, string_agg(substr(event_type, 1, 1), '' order by ts, event_id) as path from events group by 1")
def python_accumulate(s, d):
    t = of(s, d, "events", "user_id", "event_id", "ts", "event_type").group_by("user_id").sort_by("ts", "event_id")
    return t.accumulate("", lambda path, r: path + r.event_type[:1], "path string").flatten()


# sources and sinks, there and back


def _folder(s) -> str:
    """A new path in the folder that the cluster shares."""
    import tempfile

    base = s.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


@query("select c_custkey, c_name, c_nationkey, c_mktsegment from customer")
def fields_there_and_back(s, d):
    path = _folder(s)
    targets.write(of(s, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment"), targets.TextTarget(path, separator="|").with_compression())
    return text.read_fields(s, path, columns="c_custkey long, c_name string, c_nationkey int, c_mktsegment string", separator="|").df


@query("select o_orderpriority, count(*) n, min(o_orderkey) least from orders group by 1")
def files_by_key(s, d):
    path = _folder(s)
    orders = of(s, d, "orders", "o_orderpriority", "o_orderkey")
    text.write_fields(orders, path, ["o_orderpriority", "o_orderkey"], partitions=5, partition_id=F.substring("o_orderpriority", 1, 1).cast("int") - 1, sort_by=[F.asc("o_orderkey")])
    t = text.read_fields(s, path, columns="o_orderpriority string, o_orderkey long", partitioned=True)
    out = fields.agg(t, lambda c: {"o_orderpriority": F.min(c.o_orderpriority), "n": F.count(F.lit(1)), "least": F.min(c.o_orderkey)})
    return out.flatten_values().df


@query("select s_suppkey, s_name from supplier")
def pairs_there_and_back(s, d):
    path = _folder(s)
    text.write_sequence(of(s, d, "supplier", "s_suppkey", "s_name"), path, "s_suppkey", "s_name", lambda k: k.to_bytes(8, "big"), str.encode)
    return text.read_sequence(s, path, decode_key=lambda b: int.from_bytes(b, "big"), decode_value=bytes.decode, returns="s_suppkey long, s_name string").df


@query("select c_mktsegment, c_custkey from customer")
def pipe_by_key(s, d):
    t = of(s, d, "customer", "c_mktsegment", "c_custkey").group_by("c_mktsegment")
    return text.pipe(t, "cat", ["c_custkey"], returns="c_custkey string").df.select("c_mktsegment", F.col("c_custkey").cast("long"))


@query("select p_brand, count(*) n from part group by 1")
def user_source(s, d):
    """A user's source whose splits are the brands, each read from a table that Spark wrote."""
    brands = [r.p_brand for r in of(s, d, "part", "p_brand").distinct().df.orderBy("p_brand").limit(1000).collect()]
    p = user.read_user(s, brands, lambda brand: iter([(brand,)]), "p_brand string")
    return rel.join(p, of(s, d, "part", "p_brand", "p_partkey"), on=["p_brand"]).group_by("p_brand").count("n").flatten()


@query("""select window_start, event_type, count(*) n from (select event_type, unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) window_start from events) group by 1, 2""")
def window_sliding(s, d):
    t = windows.window_into(of(s, d, "events").group_by("event_type"), "ts", "60 minutes", slide="30 minutes").count("n")
    return t.df.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("select o_custkey as k from orders intersect select s_suppkey from supplier")
def one_row_per_key(s, d):
    return rel.one_per_key(of(s, d, "orders").map(k="o_custkey"), of(s, d, "supplier").map(k="s_suppkey"), ["k"]).df


@query("select o_custkey, count(*) filter (where o_orderstatus = 'P') = 0 as empty from orders group by 1")
def empty_groups(s, d):
    return of(s, d, "orders", "o_custkey", "o_orderstatus").group_by("o_custkey").filter("o_orderstatus = 'P'").is_empty().flatten()


@query("select distinct l_returnflag, l_linestatus from lineitem")
def keys_of_two_levels(s, d):
    return of(s, d, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber").group_by("l_returnflag").group_by("l_linestatus").extract_keys(2)


@query("select o_orderpriority as p, count(*) + (select count(*) from supplier) as count from orders group by 1")
def collection_in_every_group(s, d):
    t = of(s, d, "orders").map(p="o_orderpriority", k="o_custkey").group_by("p")
    return t.apply_values(lambda own, more: rel.union(own, more).count(), of(s, d, "supplier").map(k="s_suppkey")).flatten()


@query("select n_nationkey as x from nation union all select c_custkey from customer union all select s_nationkey from supplier")
def union_widened(s, d):
    return rel.union(of(s, d, "nation").map(x="n_nationkey"), of(s, d, "customer").map(x="c_custkey"), of(s, d, "supplier").map(other="s_nationkey")).df


def _merged(s, d, how):
    a, b = of(s, d, "customer").map(key="c_custkey", name="c_name"), of(s, d, "orders").map(key="o_custkey", o_orderkey="o_orderkey", name="o_orderstatus")
    return rel.merge_join(a, b, ["key"], how).df


@query("select c_custkey as key, o_orderkey, c_name as name from customer join orders on c_custkey = o_custkey")
def merge_inner(s, d):
    return _merged(s, d, "inner")


@query("select c_custkey as key, o_orderkey, c_name as name from customer left join orders on c_custkey = o_custkey")
def merge_left(s, d):
    return _merged(s, d, "left")


@query("select o_custkey as key, o_orderkey, o_orderstatus as name from orders left join customer on c_custkey = o_custkey")
def merge_right(s, d):
    return _merged(s, d, "right")


@query("select c_custkey, c_name, s_suppkey, s_name from customer full join supplier on c_custkey = s_suppkey * 3")
def record_full_join(s, d):
    a = of(s, d, "customer").map(k="c_custkey", c_custkey="c_custkey", c_name="c_name")
    b = of(s, d, "supplier").map(k=F.col("s_suppkey") * 3, s_suppkey="s_suppkey", s_name="s_name")
    return fields.full_join(a, b, fields="k").df.select("_0.c_custkey", "_0.c_name", "_1.s_suppkey", "_1.s_name")


@query("select count(*) as records, sum(n) as total from (select 1 as n from orders)")
def every_record_a_group(s, d):
    t = of(s, d, "orders", "o_orderkey").group_by_every_record().count("n")
    return Collection(t.df.select("n")).agg(records=F.count(F.lit(1)), total=F.sum("n")).df


@query("select o_custkey, count(*) n, cast(sum(o_orderkey) as bigint) total, max(o_totalprice) most from orders group by 1")
def fields_agg(s, d):
    t = fields.group_by(of(s, d, "orders"), "o_custkey", "o_orderkey, o_totalprice")
    return fields.flatten(fields.agg(t, lambda c: {"n": F.count(c.o_orderkey), "total": F.sum(c.o_orderkey), "most": F.max(c.o_totalprice)})).df


@query("select p_partkey, p_name, p_size * 2 as p_size, p_brand, p_type, p_retailprice, p_retailprice > 1000 as dear from part")
def fields_update(s, d):
    return fields.update(of(s, d, "part"), lambda c: {"p_size": c.p_size * 2, "dear": c.p_retailprice > 1000}).df


@query("select user_id, event_type, count(*) n from events group by 1, 2")
def pipe_lines(s, d):
    """Through a shell command that puts the fields in another order."""
    out = text.pipe(of(s, d, "events"), "awk -F'\\t' '{print $2 \"\\t\" $1}'", ["event_type", "user_id"], returns="user_id string, event_type string")
    return out.update(user_id=F.col("user_id").cast("long"), one=F.lit(1)).group_by("user_id", "event_type").count("n").flatten()


@query("select c_nationkey, c_mktsegment from customer")
def lines_there_and_back(s, d):
    path = _folder(s)
    text.write_lines(of(s, d, "customer"), path, F.concat_ws(" ", "c_nationkey", "c_mktsegment"), partitions=3)
    at = F.split("value", " ", 2)
    return text.read_lines(s, path).map(c_nationkey=at[0].cast("int"), c_mktsegment=at[1]).df
