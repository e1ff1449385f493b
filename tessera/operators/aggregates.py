"""Aggregates: partial before the shuffle, exact on decimals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import exact_avg, exact_sum, money, ratio
from .registry import operator

_D = "cast({} as decimal(15,2))"
_Q, _E = _D.format("l_quantity"), _D.format("l_extendedprice")


@operator(f"select cast(sum({_Q}) as double) as total, count(*) as n, min(l_shipdate) as first_day, max(l_shipdate) as last_day from lineitem")
def agg_scalar(t):
    return t.lineitem.agg(exact_sum("l_quantity").alias("total"), F.count("*").alias("n"), F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"))


@operator("select count(*) as all_rows, count(l_partkey) as matched from orders left join lineitem on o_orderkey = l_orderkey and l_quantity > 48")
def agg_count_col(t):
    joined = t.orders.join(t.lineitem.where("l_quantity > 48"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.agg(F.count("*").alias("all_rows"), F.count("l_partkey").alias("matched"))


@operator(f"select l_suppkey, cast(sum({_E}) as double) as total from lineitem group by l_suppkey")
def agg_sum(t):
    return t.lineitem.groupBy("l_suppkey").agg(exact_sum("l_extendedprice").alias("total"))


@operator(f"select l_returnflag, cast(sum({_Q}) as double) / count(l_quantity) as mean from lineitem group by l_returnflag")
def agg_avg(t):
    return t.lineitem.groupBy("l_returnflag").agg(exact_avg("l_quantity").alias("mean"))


@operator("select p_brand, min(p_size) as least, max(p_retailprice) as most, min(p_name) as first_name from part group by p_brand")
def agg_min_max(t):
    return t.part.groupBy("p_brand").agg(F.min("p_size").alias("least"), F.max("p_retailprice").alias("most"), F.min("p_name").alias("first_name"))


@operator("select l_returnflag, count(distinct l_suppkey) as suppliers, count(*) as n from lineitem group by l_returnflag")
def agg_count_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"))


@operator("select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as order_key from orders group by o_custkey")
def agg_first(t):
    """Of several rows of a group the first in a stated order: by date, then by key."""
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("order_key"))


@operator("select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as order_key from orders group by o_custkey")
def agg_last(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("order_key"))


@operator("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
def agg_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@operator(f"select l_returnflag, cast(sum({_E} * (1 - cast(l_discount as decimal(15,2)))) as double) as revenue, sum(case when l_tax > 0.04e0 then 1 else 0 end) as taxed from lineitem group by l_returnflag")
def agg_over_expr(t):
    revenue = F.sum(money("l_extendedprice") * (1 - money("l_discount"))).cast("double")
    return t.lineitem.groupBy("l_returnflag").agg(revenue.alias("revenue"), F.sum(F.when(F.col("l_tax") > 0.04, 1).otherwise(0)).alias("taxed"))


@operator(f"select l_linestatus, 100e0 * cast(sum(case when l_returnflag = 'R' then {_E} else 0 end) as double) / nullif(cast(sum({_E}) as double), 0) as share from lineitem group by l_linestatus")
def agg_ratio(t):
    returned = F.sum(F.when(F.col("l_returnflag") == "R", money("l_extendedprice")).otherwise(0)).cast("double")
    return t.lineitem.groupBy("l_linestatus").agg(ratio(F.lit(100.0) * returned, exact_sum("l_extendedprice")).alias("share"))


@operator("select n, count(*) as customers from (select o_custkey, count(*) as n from orders group by o_custkey) group by n")
def agg_nested(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("customers"))


@operator("select cast(extract(year from o_orderdate) as int) as y, substring(o_orderpriority from 1 for 1) as p, count(*) as n from orders group by 1, 2")
def agg_computed_key(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), F.substring("o_orderpriority", 1, 1).alias("p")).agg(F.count("*").alias("n"))


@operator("select l_tax, count(*) as n from lineitem group by l_tax")
def agg_double_key(t):
    return t.lineitem.groupBy("l_tax").agg(F.count("*").alias("n"))


@operator("""select l_returnflag, l_linestatus, l_linenumber, l_tax, l_discount, l_quantity, l_suppkey, l_partkey, l_orderkey, count(*) as n from lineitem
group by l_returnflag, l_linestatus, l_linenumber, l_tax, l_discount, l_quantity, l_suppkey, l_partkey, l_orderkey""")
def agg_many_keys(t):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax", "l_discount", "l_quantity", "l_suppkey", "l_partkey", "l_orderkey"]
    return t.lineitem.groupBy(*keys).agg(F.count("*").alias("n"))
