"""Scans, projections, constant rows, sets of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import cached
from ..sources.delimited import round_trip
from .registry import operator


@operator("select * from supplier")
def scan_star(t):
    return t.supplier


@operator("select l_orderkey, l_linenumber from lineitem")
def scan_prune(t):
    return t.lineitem.select("l_orderkey", "l_linenumber")


@operator("select o_orderkey, o_custkey from orders where o_orderdate >= date '1996-01-01' and o_orderstatus = 'F'")
def scan_filter_pushed(t):
    return t.orders.where("o_orderdate >= date '1996-01-01' and o_orderstatus = 'F'").select("o_orderkey", "o_custkey")


@operator("select p_partkey as part_id, p_size * 2 as double_size, p_name from part")
def project(t):
    return t.part.select(F.col("p_partkey").alias("part_id"), (F.col("p_size") * 2).alias("double_size"), "p_name")


@operator("select * from (values (1, 'one'), (2, 'two'), (3, null)) as v(k, word)")
def scan_values(t):
    return t.spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "k int, word string")


@operator("select distinct o_orderstatus, o_orderpriority from orders")
def distinct(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@operator("select c_nationkey as k from customer union all select s_nationkey from supplier")
def union_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).unionAll(t.supplier.select("s_nationkey"))


@operator("select c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@operator("select * from part where p_name like '%red%'")
def scan_star_like(t):
    return t.part.where(F.col("p_name").like("%red%"))


@operator("select * from orders")
def scan_delimited(t):
    """Integer, date, double and string columns, loaded from delimited text."""
    return round_trip(t.orders)


@operator("select l_returnflag, l_shipdate from lineitem where l_quantity < 10")
def scan_delimited_filter(t):
    return round_trip(t.lineitem).where("l_quantity < 10").select("l_returnflag", "l_shipdate")


@operator("select n_regionkey, count(*) as n, min(n_name) as first_name from nation group by n_regionkey")
def scan_cached(t):
    return cached(t.nation).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.min("n_name").alias("first_name"))
