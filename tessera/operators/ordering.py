"""Order, limits and top-k: ORDER BY with LIMIT is one top-k per task, merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import operator


@operator("select o_orderpriority, o_totalprice, o_orderkey from orders order by o_orderpriority, o_totalprice desc, o_orderkey")
def sort_multi(t):
    return t.orders.select("o_orderpriority", "o_totalprice", "o_orderkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")


@operator("select p_partkey, nullif(p_size, 7) as size_or_null from part order by size_or_null desc nulls last, p_partkey")
def sort_nulls(t):
    return t.part.select("p_partkey", F.nullif("p_size", F.lit(7)).alias("size_or_null")).orderBy(F.desc_nulls_last("size_or_null"), "p_partkey")


@operator("select p_partkey, nullif(p_size, 7) as size_or_null from part order by size_or_null asc nulls first, p_partkey desc")
def sort_nulls_first(t):
    return t.part.select("p_partkey", F.nullif("p_size", F.lit(7)).alias("size_or_null")).orderBy(F.asc_nulls_first("size_or_null"), F.desc("p_partkey"))


@operator("select p_partkey, nullif(p_size, 7) as size_or_null from part order by size_or_null asc nulls last, p_partkey")
def sort_nulls_asc_last(t):
    return t.part.select("p_partkey", F.nullif("p_size", F.lit(7)).alias("size_or_null")).orderBy(F.asc_nulls_last("size_or_null"), "p_partkey")


@operator("select p_partkey, nullif(p_size, 7) as size_or_null from part order by size_or_null desc nulls first, p_partkey")
def sort_nulls_desc_first(t):
    return t.part.select("p_partkey", F.nullif("p_size", F.lit(7)).alias("size_or_null")).orderBy(F.desc_nulls_first("size_or_null"), "p_partkey")


@operator("select o_custkey, count(*) as n from orders group by o_custkey order by n desc, o_custkey limit 10")
def limit_topk(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


@operator("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 10 offset 5")
def offset(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(5).limit(10)
