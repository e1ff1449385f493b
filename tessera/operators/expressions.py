"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import money
from .registry import operator

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


@operator("select p_partkey, p_size + 3 as plus, p_size - 3 as minus, p_size * p_size as square, 100 - p_size as from_hundred, -p_size as negated from part")
def expr_arith(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", (s + 3).alias("plus"), (s - 3).alias("minus"), (s * s).alias("square"), (100 - s).alias("from_hundred"), (-s).alias("negated"))


@operator("select p_partkey, cast(100 as double) / nullif(cast(p_size - 10 as double), 0) as quotient from part")
def expr_div(t):
    return t.part.select("p_partkey", (F.lit(100.0) / F.nullif((F.col("p_size") - 10).cast("double"), F.lit(0.0))).alias("quotient"))


@operator("select p_partkey, p_size % 7 as rest from part")
def expr_mod(t):
    return t.part.select("p_partkey", (F.col("p_size") % 7).alias("rest"))


@operator("select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as kind, case when p_size < 5 then 1 end as tiny from part")
def expr_case(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", F.when(s < 10, "small").when(s < 30, "medium").otherwise("large").alias("kind"), F.when(s < 5, 1).alias("tiny"))


@operator("select p_partkey, cast(p_size as varchar) as as_text, cast(p_size as double) as as_double, cast(p_retailprice as decimal(15,2)) as as_money from part")
def expr_cast(t):
    return t.part.select("p_partkey", F.col("p_size").cast("string").alias("as_text"), F.col("p_size").cast("double").alias("as_double"), money("p_retailprice").alias("as_money"))


@operator("select o_orderkey, cast(extract(year from o_orderdate) as int) as y from orders")
def expr_year(t):
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"))


@operator("select o_orderkey, cast(extract(month from o_orderdate) as int) as m, cast(extract(day from o_orderdate) as int) as d from orders")
def expr_month_day(t):
    return t.orders.select("o_orderkey", F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"))


@operator("select c_custkey, substring(c_name from 10 for 5) as part_of_name from customer")
def expr_substring(t):
    return t.customer.select("c_custkey", F.substring("c_name", 10, 5).alias("part_of_name"))


@operator("select c_custkey, cast(floor(c_acctbal) as bigint) as whole from customer")
def expr_floor(t):
    return t.customer.select("c_custkey", F.floor("c_acctbal").alias("whole"))


@operator("select p_partkey, cast(p_size > 25 as int) as is_large from part")
def expr_comparison_value(t):
    return t.part.select("p_partkey", (F.col("p_size") > 25).cast("int").alias("is_large"))


@operator("select l_orderkey, l_linenumber, l_partkey, cast(cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(15,2))) as double) as revenue from lineitem")
def expr_revenue(t):
    return t.lineitem.select(*_KEYS, (money("l_extendedprice") * (1 - money("l_discount"))).cast("double").alias("revenue"))


@operator("select s_suppkey, case when s_suppkey < 0 then error('negative key') else s_acctbal end as balance from supplier")
def expr_guard(t):
    """A row that must not occur ends the query."""
    balance = F.when(F.col("s_suppkey") < 0, F.raise_error(F.lit("negative key"))).otherwise(F.col("s_acctbal"))
    return t.supplier.select("s_suppkey", balance.alias("balance"))
