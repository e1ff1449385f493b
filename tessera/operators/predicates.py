"""Predicates: comparisons, logic, sets, patterns, dates and nulls. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import operator


def _keys(df, condition, *columns):
    return df.where(condition).select(*columns)


@operator("select p_partkey, p_size from part where p_size >= 45 or p_size < 3")
def filter_cmp_int(t):
    return _keys(t.part, (F.col("p_size") >= 45) | (F.col("p_size") < 3), "p_partkey", "p_size")


@operator("select c_custkey, c_acctbal from customer where c_acctbal > 9000.5e0")
def filter_cmp_double(t):
    return _keys(t.customer, F.col("c_acctbal") > 9000.5, "c_custkey", "c_acctbal")


@operator("select l_orderkey, l_partkey, l_suppkey from lineitem where l_suppkey > l_partkey")
def filter_col_col(t):
    return _keys(t.lineitem, F.col("l_suppkey") > F.col("l_partkey"), "l_orderkey", "l_partkey", "l_suppkey")


@operator("select l_orderkey, l_linenumber from lineitem where l_quantity * 2 > l_partkey + l_linenumber")
def filter_expr_expr(t):
    return _keys(t.lineitem, F.col("l_quantity") * 2 > F.col("l_partkey") + F.col("l_linenumber"), "l_orderkey", "l_linenumber")


@operator("select n_nationkey from nation where 1 = 1 and 2 <> 3")
def filter_literals(t):
    return _keys(t.nation, (F.lit(1) == 1) & (F.lit(2) != 3), "n_nationkey")


@operator("select p_partkey from part where 40 < p_size")
def filter_literal_first(t):
    return _keys(t.part, F.lit(40) < F.col("p_size"), "p_partkey")


@operator("select l_orderkey, l_linenumber, l_discount from lineitem where l_discount between 0.05e0 and 0.07e0")
def filter_between(t):
    return _keys(t.lineitem, F.col("l_discount").between(0.05, 0.07), "l_orderkey", "l_linenumber", "l_discount")


@operator("select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey in (1, 3, 5)")
def filter_in(t):
    return _keys(t.customer, F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_nationkey").isin(1, 3, 5), "c_custkey")


@operator("select o_orderkey from orders where o_orderstatus = 'P' or (o_orderpriority = '1-URGENT' and o_totalprice > 300000)")
def filter_or(t):
    return _keys(t.orders, (F.col("o_orderstatus") == "P") | ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000)), "o_orderkey")


@operator("select o_orderkey from orders where not (o_orderstatus = 'O' or o_orderstatus = 'F')")
def filter_not(t):
    return _keys(t.orders, ~((F.col("o_orderstatus") == "O") | (F.col("o_orderstatus") == "F")), "o_orderkey")


@operator("select p_partkey, p_name from part where p_name like '%red%'")
def filter_like_contains(t):
    return _keys(t.part, F.col("p_name").contains("red"), "p_partkey", "p_name")


@operator("select p_partkey, p_type from part where p_type like 'ST%'")
def filter_like_prefix(t):
    return _keys(t.part, F.col("p_type").startswith("ST"), "p_partkey", "p_type")


@operator("select p_partkey, p_name from part where p_name like '%ring'")
def filter_like_suffix(t):
    return _keys(t.part, F.col("p_name").endswith("ring"), "p_partkey", "p_name")


@operator("select o_orderkey from orders where o_orderpriority like '%NOT%SPEC%' or o_orderpriority like '_-HIGH'")
def filter_like_multi(t):
    return _keys(t.orders, F.col("o_orderpriority").like("%NOT%SPEC%") | F.col("o_orderpriority").like("_-HIGH"), "o_orderkey")


@operator("select p_partkey from part where p_type not like 'MEDIUM%' and p_name not like '%small%'")
def filter_not_like(t):
    return _keys(t.part, ~F.col("p_type").like("MEDIUM%") & ~F.col("p_name").like("%small%"), "p_partkey")


@operator("select c_custkey, c_name from customer where c_name >= 'Customer#000000100' and c_name < 'Customer#000000120'")
def filter_string_range(t):
    return _keys(t.customer, (F.col("c_name") >= "Customer#000000100") & (F.col("c_name") < "Customer#000000120"), "c_custkey", "c_name")


@operator("select o_orderkey from orders where o_orderdate >= date '1997-03-01' and o_orderdate < date '1997-03-01' + interval '1' month")
def filter_date(t):
    return t.orders.where("o_orderdate >= date '1997-03-01' and o_orderdate < date '1997-03-01' + interval '1' month").select("o_orderkey")


@operator("""select o_orderkey, l_partkey from orders left join lineitem on o_orderkey = l_orderkey and l_quantity > 49
where l_partkey is null or o_orderstatus is null""")
def filter_is_null(t):
    joined = t.orders.join(t.lineitem.where("l_quantity > 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return _keys(joined, F.col("l_partkey").isNull() | F.col("o_orderstatus").isNull(), "o_orderkey", "l_partkey")


@operator("select p_partkey from part where nullif(p_size, 7) is not null")
def filter_is_not_null(t):
    return _keys(t.part, F.nullif(F.col("p_size"), F.lit(7)).isNotNull(), "p_partkey")


@operator("select p_partkey from part where nullif(p_size, 7) is not distinct from nullif(p_size, 8)")
def filter_eq_null_safe(t):
    return _keys(t.part, F.nullif(F.col("p_size"), F.lit(7)).eqNullSafe(F.nullif(F.col("p_size"), F.lit(8))), "p_partkey")


@operator("select c_custkey, c_acctbal < 0 as in_debt from customer where (c_acctbal < 0) = true")
def filter_boolean(t):
    return _keys(t.customer.withColumn("in_debt", F.col("c_acctbal") < 0), "in_debt", "c_custkey", "in_debt")
