"""The 22 star-schema questions over the driver's tables, in SQL that Spark and DuckDB both run.

partsupp is derived from lineitem; literals are shifted to the domains of the data. Money is decimal(15, 2) before
arithmetic and double at the end; averages are sums over counts. A range of doubles beside a range of decimals (q06) is
implied by it, and reaches the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..catalog import TABLES, register_views


def _d(column: str) -> str:
    return f"cast({column} as decimal(15,2))"


def _sum(what: str) -> str:
    return f"cast(sum({what}) as double)"


QTY, PRICE, DISC, TAX = (_d(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
REVENUE = f"{PRICE} * (1 - {DISC})"
PARTSUPP = f"ps as (select l_partkey as ps_partkey, l_suppkey as ps_suppkey, cast(sum({QTY}) as bigint) as ps_availqty, min({PRICE}) as ps_supplycost from lineitem group by l_partkey, l_suppkey)"
LATE = "{0}.l_shipdate > o_orderdate + interval '60' day"
YEAR = "cast(extract(year from {0}) as int)"

QUERIES_SQL = {
    "q01": f"""select l_returnflag, l_linestatus, {_sum(QTY)} as sum_qty, {_sum(PRICE)} as sum_base_price, {_sum(REVENUE)} as sum_disc_price,
    {_sum(f"cast({REVENUE} as decimal(18,4)) * (1 + {TAX})")} as sum_charge, {_sum(QTY)} / count(l_quantity) as avg_qty,
    {_sum(PRICE)} / count(l_extendedprice) as avg_price, {_sum(DISC)} / count(l_discount) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= date '2001-12-01' - interval '90' day
group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""",
    "q02": f"""with {PARTSUPP}
select s_acctbal, s_name, n_name, p_partkey, p_name, cast(ps_supplycost as double) as supplycost
from part join ps on p_partkey = ps_partkey join supplier on s_suppkey = ps_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where p_size <= 15 and p_type like '%IUM' and r_name = 'EUROPE' and ps_supplycost = (
    select min(i.ps_supplycost) from ps i join supplier on s_suppkey = i.ps_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where i.ps_partkey = p_partkey and r_name = 'EUROPE')
order by s_acctbal desc, n_name, s_name, p_partkey limit 100""",
    "q03": f"""select l_orderkey, {_sum(REVENUE)} as revenue, o_orderdate
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15'
group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10""",
    "q04": f"""select o_orderpriority, count(*) as order_count from orders
where o_orderdate >= date '1997-07-01' and o_orderdate < date '1997-10-01'
    and exists (select * from lineitem l where l.l_orderkey = o_orderkey and {LATE.format("l")})
group by o_orderpriority order by o_orderpriority""",
    "q05": f"""select n_name, {_sum(REVENUE)} as revenue
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
    join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name = 'ASIA' and o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01'
group by n_name order by revenue desc, n_name""",
    "q06": f"""select {_sum(f"{PRICE} * {DISC}")} as revenue from lineitem
where l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01' and {DISC} between 0.05 and 0.07
    and l_discount between 0.044e0 and 0.076e0 and l_quantity < 24""",
    "q07": f"""select supp_nation, cust_nation, l_year, {_sum("volume")} as revenue from (
    select n1.n_name as supp_nation, n2.n_name as cust_nation, {YEAR.format("l_shipdate")} as l_year, {REVENUE} as volume
    from supplier join lineitem on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
        join nation n1 on s_nationkey = n1.n_nationkey join nation n2 on c_nationkey = n2.n_nationkey
    where ((n1.n_name = 'NATION_3' and n2.n_name = 'NATION_7') or (n1.n_name = 'NATION_7' and n2.n_name = 'NATION_3'))
        and l_shipdate between date '1995-01-01' and date '1998-12-31') shipping
group by supp_nation, cust_nation, l_year order by supp_nation, cust_nation, l_year""",
    "q08": f"""select o_year, {_sum("case when nation = 'NATION_2' then volume else 0 end")} / nullif({_sum("volume")}, 0) as mkt_share from (
    select {YEAR.format("o_orderdate")} as o_year, {REVENUE} as volume, n2.n_name as nation
    from part join lineitem on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey join nation n1 on c_nationkey = n1.n_nationkey join region on n1.n_regionkey = r_regionkey join nation n2 on s_nationkey = n2.n_nationkey
    where r_name = 'AMERICA' and o_orderdate between date '1995-01-01' and date '1996-12-31' and p_type = 'ECONOMY') all_nations
group by o_year order by o_year""",
    "q08_ordered": f"""select o_year, {_sum("case when nation = 'NATION_2' then volume else 0 end")} / nullif({_sum("volume")}, 0) as mkt_share from (
    select {YEAR.format("o_orderdate")} as o_year, {REVENUE} as volume, n2.n_name as nation
    from region, nation n1, customer, orders, lineitem, part, supplier, nation n2
    where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey
        and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and s_nationkey = n2.n_nationkey
        and r_name = 'AMERICA' and o_orderdate between date '1995-01-01' and date '1996-12-31' and p_type = 'ECONOMY') all_nations
group by o_year order by o_year""",
    "q09": f"""with {PARTSUPP}
select nation, o_year, {_sum("amount")} as sum_profit from (
    select n_name as nation, {YEAR.format("o_orderdate")} as o_year, {REVENUE} - ps_supplycost * {QTY} as amount
    from part join lineitem on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join ps on ps_suppkey = l_suppkey and ps_partkey = l_partkey
        join orders on o_orderkey = l_orderkey join nation on s_nationkey = n_nationkey
    where p_name like '%red%') profit
group by nation, o_year order by nation, o_year desc""",
    "q10": f"""select c_custkey, c_name, {_sum(REVENUE)} as revenue, c_acctbal, n_name, c_mktsegment, c_nationkey
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey
where o_orderdate >= date '1996-10-01' and o_orderdate < date '1997-01-01' and l_returnflag = 'R'
group by c_custkey, c_name, c_acctbal, n_name, c_mktsegment, c_nationkey order by revenue desc, c_custkey limit 20""",
    "q11": f"""with {PARTSUPP}
select ps_partkey, {_sum("ps_supplycost * ps_availqty")} as value
from ps join supplier on ps_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where n_regionkey = 3
group by ps_partkey having {_sum("ps_supplycost * ps_availqty")} > (
    select {_sum("ps_supplycost * ps_availqty")} * 0.001e0 from ps join supplier on ps_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where n_regionkey = 3)
order by value desc, ps_partkey""",
    "q12": """select l_returnflag, cast(sum(case when o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' then 1 else 0 end) as bigint) as high_line_count,
    cast(sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end) as bigint) as low_line_count
from orders join lineitem on o_orderkey = l_orderkey
where l_returnflag in ('A', 'R') and o_orderdate + interval '30' day < l_shipdate and l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01'
group by l_returnflag order by l_returnflag""",
    "q13": """select c_count, count(*) as custdist from (
    select c_custkey, count(o_orderkey) as c_count from customer left join orders
        on c_custkey = o_custkey and o_orderpriority not like '%NOT%SPEC%' and o_totalprice > 250000 group by c_custkey) c_orders
group by c_count order by custdist desc, c_count desc""",
    "q14": f"""select 100e0 * {_sum(f"case when p_type like 'PROMO%' then {REVENUE} else 0 end")} / nullif({_sum(REVENUE)}, 0) as promo_revenue
from lineitem join part on l_partkey = p_partkey where l_shipdate >= date '1997-09-01' and l_shipdate < date '1997-10-01'""",
    "q15": f"""with revenue as (select l_suppkey as supplier_no, {_sum(REVENUE)} as total_revenue from lineitem
    where l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-04-01' group by l_suppkey)
select s_suppkey, s_name, total_revenue from supplier join revenue on s_suppkey = supplier_no
where total_revenue = (select max(total_revenue) from revenue) order by s_suppkey""",
    "q16": f"""with {PARTSUPP}
select p_brand, p_type, p_size, count(distinct ps_suppkey) as supplier_cnt from ps join part on p_partkey = ps_partkey
where p_brand <> 'Brand#5' and p_type not like 'MEDIUM%' and p_size in (3, 9, 14, 19, 23, 36, 45, 49)
    and ps_suppkey not in (select s_suppkey from supplier where s_name like '%Supplier%07%')
group by p_brand, p_type, p_size order by supplier_cnt desc, p_brand, p_type, p_size""",
    "q17": f"""select {_sum(PRICE)} / 7e0 as avg_yearly from lineitem join part on p_partkey = l_partkey
where p_brand = 'Brand#23' and p_type = 'PROMO' and l_quantity < (
    select 0.5e0 * cast(sum(cast(i.l_quantity as decimal(15,2))) as double) / count(i.l_quantity) from lineitem i where i.l_partkey = p_partkey)""",
    "q18": f"""select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, {_sum(QTY)} as quantity
from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum({QTY}) > 240)
group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderdate, o_orderkey limit 100""",
    "q19": f"""select {_sum(REVENUE)} as revenue from lineitem join part on p_partkey = l_partkey
where (p_brand = 'Brand#12' and p_type in ('SMALL', 'ECONOMY') and l_quantity >= 1 and l_quantity <= 21 and p_size between 1 and 25)
    or (p_brand = 'Brand#23' and p_type in ('MEDIUM', 'PROMO') and l_quantity >= 10 and l_quantity <= 30 and p_size between 1 and 40)
    or (p_brand = 'Brand#4' and p_type in ('LARGE', 'STANDARD') and l_quantity >= 20 and l_quantity <= 40 and p_size between 1 and 50)""",
    "q20": f"""with {PARTSUPP}
select s_name, s_suppkey from supplier join nation on s_nationkey = n_nationkey
where n_regionkey = 3 and s_suppkey in (
    select ps_suppkey from ps where ps_partkey in (select p_partkey from part where p_name like 'red%') and ps_availqty > (
        select 0.5 * sum({QTY}) from lineitem where l_partkey = ps_partkey and l_suppkey = ps_suppkey and l_shipdate >= date '1996-01-01' and l_shipdate < date '1998-01-01'))
order by s_name""",
    "q21": f"""select s_name, count(*) as numwait
from supplier join lineitem l1 on s_suppkey = l1.l_suppkey join orders on o_orderkey = l1.l_orderkey join nation on s_nationkey = n_nationkey
where o_orderstatus = 'F' and n_regionkey = 3 and {LATE.format("l1")}
    and exists (select * from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
    and not exists (select * from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and {LATE.format("l3")})
group by s_name order by numwait desc, s_name limit 100""",
    "q22": f"""select cntrycode, count(*) as numcust, {_sum("bal")} as totacctbal from (
    select substring(c_name from 17 for 2) as cntrycode, {_d("c_acctbal")} as bal from customer
    where substring(c_name from 17 for 2) in ('13', '31', '23', '29', '30', '18', '17')
        and c_acctbal > (select {_sum(_d("c_acctbal"))} / count(*) from customer where c_acctbal > 0 and substring(c_name from 17 for 2) in ('13', '31', '23', '29', '30', '18', '17'))
        and not exists (select * from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_orderstatus = 'F')) custsale
group by cntrycode order by cntrycode""",
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    named = [name for name in TABLES if re.search(rf"\b{name}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir, named)
        return spark.sql(text)

    return run


QUERIES = {name: _query(text) for name, text in QUERIES_SQL.items()}
