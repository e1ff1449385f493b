"""Subqueries and common table expressions: SQL text, which Catalyst decorrelates into joins."""

from __future__ import annotations

from ..catalog import register_views
from .registry import QUERIES, SQL

_TEXTS = {
    "cte_reuse": """with spend as (select o_custkey, cast(sum(cast(o_totalprice as decimal(15,2))) as double) as total from orders group by o_custkey)
select o_custkey, total from spend where total = (select max(total) from spend)""",
    "derived_table": "select m, count(*) as n from (select c_nationkey % 5 as m from customer where c_acctbal > 0) d group by m",
    "subq_scalar": "select p_partkey from part where p_retailprice > (select cast(sum(cast(p_retailprice as decimal(15,2))) as double) / count(*) from part)",
    "subq_scalar_having": """select l_suppkey, cast(sum(cast(l_quantity as decimal(15,2))) as double) as q from lineitem group by l_suppkey
having sum(cast(l_quantity as decimal(15,2))) > (select sum(cast(l_quantity as decimal(15,2))) from lineitem) / (select count(*) from supplier)""",
    "subq_corr_scalar": "select p_partkey, p_brand from part p where p_size = (select min(p_size) from part q where q.p_brand = p.p_brand)",
    "subq_corr_two_key": """select l_orderkey, l_linenumber, l_partkey from lineitem a
where l_quantity >= (select max(l_quantity) from lineitem b where b.l_partkey = a.l_partkey and b.l_suppkey = a.l_suppkey)""",
    "subq_in": "select c_custkey from customer where c_custkey in (select o_custkey from orders group by o_custkey having count(*) > 14)",
    "subq_not_in": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "subq_exists": "select o_orderkey from orders where exists (select * from lineitem where l_orderkey = o_orderkey and l_shipdate < o_orderdate)",
    "subq_not_exists": "select c_custkey from customer where not exists (select * from orders where o_custkey = c_custkey and o_orderstatus = 'P')",
    "subq_exists_nonequi": "select l_orderkey, l_linenumber, l_suppkey from lineitem a where exists (select * from lineitem b where b.l_orderkey = a.l_orderkey and b.l_suppkey <> a.l_suppkey)",
}


def _query(text: str):
    def run(spark, sf_dir):
        register_views(spark, sf_dir)
        return spark.sql(text)

    return run


for _name, _text in _TEXTS.items():
    QUERIES[_name], SQL[_name] = _query(_text), _text
