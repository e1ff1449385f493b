"""Plans, nulls, empty inputs, duplicate keys and delimited files."""

import types

import pytest
from compare import SF

from tessera import cli, operators
from tessera.catalog import FILE_SCHEMAS, cached
from tessera.functions.numeric import exact_avg, exact_sum
from tessera.operators import expressions
from tessera.plans import tpch
from tessera.sources.delimited import read_delimited, write_delimited


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(operators.QUERIES["scan_filter_pushed"](spark, SF))
    assert "PushedFilters: [IsNotNull" in text and "o_totalprice" not in text


@pytest.mark.parametrize(("name", "node"), [("join_semi", "LeftSemi"), ("join_anti", "LeftAnti"), ("subq_exists", "LeftSemi"), ("subq_not_in", "LeftAnti"), ("limit_topk", "TakeOrderedAndProject")])
def test_strategies(spark, name, node):
    assert node in plan(operators.QUERIES[name](spark, SF))


def test_range_of_doubles_reaches_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        assert "GreaterThanOrEqual(l_discount,0.044)" in plan(tpch.QUERIES["q06"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_cache_is_bounded(spark):
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    assert cached(nation, limit=10).storageLevel.useMemory is False
    kept = cached(nation)
    assert kept.storageLevel.useMemory and "InMemoryTableScan" in plan(kept.where("n_nationkey > 1"))
    kept.unpersist()


def test_guard_ends_the_query(spark):
    frame = spark.createDataFrame([(-1, 2.0)], "s_suppkey long, s_acctbal double")
    with pytest.raises(Exception, match="negative key"):
        expressions.expr_guard(types.SimpleNamespace(supplier=frame)).collect()


def test_empty_aggregates(spark):
    empty = spark.createDataFrame([], "k long, v double")
    row = empty.agg(exact_sum("v").alias("s"), exact_avg("v").alias("a")).first()
    assert row.s is None and row.a is None


def test_sum_is_exact(spark):
    rows = spark.createDataFrame([(0.1,)] * 1000 + [(16777217.01,)], "v double")
    assert rows.agg(exact_sum("v").alias("s")).first().s == 16777317.01


def test_null_aware_not_in(spark):
    spark.createDataFrame([(1,), (None,)], "k int").createOrReplaceTempView("null_keys")
    assert spark.sql("select 2 as x where 2 not in (select k from null_keys)").count() == 0


def test_many_to_many(spark):
    left, right = (spark.createDataFrame([(1, s) for s in "abc"[:n]], "k int, v string") for n in (3, 2))
    assert left.join(right, "k").count() == 6


def test_delimited_files(spark, tmp_path):
    (tmp_path / "nation.tbl").write_text("0|ALGERIA|0|some words|\n1|ARGENTINA|x|more|\n")
    rows = read_delimited(spark, str(tmp_path / "nation.tbl"), FILE_SCHEMAS["nation"]).orderBy("n_nationkey").collect()
    assert [r.n_name for r in rows] == ["ALGERIA", "ARGENTINA"] and rows[1].n_regionkey is None
    write_delimited(spark.createDataFrame(rows[:1], "n_nationkey int, n_name string, n_regionkey int, n_comment string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "0|ALGERIA|0|some words|"


def test_command_line(spark, capsys):
    assert cli.main(["--query", "q06", "--data", SF]) == 0
    assert cli.main(["--sql", "select count(*) as n from nation", "--data", SF, "--explain"]) == 0
    assert "revenue" in capsys.readouterr().out
