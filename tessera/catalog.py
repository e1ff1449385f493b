"""Tables: schemas for delimited star-schema files, views over Parquet, and the derived partsupp."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

#: Columns of the delimited files, in file order.
FILE_SCHEMAS = {
    "lineitem": "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity decimal(15,2), l_extendedprice decimal(15,2), l_discount decimal(15,2), l_tax decimal(15,2), l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
    "orders": "o_orderkey int, o_custkey int, o_orderstatus string, o_totalprice decimal(15,2), o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "customer": "c_custkey int, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal decimal(15,2), c_mktsegment string, c_comment string",
    "part": "p_partkey int, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice decimal(15,2), p_comment string",
    "supplier": "s_suppkey int, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal decimal(15,2), s_comment string",
    "partsupp": "ps_partkey int, ps_suppkey int, ps_availqty int, ps_supplycost decimal(15,2), ps_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "region": "r_regionkey int, r_name string, r_comment string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes up to which cached() keeps a table.
CACHE_BYTES = 1 << 30


def cached(df: DataFrame, limit: int = CACHE_BYTES) -> DataFrame:
    """df, kept by the executors for later queries if its estimated size is at most limit; else df as it is.

    What does not fit in memory goes to disk, and what a lost executor held is read again. unpersist() lets it go.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.persist(StorageLevel.MEMORY_AND_DISK) if size <= limit else df


def register_views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views over the Parquet tables; reading stays lazy and pruned by Catalyst."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def register_files(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """Temporary views over delimited files in folder."""
    from .sources.delimited import read_delimited

    for name in names or list(FILE_SCHEMAS):
        read_delimited(spark, f"{folder}/{name}.tbl", FILE_SCHEMAS[name]).createOrReplaceTempView(name)
