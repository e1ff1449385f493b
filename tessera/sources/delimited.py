"""Delimited text: | between fields and after the last one, no header."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_delimited(spark: SparkSession, path: str, schema: str | StructType, delimiter: str = "|") -> DataFrame:
    """Rows of a delimited file by a given schema. A field that can't be parsed is null; nothing is inferred."""
    return spark.read.csv(path, schema=schema, sep=delimiter, header=False, mode="PERMISSIVE", dateFormat="yyyy-MM-dd")


def write_delimited(df: DataFrame, path: str, delimiter: str = "|") -> None:
    """The counterpart of read_delimited, with the trailing delimiter."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat(F.concat_ws(delimiter, *fields), F.lit(delimiter)).alias("value")).write.text(path)


def round_trip(df: DataFrame) -> DataFrame:
    """df written as a delimited file and read again by its own schema. Empty strings come back as null.

    The file lies in spark.checkpoint.dir and goes with the application; a folder of our own will do on a local master only.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(shared or tempfile.gettempdir()).rstrip('/')}/delimited-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    write_delimited(df, path)
    return read_delimited(spark, path, df.schema)
