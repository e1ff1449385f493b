"""What the operators of this subpackage share: sessions, scratch tables, joins on hot keys and column clean-up.

Scratch tables cut the lineage: they are Parquet tables below ``spark.checkpoint.dir``, the folder that
driver and executors share, so that a lost executor never costs more than the stage it was running.

Memory: Arrow batches and numpy passes are bounded by bytes, but one text is never cut before it is read, so a worker
needs about 60 bytes for each byte of the longest single text (200 MB of text: 12 GB).
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch sent to Python: bounds a worker's memory whatever the texts' length.
ARROW_ROWS, ARROW_BYTES = 2_000, 4 << 20
#: Rows that the Parquet reader decodes at once: with long texts or arrays, more of them would not fit in the heap.
READ_ROWS = 256
#: Bytes of text that a vectorised pass takes at once (a longer single text is taken alone).
CHUNK_BYTES = 512 << 10

_own_dir: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where it is unset, a folder of our own, on a local master only."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tessera-")
    return _own_dir


#: Settings of the operators' own sessions: small batches bound a worker's memory; shuffle files go with the query that
#: wrote them; buckets of a stored run are read in the order that they were written in. A union of tables in buckets
#: must be shuffled before it is grouped: Spark 4.1 may believe it is in buckets itself, and give a key several rows.
SETTINGS = {
    "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS),
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.unionOutputPartitioning": "false",
}


def at_home(*frames: DataFrame) -> list[DataFrame]:
    """The frames in a new session of the same application, which has their session's settings and SETTINGS.

    So an operator's settings hold for its own queries, and the caller's session stays as it is.
    """
    caller = frames[0].sparkSession
    own = caller.newSession()
    for name, value in {**caller.conf.getAll, **SETTINGS}.items():
        if name in SETTINGS or (name.startswith("spark.sql.") and own.conf.isModifiable(name)):
            own.conf.set(name, value)
    rows = own._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    return [DataFrame(rows(own._jsparkSession, df._jdf.queryExecution().analyzed()), own) for df in frames]


def _path_of(df: DataFrame, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str, split_by: str | None = None) -> DataFrame:
    """df, written as a table in the shared folder and read again; split_by: a column of few values, each in a folder of its own."""
    path = _path_of(df, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(split_by) if split_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def stored_in_buckets(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """df as a table with one file for each bucket of keys, sorted by them: joins and aggregations on keys don't shuffle it."""
    path, spark = _path_of(df, name), df.sparkSession
    table, n = f"scratch_{uuid.uuid4().hex}", partitions(spark)
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._scratch, out._table = path, table
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() made, once all that was to be read from them is itself stored."""
    for table in tables:
        spark = table.sparkSession
        if hasattr(table, "_table"):
            spark.sql(f"drop table if exists {table._table}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: A key is hot if it has more than one in HOT_KEYS of all rows. Fewer than HOT_KEYS keys can be.
HOT_KEYS = 10_000
#: Counters of frequent values that a task keeps.
COUNTERS = 4 * HOT_KEYS


class Counters:
    """Frequent values among all that were counted, each with the smallest payload seen while it was counted.

    None with more than one in ``size`` of all is missing, and a count falls short by one in ``size`` of them at most (a
    Misra-Gries summary; sums of summaries keep that promise).
    """

    def __init__(self, size: int = COUNTERS):
        self.size, self.total = size, 0
        self.value, self.n, self.payload = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def count(self, values: np.ndarray, payload: np.ndarray | None = None) -> None:
        self.total += len(values)
        payload = np.zeros(len(values), np.int64) if payload is None else payload
        weight = np.concatenate([self.n, np.ones(len(values), np.int64)])
        payload = np.concatenate([self.payload, payload])
        self.value, at = np.unique(np.concatenate([self.value, values]), return_inverse=True)
        self.n = np.bincount(at, weight, len(self.value)).astype(np.int64)
        self.payload = np.full(len(self.value), np.iinfo(np.int64).max)
        np.minimum.at(self.payload, at, payload)
        if len(self.value) > self.size:
            self.n -= np.partition(self.n, -self.size - 1)[-self.size - 1]
            stays = self.n > 0
            self.value, self.n, self.payload = self.value[stays], self.n[stays], self.payload[stays]


def frequent(counts: DataFrame, value: str, least: int) -> DataFrame:
    """Of summed counters (rows of value and n, the row without a value holding the total) those of at least ``least`` that
    can have more than one in HOT_KEYS of the total: none is missed, and there are fewer than 1.4 * HOT_KEYS."""
    total = counts.where(F.col(value).isNull()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return counts.where(F.col(value).isNotNull() & (F.col("n") >= F.lit(max(float(least), total / HOT_KEYS - total / COUNTERS))))


def joined(many: DataFrame, keyed: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """many joined with keyed on the columns on, whatever share of many one key has.

    keyed is a stored table with one row for each key, and rows is the number of many's rows with it (or more), out of
    total. The hot keys, fewer than HOT_KEYS by their definition, are broadcast; the rest is shuffled.
    """
    hot = F.broadcast(keyed.where(F.col(rows) > F.lit(total / HOT_KEYS)))
    cold = keyed.where(F.col(rows) <= F.lit(total / HOT_KEYS))
    return many.join(hot, on).unionByName(many.join(hot.select(*on), on, "left_anti").join(cold, on))


#: Bits in which split_by() marks keys: at most a 64th as many rows are broadcast.
MARKS = 1 << 24


def split_by(rows: DataFrame, key: Column, keyed: DataFrame, of: Column) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those whose key may be among keyed's (of), and those whose key surely isn't.

    So that a join with keyed shuffles only the texts that it concerns. Each key of keyed marks one of MARKS bits, and
    rows meet a broadcast of these, which stays as small however many keys there are. A row without a partner may
    find a marked bit (with a chance of keys / MARKS at most) and then takes part in the join, as it would without
    this; no row with one is missed. keyed is a stored table.
    """
    spot = lambda c: F.xxhash64(F.lit("mark"), c).bitwiseAND(F.lit(MARKS - 1))
    bit = lambda c: spot(c).bitwiseAND(F.lit(63)).cast("int")
    word = lambda c: F.shiftright(spot(c), 6)
    marks = stored(keyed.groupBy(word(of).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(of))).alias("__bits")), "marks")
    met = rows.join(F.broadcast(marks), word(key) == F.col("__word"), "left")
    marked = F.coalesce(F.getbit("__bits", bit(key)), F.lit(0)) == 1
    return met.where(marked).drop("__word", "__bits"), met.where(~marked).drop("__word", "__bits")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text only; other columns, whatever their names, are left behind. A null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with about CHUNK_BYTES of text: the rows, their UTF-8 bytes, and n + 1 offsets into these."""
    text = batch.column(batch.schema.get_field_index(column))
    if text.type not in (pa.large_string(), pa.large_binary()):
        text = text.cast(pa.large_string())
    n = len(text)
    if n == 0:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    _trim()


def _trim() -> None:
    """Give freed memory back to the system: workers wait for their next task, and others need the room meanwhile."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
