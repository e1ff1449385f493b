"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only: no Python on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import at_home, discard, joined, split_by, stored, stored_in_buckets, texts_of

#: White space stripped from a line before it is hashed, and the letters folded.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def key_hash(key: Column) -> Column:
    """128 bits in two columns' worth, so that keys of a web-scale corpus stay apart."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


class LineRuns:
    """An index of line hashes as levels of sorted runs, each a table in the shared folder, in buckets of its hashes.

    A run has a row for each hash of its batch: h1, h2, n_docs (documents of the batch that hold the line) and keeper,
    the largest of their ids if no run before had the hash, else null. As batches come from the largest ids down,
    a hash has one keeper over all runs, and it is the largest id of all.

    add() merge-anti-joins a batch with the runs, bucket by bucket, without a shuffle of the runs, and writes the batch's
    own run at level 0. As soon as a level has ``fanout`` runs they are compacted into one of the next level, so that
    a hash is rewritten once a level, and a batch meets fewer than ``fanout`` runs of each level.
    """

    def __init__(self, fanout: int = 4):
        self.fanout, self.levels = fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _store(rows: DataFrame) -> DataFrame:
        return stored_in_buckets(rows, "line-run", ["h1", "h2"])

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows whose hash no run has: an anti-join with each run, by merging sorted sides."""
        for run in self.runs():
            lines = lines.hint("merge").join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Index a batch of rows (doc_id, h1, h2), one for each document and hash, of smaller ids than all batches before.

        Rows are counted by hash before they are shuffled, so a line that every document holds is one row a task.
        """
        batch = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        if self.runs():
            fresh = self.unseen(batch).select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("keeper").alias("new"))
            batch = batch.join(fresh, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left").select("h1", "h2", "n_docs", F.col("new").alias("keeper"))
        run = self._store(batch)
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._store(self._merged(self.levels[level]))
            discard(*self.levels[level])
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1

    def entries(self) -> DataFrame:
        """All hashes with n_docs and keeper over all runs. There must be a run."""
        runs = self.runs()
        return self._merged(runs) if len(runs) > 1 else runs[0]


def indexable_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, h1, h2 for each different key of at least min_chars code points in a document."""
    keys = F.filter(F.transform(F.split("text", "\n", -1), line_key), lambda k: F.length(k) >= min_chars)
    hashes = F.array_distinct(F.transform(keys, key_hash))
    rows = texts_of(docs).where("doc_id is not null").select("doc_id", F.explode(hashes).alias("h"))
    return rows.select("doc_id", "h.h1", "h.h2").distinct()


def _batches(docs: DataFrame, batches: int) -> Column:
    """A batch number, from 0 for the largest doc_ids on: ranges of about equally many documents."""
    shares = [k / batches for k in range(batches - 1, 0, -1)]
    edges = docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", shares, 0.01) if shares else []
    number = F.lit(0)
    for edge in edges:
        number = number + (F.col("doc_id") < int(edge)).cast("int")
    return number


def with_kept_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 5) -> DataFrame:
    """All columns of docs, with __all (the text's lines) and __kept (those that stay).

    A key (the line stripped of white space, A-Z folded) of at least min_chars code points that at least min_docs
    documents hold loses its lines everywhere but in the largest doc_id. Documents go into the runs in ``batches``
    ranges of doc_id, the largest first: a hash that the anti-join with earlier runs leaves is new, and its largest
    document here is its keeper; of the others this batch has no keeper. When all batches are in, a document loses
    the lines whose hash has min_docs documents and another keeper. The number of batches is a parameter (how much
    arrives at once) and no limit: each batch reads the runs before it once, from sorted buckets.

    Hot lines are counted before a shuffle and met by a broadcast of fewer than HOT_KEYS rows (see shared.joined); a
    document's condemned hashes are at most its own lines. Of documents that lose nothing nearly all stay out of the
    join of texts with condemned hashes (see shared.split_by).
    Null or empty texts are one empty line. Rows with the same doc_id are one document. Rows without a doc_id
    are not indexed and keep every line. An empty table gives an empty table.
    """
    (docs,) = at_home(docs)
    named = docs.where("doc_id is not null")
    lines = stored(indexable_lines(docs, min_chars).withColumn("batch", _batches(named, batches)), "lines", split_by="batch")
    total, runs = lines.count(), LineRuns()
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).drop("batch"))
    frequent = stored(runs.entries().where(F.col("n_docs") >= min_docs), "frequent-lines")
    discard(*runs.runs())
    condemned = stored(
        joined(lines.select("doc_id", "h1", "h2"), frequent, ["h1", "h2"], "n_docs", total)
        .where("doc_id <> keeper")
        .groupBy(F.col("doc_id").alias("__doc"))
        .agg(F.collect_set(F.struct("h1", "h2")).alias("__drop")),
        "condemned",
    )
    discard(lines, frequent)
    losing, whole = split_by(docs, docs["doc_id"].cast("long"), condemned, F.col("__doc"))
    losing = losing.join(condemned, docs["doc_id"].cast("long") == condemned["__doc"], "left")
    split = F.split(F.coalesce(docs["text"].cast("string"), F.lit("")), "\n", -1)
    survivors = F.filter(split, lambda line: ~F.array_contains("__drop", key_hash(line_key(line))) | (F.length(line_key(line)) < min_chars))
    kept = F.when(F.col("__drop").isNull(), split).otherwise(survivors)
    out = losing.select(*[docs[c] for c in docs.columns], split.alias("__all"), kept.alias("__kept"))
    return out.union(whole.select(*[docs[c] for c in docs.columns], split.alias("__all"), split.alias("__kept")))


def counted(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, kept_text, n_lines (before dropping) and n_dropped; see with_kept_lines."""
    out = with_kept_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    dropped = (F.size("__all") - F.size("__kept")).cast("long")
    return out.select("doc_id", F.array_join("__kept", "\n").alias("kept_text"), F.size("__all").cast("long").alias("n_lines"), dropped.alias("n_dropped"))


def rewritten(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with its own columns, and in text only the lines that stay; see with_kept_lines."""
    out = with_kept_lines(docs, min_chars, min_docs)
    return out.select(*[F.array_join("__kept", "\n").alias(c) if c == "text" else out[c] for c in docs.columns])
