"""Quality rules: statistics of each text, and how much of it are lines that its host repeats everywhere."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import BLANKS, line_key
from .shared import at_home, chunks, discard, joined, split_by, stored
from .textops import inside, mix, ngrams, owner, words

#: A line goes if more documents of its host hold it than line_limit(): a tenth of them, but on large hosts fewer
#: (ROOT_SHARE square roots of their number), and more than FEW_DOCS in any case.
HOST_SHARE, ROOT_SHARE, FEW_DOCS = 0.1, 2, 5
#: A document is depleted if lines went and fewer words than LEAST_WORDS, or at most LEAST_SHARE of them, are left.
LEAST_WORDS, LEAST_SHARE = 20, 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SOLID = np.ones(256, np.int64)
_SOLID[[0x20, 9, 10, 11, 12, 13, *range(0x80, 0xC0)]] = 0  # bytes that begin a character of a word
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
NAMES = [c.split()[0] for c in STATS.split(", ")]


def _repeated_words(first: np.ndarray, hashes: np.ndarray, n: int = 8) -> np.ndarray:
    """For each text: its words in windows of n words that the text has twice or more."""
    covered = np.zeros(len(hashes) + 1, np.int64)
    doc, at = owner(first), np.flatnonzero(inside(first, n))
    if len(at):
        window = mix(ngrams(hashes, n)[at] + mix(doc[at].astype(np.uint64)))
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        begins = at[twice]
        np.add.at(covered, begins, 1)
        np.add.at(covered, begins + n, -1)
    hit = np.cumsum(covered[:-1]) > 0
    return np.bincount(doc[hit], minlength=len(first) - 1)


def text_stats(raw: np.ndarray, offsets: np.ndarray, texts: list[str]) -> list[np.ndarray]:
    """The columns of STATS for texts that are given as bytes and as strings."""
    w = words(raw, offsets)
    per_text = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[raw])])[offsets])
    solid = [[line for line in text.split("\n") if line.strip(BLANKS)] for text in texts]
    dup = np.array([len(lines) - len(set(lines)) for lines in solid], np.int64)
    n, repeat = w.counts, _repeated_words(w.first, w.hash)
    return [n, per_text(_SOLID), per_text(_SYMBOL.astype(np.int64)), dup, repeat, (n < 20) | (100 * repeat > 30 * n)]


def _lines(rows: DataFrame) -> DataFrame:
    """h, d and t1 of each text with l, the hash of one of its different lines in its host, and n, the words of all its copies there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                hashes: list[int] = []
                n: list[int] = []
                lengths: list[int] = []
                for i, host in enumerate(part.column(1).to_pylist()):
                    # on bytes strip() and split() know just the six white-space characters, and lower() folds A-Z only
                    held = Counter(line.strip().lower() for line in raw[offsets[i] : offsets[i + 1]].tobytes().split(b"\n"))
                    held.pop(b"", None)
                    hashes += [xxhash.xxh64_intdigest(line, host & (2**64 - 1)) for line in held]
                    n += [len(line.split()) * copies for line, copies in held.items()]
                    lengths.append(len(held))
                text = pa.array(np.repeat(np.arange(len(part)), lengths))
                columns = [*(part.column(c).take(text) for c in (1, 2, 3)), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["h", "d", "t1", "l", "n"])

    return rows.mapInArrow(run, "h long, d long, t1 long, l long, n long")


def line_limit(host_docs: Column) -> Column:
    """Documents of a host of so many that may hold a line."""
    return F.greatest(F.lit(float(FEW_DOCS)), F.least(HOST_SHARE * host_docs, ROOT_SHARE * F.sqrt(host_docs)))


def lost_lines(rows: DataFrame) -> DataFrame:
    """h, d, t1 (host, document and text), lost_words and lost_lines (hashes, at most the text's own) where lines are above the limits.

    A line is counted in the different documents of its host and goes everywhere if they are more than line_limit().
    rows: _rows(). Lines are a few numbers each, written once and read twice. Counting shuffles them by line and
    document and then one number a task for each line. A hot line, and a host with most of the lines, are met by
    a broadcast of fewer than HOT_KEYS rows (see shared.joined).
    """
    lines = stored(_lines(rows), "lines")
    counted = stored(lines.select("h", "l", "d").distinct().groupBy("h", "l").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > FEW_DOCS), "counted-lines")
    hosts = rows.select("h", "d").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("host_docs"))
    hosts = stored(hosts.join(counted.groupBy("h").agg(F.count(F.lit(1)).alias("host_lines")), "h"), "hosts")
    above = joined(counted, hosts, ["h"], "host_lines", counted.count()).where(F.col("n_docs") > line_limit(F.col("host_docs")))
    above = stored(above.select("h", "l", "n_docs"), "frequent-lines")
    held = above.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first().n
    lost = joined(lines, above, ["h", "l"], "n_docs", held).groupBy("h", "d", "t1").agg(F.collect_set(F.struct("l", "n")).alias("lost"))
    words_ = F.aggregate("lost", F.lit(0).cast("long"), lambda total, x: total + x["n"]).alias("lost_words")
    out = stored(lost.select("h", "d", "t1", words_, F.col("lost.l").alias("lost_lines")), "lost-lines")
    discard(lines, counted, hosts, above)
    return out


def _rows(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, h (hash of the host, a null host being one of its own), d (the document: doc_id, or its text without one), t1 (hash of the text), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _host(host).alias("h"), _document(text).alias("d"), F.xxhash64(text).alias("t1"), text.alias("text"))


def _document(text: Column) -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("document"), text))


def _host_key(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit("\0"))


def _host(host: str) -> Column:
    return F.xxhash64(_host_key(host))


def _is_depleted(n_words: Column, lost_words: Column) -> Column:
    left = n_words - lost_words
    return (lost_words > 0) & ((left < LEAST_WORDS) | (left <= LEAST_SHARE * n_words))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the columns of STATS, lost_words and kept, one row for each row of docs.

    base_failed: fewer than 20 words, or over 30 in 100 words in repeated 8-word windows. Lines (normalised: white
    space stripped, A-Z folded) are hashed and counted in the different documents of their host; those above the
    limits are taken away, and documents depleted by that are rejected. kept: neither failed nor depleted.
    Null texts have no words and fail; a null host is a host of its own; repeated rows are one document and judged
    alike; rows without a doc_id are one document for each text. An empty table gives no rows.
    """
    (docs,) = at_home(docs)
    rows = _rows(docs, host)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                stats = text_stats(raw, offsets, part.column(4).to_pylist())
                columns = [*part.columns[:4], *(pa.array(s.astype(np.int64)) for s in stats[:-1]), pa.array(stats[-1])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "d", "t1", *NAMES])

    base = rows.mapInArrow(run, f"doc_id long, h long, d long, t1 long, {STATS}")
    found = base.join(lost_lines(rows).drop("lost_lines"), ["h", "d", "t1"], "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long"))
    return found.select("doc_id", *NAMES, "lost_words", (~F.col("base_failed") & ~_is_depleted(F.col("n_words"), F.col("lost_words"))).alias("kept"))


def accepted(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns, and in text only the lines that stay.

    Lines above the limits go everywhere; texts without such lines are unchanged, and nearly all of them stay out of
    the join with the lost lines. Nulls, repeated rows and rows without a doc_id are as in judge(): a null text has no
    words and its row goes. Columns may have any further names.
    """
    (docs,) = at_home(docs)

    @F.pandas_udf("struct<n_words: long, failed: boolean>")
    def base(texts: pd.Series) -> pd.DataFrame:
        rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
        parts = [text_stats(raw, offsets, part.column(0).to_pylist()) for part, raw, offsets in chunks(rows)]
        return pd.DataFrame({name: np.concatenate([p[k] for p in parts]) if parts else [] for name, k in (("n_words", 0), ("failed", -1))})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = {"__h": _host(host), "__d": _document(text), "__t1": F.xxhash64(text)}
    good = lambda rows: rows.withColumns(key | {"__base": base(text)}).where("not __base.failed")
    lost = lost_lines(_rows(docs, host)).select(*[F.col(c).alias(f"__{c}") for c in ("lost_words", "lost_lines")], *[F.col(c).alias(f"__lost_{c}") for c in ("h", "d", "t1")])
    same = [F.col(f"__{c}") == F.col(f"__lost_{c}") for c in ("h", "d", "t1")]
    losing, whole = split_by(docs, _document(text), lost, F.col("__lost_d"))
    left = good(losing).join(lost, same, "left").where(~_is_depleted(F.col("__base.n_words"), F.coalesce("__lost_words", F.lit(0))))
    # a line's hash as in _lines(): xxhash64 of several columns takes the first one's hash as the next one's seed
    stays = lambda line: ~F.array_contains("__lost_lines", F.xxhash64(_host_key(host), line_key(line)))
    kept = F.array_join(F.filter(F.split(docs["text"].cast("string"), "\n", -1), stays), "\n")
    new = F.when(F.col("__lost_lines").isNull(), docs["text"]).otherwise(kept)
    rest = good(whole).select(*[docs[c] for c in docs.columns])
    return left.select(*[new.alias(c) if c == "text" else docs[c] for c in docs.columns]).union(rest)
