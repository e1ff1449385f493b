"""A corpus through five operators, from raw documents to packed sequences.

Every stage but the last returns the columns of documents, whatever further columns there are and whatever their
names. Every stage gives an empty table for an empty one, and takes texts whole, however long (see llm.shared for the
memory that one text needs). Nulls, empty texts, ties and repeated rows: see each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, ngram_join, packing, quality_rules, substring_dedup
from tessera.llm.shared import stored

#: No SQL: near duplicates are a transitive closure, and packing follows a curve of its own.
ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, after the text has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines that a host repeats above the limits.

    Null, empty and short texts are rejected. A null source is a source of its own. Repeated rows are judged alike and
    count once; rows without doc_id count once for each text. Other nulls are left as they are.
    """
    return _recounted(quality_rules.accepted(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents hold stay in the last of these only.

    A null text becomes empty. Repeated rows are one document and keep or lose the same lines; rows without doc_id keep all.
    """
    return _recounted(line_dedup.rewritten(docs, min_chars=20, min_docs=3))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by Jaccard 0.8 or more of five-word shingles the one with the smallest doc_id stays.

    Documents without words (null or empty texts) are linked with nothing and stay. Of repeated rows with one doc_id one
    stays. Rows without doc_id all stay.
    """
    return ngram_join.one_of_each(docs, n=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 20 words or more stay where they stand first: in the smallest doc_id, and furthest in front.

    Texts without such passages stay as they are, null ones too. Repeated rows get one result each; rows without
    doc_id take no part.
    """
    return _recounted(substring_dedup.rewritten(docs, length=20))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 tokens.

    Null and empty texts are one token, the end. Every row is packed, repeated ones and those without doc_id too. Ties on
    the curve are ordered by doc_id and length.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=1024, end_id=0)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substrings), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
