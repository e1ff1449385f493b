"""Token counts with the tokenizers library: Arrow batches in, lengths only out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .encoders import count_all
from .shared import at_home, chunks, texts_of


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int) -> DataFrame:
    """The tokens of each whole text, as the library's file gives them without begin, end or other added tokens.

    Arrow batches are cut into batches of about equal bytes; a text beyond the size of one is encoded in parts cut
    at safe boundaries (see encoders), and ids never leave the worker. Special tokens' strings inside a text are
    found as by the library's default. Returns doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit). A null
    text counts as empty: 0 and 0. Rows stay one to one, other columns are left behind.
    """
    (docs,) = at_home(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, offsets in chunks(batch):
                n = pa.array(count_all(tokenizer_file, rows.column(1).to_pylist()), pa.int64())
                size = pa.array(offsets[1:] - offsets[:-1], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
