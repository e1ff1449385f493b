"""Byte-level BPE encoding and decoding with the tiktoken library over a local rank file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .encoders import ids_bytes, rank_encoding, safe_parts
from .shared import at_home, chunks, texts_of

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, digests: bool = False) -> DataFrame:
    """Encode each whole text with the ranks of rank_file, each match of pattern by itself, and decode the ids again.

    Special tokens do not exist here: their strings are ordinary text. Long texts are cut at boundaries that no
    match of the pattern crosses, so the ids are those of one call. Decoding joins the tokens' raw bytes.
    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded (bytes); with digests, the two
    SHA-256 in lowercase hex instead (ids_sha256, decoded_sha256). A null text counts as empty (no ids); rows,
    repeated ones and null doc_id included, stay one to one; other columns are left behind.
    """
    (docs,) = at_home(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(rank_file, pattern)
        for batch in batches:
            for rows, _, _ in chunks(batch):
                n, ids_out, bytes_out = [], [], []
                for text in rows.column(1).to_pylist():
                    ids = [i for part in safe_parts(text) for i in encoding.encode_ordinary(part)] if len(text) > 200_000 else encoding.encode_ordinary(text)
                    ids_raw, decoded = ids_bytes(ids), encoding.decode_bytes(ids)
                    n.append(len(ids))
                    ids_out.append(hashlib.sha256(ids_raw).hexdigest() if digests else ids_raw)
                    bytes_out.append(hashlib.sha256(decoded).hexdigest() if digests else decoded)
                kind = pa.string() if digests else pa.binary()
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n, pa.int64()), pa.array(ids_out, kind), pa.array(bytes_out, kind)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"],
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else SCHEMA
    return texts_of(docs).mapInArrow(run, schema)


def decode(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """The bytes of rows (doc_id, ids): ids as little-endian unsigned 32-bit integers. Null ids decode to nothing."""
    (tokens,) = at_home(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoding = rank_encoding(rank_file, pattern)
        for batch in batches:
            out = [encoding.decode_bytes(np.frombuffer(ids or b"", "<u4").tolist()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
