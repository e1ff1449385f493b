"""Packing along a space-filling curve: similar documents become neighbours in the training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoders import encode_all, json_encoding
from .shared import at_home, chunks, partitions, stored, texts_of
from .textops import mix

#: Buckets that tokens are hashed to, dimensions they are projected to, bits of the curve's key for each of these.
BUCKETS, DIMS, BITS = 256, 3, 16
_PLANES = np.random.Generator(np.random.PCG64(7)).standard_normal((BUCKETS, DIMS))
#: Sequences of one partition are numbered from its index times this.
STRIDE = 1 << 36
#: Bytes of ids in one stream, which one task sorts and cuts.
STREAM_BYTES = 64 << 20
#: Ids in one row of the range sort, whose ranges are drawn by rows: with small rows these are nearly ranges by bytes.
SEGMENT = 1024

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position on the Hilbert curve of each row of points, whose coordinates are below 2**bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns and mirrorings of each level, from the coarsest on
        for d in range(dims):
            turned = (x[d] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hashed token counts of each document (square roots, unit length), projected, squashed to a grid, and its key."""
    if not ids:
        return np.zeros(0, np.int64)
    flat, at = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    bucket = (mix(flat.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    counts = np.sqrt(np.bincount(at * BUCKETS + bucket, minlength=len(ids) * BUCKETS).reshape(len(ids), BUCKETS))
    norm = np.sqrt((counts**2).sum(1, keepdims=True))
    spot = (counts / np.maximum(norm, 1e-9)) @ _PLANES
    grid = (2**BITS) / (1 + np.exp(-2 * spot))
    return hilbert_keys(np.minimum(grid.astype(np.int64), 2**BITS - 1))


SEGMENTS = "doc_id long, curve_key long, n_tokens long, text_crc long, start long, ids binary"


def tokenised(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int) -> DataFrame:
    """A row for every SEGMENT ids of each document (SEGMENTS; ids little-endian unsigned 32-bit, end_id last).

    n_tokens and text_crc are the whole document's, start is the ids before the row's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = json_encoding(tokenizer_file, pattern)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows, _, _ in chunks(batch):
                ids = encode_all(encoding, rows.column(1).to_pylist())
                keys = curve_keys([np.frombuffer(i, "<u4") for i in ids])
                ids = [i + end for i in ids]
                sizes = np.array([len(i) // 4 for i in ids])
                n_segments = -(-sizes // SEGMENT)
                of = np.repeat(np.arange(len(ids)), n_segments)
                start = SEGMENT * (np.arange(len(of)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments))
                crcs = np.array([zlib.crc32(i) for i in ids])
                cut = [ids[d][4 * at : 4 * (at + SEGMENT)] for d, at in zip(of.tolist(), start.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(of)), *(pa.array(c, pa.int64()) for c in (keys[of], sizes[of], crcs[of], start)), pa.array(cut, pa.binary())],
                    ["doc_id", "curve_key", "n_tokens", "text_crc", "start", "ids"],
                )

    return texts_of(docs).mapInArrow(run, SEGMENTS)


def _tail_sizes(n: int) -> list[int]:
    """n as a sum of different powers of two, largest first: sequences of these sizes need no padding."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pieces(batches: Iterator[pa.RecordBatch], size: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Cut the stream of segments into sequences of size ids; the last of them into sizes that need no padding.

    Segments that follow each other in a document and fall into one sequence are one piece.
    """
    part = TaskContext.get().partitionId()
    sequence, fill = part * STRIDE, 0
    out: list[tuple] = []
    open_from = 0  # where in out the open sequence begins; its rows still hold their ids
    last = None  # the document, its length, crc and the ids already placed, of the row placed last
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def row(doc, start, ids, total, seq, offset):
        return (doc, start, len(ids) // 4, zlib.crc32(ids), total, seq, offset, ids)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:7]]
        return pa.RecordBatch.from_arrays(columns + [pa.array([r[7] for r in rows], pa.binary())] * with_ids, names + ["ids"] * with_ids)

    for batch in batches:
        docs, totals, crcs, starts = (batch.column(c).to_pylist() for c in range(4))
        for doc, total, crc, start, ids in zip(docs, totals, crcs, starts, batch.column(4), strict=True):
            ids = memoryview(ids.as_buffer())
            begin, end = start, start + len(ids) // 4
            while start < end:
                n = min(size - fill, end - start)
                cut = bytes(ids[4 * (start - begin) : 4 * (start - begin + n)])
                if fill and last == (doc, total, crc, start):
                    _, first, _, _, _, _, offset, before = out.pop()
                    out.append(row(doc, first, before + cut, total, sequence, offset))
                else:
                    out.append(row(doc, start, cut, total, sequence, fill))
                start, fill = start + n, fill + n
                last = (doc, total, crc, start)
                if fill == size:
                    sequence, fill, open_from = sequence + 1, 0, len(out)
        if open_from >= 4096:
            yield batch_of(out[:open_from])
            out, open_from = out[open_from:], 0
    tail, out = out[open_from:], out[:open_from]
    sizes = _tail_sizes(fill)
    at = 0
    for doc, start, length, _, total, _, _, ids in tail:
        done = 0
        while done < length:
            n = min(sizes[0] - at, length - done)
            out.append(row(doc, start + done, ids[4 * done : 4 * (done + n)], total, sequence, at))
            done, at = done + n, at + n
            if at == sizes[0]:
                sequence, at = sequence + 1, 0
                sizes.pop(0)
    if out:
        yield batch_of(out)


def pack(docs: DataFrame, tokenizer_file: str, pattern: str, size: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most size tokens, neighbours on a Hilbert curve side by side.

    Each document is its ids followed by end_id. Its hashed token vector is projected to DIMS dimensions and gets a
    key on the Hilbert curve; documents are range-sorted by (key, doc_id), so that copies, which share a key, still
    spread over partitions. They are sorted in segments of SEGMENT ids, so that ranges of equal rows are nearly ranges of
    equal bytes, though long documents lie side by side on the curve, and that a very long one spreads too. Each
    partition is one stream of STREAM_BYTES on average (about SEGMENT / mean ids of a row times as much at most), cut every
    size ids; the rest of a stream is cut into powers of two, which need no padding. sequence_id is unique over all partitions, not gapless; offset is gapless
    within a sequence. Returns a row for each piece (PIECES, and the ids themselves if with_ids).
    A null text is empty and packs as end_id alone; null doc_id and repeated rows are packed like any other; no
    rows give no pieces; other columns are left behind.
    """
    (docs,) = at_home(docs)
    tokens = stored(tokenised(docs, tokenizer_file, pattern, end_id), "packing")
    order = ["curve_key", "doc_id", "n_tokens", "text_crc", "start"]
    n_bytes = 4 * tokens.where("start = 0").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n
    streams = max(partitions(docs.sparkSession), -(-n_bytes // STREAM_BYTES))
    ranged = tokens.repartitionByRange(streams, *order).sortWithinPartitions(*order)
    schema = PIECES + (", ids binary" if with_ids else "")
    return ranged.select("doc_id", "n_tokens", "text_crc", "start", "ids").mapInArrow(lambda batches: _pieces(batches, size, with_ids), schema)
