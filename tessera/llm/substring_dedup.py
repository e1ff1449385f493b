"""Substring dedup: seeds are winnowed anchors, matches are extended both ways around them.

A text's k-word hashes are winnowed: each window of ``length`` words chooses the smallest of the k-word hashes inside
it (the leftmost, if equal). The choice depends on the window's words only, so two equal windows choose the same seed
at the same place, and documents joined on seeds miss no repeat. The windows that chose an anchor lie side by side
around it and are its context: the seed extended to the left and to the right.

Anchors meet by their seeds, and cross the network without their windows. Of anchors with one seed and one context all
but the first are repeats as a whole. Where a seed has several contexts, the first anchor of each is extended word by
word: its windows are made from the text once more and compared. Neighbouring anchors' matches add up to maximal repeats.

A seed that more than one in HOT_KEYS anchors has is dealt by its contexts instead, and all of these are extended. Seeds
are found to be that frequent by counters that every task keeps of all its anchors, and that add up:
none is missed (see shared.Counters).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Counters, at_home, chunks, discard, frequent, joined, partitions, stored, texts_of
from .textops import inside, mix, ngrams, words

#: Words in a seed; contexts that occur twice in a chunk and are remembered by a task.
SEED_WORDS, HOT = 5, 200_000
#: Anchors below which a seed is not frequent.
LEAST_FREQUENT = 64
#: Kinds of anchors: met by seed; met by context, as the seed is frequent; known to be a repeat.
BY_SEED, BY_CONTEXT, SETTLED = 0, 1, 2


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of values[i:i + width] for each i, the leftmost if there are several."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Per anchor: its seed's hash, its text, the first window (a word's number in the text) that chose it, and where its
    windows' hashes begin in the last array."""
    w = words(raw, offsets)
    whole = inside(w.first, length)
    start = np.flatnonzero(whole)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    seeds = ngrams(w.hash, SEED_WORDS)
    chosen = _leftmost_min(seeds, length - SEED_WORDS + 1)[start]
    windows = ngrams(w.hash, length)[start]
    begins = np.ones(len(start), bool)
    begins[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(begins)
    text = np.searchsorted(w.first, start[at], side="right") - 1
    return seeds[chosen[at]], text, start[at] - w.first[text], at, windows


class _Hot:
    """Contexts (a seed with all its windows) that this task has met twice, and the smallest document of each."""

    def __init__(self):
        self.context, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def settled(self, context: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Whether an equal context stands earlier in this chunk, or in a smaller document of those remembered."""
        order = np.lexsort((pos, doc, context))
        c, d, p = context[order], doc[order], pos[order]
        later = np.zeros(len(c), bool)
        later[1:] = c[1:] == c[:-1]
        group = np.flatnonzero(~later)
        lead = np.repeat(group, np.diff(group, append=len(c)))
        out = np.zeros(len(c), bool)
        out[order] = later & ((d != d[lead]) | (p != p[lead]))
        if len(self.context):
            at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
            out |= (self.context[at] == context) & (self.doc[at] < doc)
        twice = group[np.diff(group, append=len(c)) > 1]
        both_c, both_d = np.concatenate([self.context, c[twice]]), np.concatenate([self.doc, d[twice]])
        order = np.lexsort((both_d, both_c))
        both_c, both_d = both_c[order], both_d[order]
        new = np.ones(len(both_c), bool)
        new[1:] = both_c[1:] != both_c[:-1]
        self.context, self.doc = (x[new][:HOT] for x in (both_c, both_d))
        return out


def _frequent_seeds(docs: DataFrame, length: int) -> np.ndarray:
    """The seeds that more than one in HOT_KEYS anchors has, sorted. The driver gets fewer than 1.4 * HOT_KEYS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters()
        for batch in batches:
            for _, raw, offsets in chunks(batch):
                counters.count(anchors(raw, offsets, length)[0])
        yield pa.RecordBatch.from_arrays([pa.array([None, *counters.value.view(np.int64).tolist()], pa.int64()), pa.array([counters.total, *counters.n.tolist()], pa.int64())], ["seed", "n"])

    counts = stored(docs.mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")), "seed-counts")
    found = [row.seed for row in frequent(counts, "seed", LEAST_FREQUENT).select("seed").collect()]
    discard(counts)
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _instances(docs: DataFrame, length: int, often_met: np.ndarray) -> DataFrame:
    """key, context, doc_id and place of each anchor; place holds pos (first window), n (its windows) and the kind.

    Where a task has seen the same context earlier, all windows are known to be repeats: such a row has a key of its
    own, so that copies are thinned out before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _Hot()
        for batch in batches:
            for rows, raw, offsets in chunks(batch):
                seed, text, pos, at, windows = anchors(raw, offsets, length)
                if not len(at):
                    continue
                doc = rows.column(0).to_numpy()[text]
                n = np.diff(at, append=len(windows))
                context = mix(np.add.reduceat(mix(windows), at) ^ mix(seed))
                done = hot.settled(context, doc, pos)
                spread = mix(context + mix(doc.view(np.uint64)) + pos.astype(np.uint64))
                often = np.isin(seed, often_met)
                key = np.where(done, spread, np.where(often, mix(seed + context), seed))
                kind = np.where(done, SETTLED, np.where(often, BY_CONTEXT, BY_SEED))
                place = (pos << 12) | (n << 2) | kind
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.where(done, 0, context).view(np.int64)), pa.array(doc), pa.array(place)], ["key", "context", "doc_id", "place"])

    return docs.mapInArrow(run, "key long, context long, doc_id long, place long")


def _met(instances: DataFrame) -> DataFrame:
    """doc_id, pos, n and repeat of anchors that are repeats (true), or first of their context but not alone with their
    seed (false). Rows stream past, sorted; of a key only its last context and, as long as that is alone, its first anchor are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # key and context of the row before, and that context's first anchor
        alone: tuple | None = None  # doc and place of the only context of the last key so far
        for batch in batches:
            key, context, doc, place = (batch.column(i).to_numpy() for i in range(4))
            settled = (place & 3) == SETTLED
            out = [(doc[settled], place[settled], True)]
            key, context, doc, place = (x[~settled] for x in (key, context, doc, place))
            if len(key):
                new_key, new = np.ones(len(key), bool), np.ones(len(key), bool)
                new_key[1:] = key[1:] != key[:-1]
                new[1:] = new_key[1:] | (context[1:] != context[:-1])
                if last is not None and key[0] == last[0]:
                    new_key[0], new[0] = False, context[0] != last[1]
                group = np.cumsum(new_key)  # 0: the last key of the batch before
                contexts = np.bincount(group[new], minlength=group[-1] + 1)
                if not new_key[0]:
                    if alone is not None and contexts[0]:
                        out.append((np.array([alone[0]]), np.array([alone[1]]), False))
                    contexts[0] += 1 if alone is not None else 2
                several = new & ((contexts[group] > 1) | ((place & 3) == BY_CONTEXT))
                lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
                d, p = np.where(lead < 0, last[2] if last else 0, doc[lead]), np.where(lead < 0, last[3] if last else 0, place[lead])
                later = (doc != d) | (place != p)  # a repeated row is no repeat of itself
                out += [(doc[later], place[later], True), (doc[several], place[several], False)]
                if contexts[group[-1]] > 1:
                    alone = None
                elif new_key.any():  # else the key is still that of the batch before, and so is its only context
                    at = np.flatnonzero(new & (group == group[-1]))[0]
                    alone = (doc[at], place[at]) if (place[at] & 3) == BY_SEED else None
                last = (key[-1], context[-1], d[-1], p[-1])
            d, p, r = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), np.repeat([o[2] for o in out], [len(o[0]) for o in out])
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array((p >> 12).astype(np.int32)), pa.array((p >> 2 & 1023).astype(np.int32)), pa.array(r)], ["doc_id", "pos", "n", "repeat"])

    dealt = instances.repartition(partitions(instances.sparkSession), "key").sortWithinPartitions("key", "context", "doc_id", "place")
    return dealt.mapInArrow(run, "doc_id long, pos int, n int, repeat boolean")


def _extended(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """doc_id and pos of those windows of the anchors in places that stand earlier too. Windows have 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in chunks(batch):
                w = words(raw, offsets)
                h1, h2 = ngrams(w.hash, length), ngrams(mix(w.hash + np.uint64(1)), length)
                spots = rows.column(2).combine_chunks() if isinstance(rows.column(2), pa.ChunkedArray) else rows.column(2)
                of = np.repeat(np.arange(len(rows)), np.asarray(spots.value_lengths()))
                pos, n = (spots.flatten().field(c).to_numpy().astype(np.int64) for c in ("pos", "n"))
                of, at = np.repeat(of, n), np.repeat(pos, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                there = at + length <= w.counts[of]  # a row of the same doc_id may have another text
                of, at = of[there], at[there]
                spot = w.first[of] + at
                yield pa.RecordBatch.from_arrays([pa.array(h1[spot].view(np.int64)), pa.array(h2[spot].view(np.int64)), rows.column(0).take(pa.array(of)), pa.array(at.astype(np.int32))], ["w1", "w2", "doc_id", "pos"])

    spots = places.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "n")).alias("spots"))
    windows = stored(docs.join(spots, "doc_id").select("doc_id", "text", "spots").mapInArrow(run, "w1 long, w2 long, doc_id long, pos int"), "windows")
    first = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    several = stored(first.where("n > 1"), "several")
    late = joined(windows, several, ["w1", "w2"], "n", windows.count()).where(F.struct("doc_id", "pos") != F.col("first"))
    late = stored(late.select("doc_id", "pos"), "late-windows")
    discard(windows, several)
    return late


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """docs with __begins and __ends, the stretches of words to remove (null: none)."""
    (docs,) = at_home(docs)
    named = texts_of(docs).where("doc_id is not null")
    met = stored(_met(_instances(named, length, _frequent_seeds(named, length))), "met")
    whole = met.where("repeat").select("doc_id", F.col("pos").alias("begin"), (F.col("pos") + F.col("n") + (length - 1)).alias("end"))
    late = _extended(named, met.where("not repeat").select("doc_id", "pos", "n"), length)
    parts = late.select("doc_id", F.col("pos").alias("begin"), (F.col("pos") + length).alias("end"))
    spans = stored(whole.unionByName(parts).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set(F.struct("begin", "end")).alias("__spans")), "spans")
    discard(met, late)
    joined_docs = docs.join(spans, docs["doc_id"].cast("long") == spans["__doc"], "left")
    return joined_docs.select(*[docs[c] for c in docs.columns], F.col("__spans.begin").alias("__begins"), F.col("__spans.end").alias("__ends"))


def _kept_words(text: bytes, begins: list[int] | None, ends: list[int] | None) -> tuple[int, list[bytes]]:
    """The number of words, and the words outside all stretches."""
    own = text.split()  # bytes.split() knows just the six white-space characters of the contract
    if begins is None or not len(begins):
        return len(own), own
    gone = np.zeros(len(own) + 1, np.int64)  # a stretch of another text with this doc_id may reach beyond this one
    np.add.at(gone, np.minimum(begins, len(own)), 1)
    np.add.at(gone, np.minimum(ends, len(own)), -1)
    stays = np.cumsum(gone[:-1]) == 0
    return len(own), [word for word, stay in zip(own, stays.tolist(), strict=True) if stay]


def remove_repeats(docs: DataFrame, length: int = 20, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (or kept_sha256, with digest): texts without repeated passages.

    A word goes if a window of ``length`` words over it has words that also start earlier: in a smaller doc_id, or
    further in front in the same document. Windows are those of the input. Kept words are joined by one space.
    Null texts have no words. Rows with one doc_id are one document and get one result each; rows without a doc_id
    take no part and keep all words. Other columns are left behind. An empty table gives no rows.
    """
    last = "kept_sha256" if digest else "kept_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in chunks(batch):
                spans = zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)
                own = [_kept_words(raw[offsets[i] : offsets[i + 1]].tobytes(), *span) for i, span in enumerate(spans)]
                kept = [b" ".join(words_) for _, words_ in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), pa.array([n for n, _ in own], pa.int64()), pa.array([n - len(w) for n, w in own], pa.int64()),
                        pa.array([hashlib.sha256(k).hexdigest() if digest else k.decode() for k in kept], pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", last],
                )

    return _with_spans(texts_of(docs), length).mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last} string")


def rewritten(docs: DataFrame, length: int = 20) -> DataFrame:
    """docs with its own columns; a text with repeated passages has its kept words joined by one space, others stay."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(_kept_words(t.encode(), b, e)[1]).decode() for t, b, e in zip(texts, begins, ends, strict=True)], dtype=object)

    out = _with_spans(docs, length)
    text = F.when(F.col("__begins").isNull(), F.col("text").cast("string")).otherwise(cut(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("__begins"), F.col("__ends")))
    return out.select(*[text.alias(c) if c == "text" else out[c] for c in docs.columns])
