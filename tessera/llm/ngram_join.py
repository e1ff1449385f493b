"""N-gram Jaccard join with a count-vector R-tree.

Tokens (word shingles) are hashed into groups. Two uses are made of the groups:

* Routing. For sets of sizes a <= b with Jaccard at least P/100, the symmetric difference has at most
  t = (a + b)(100 - P)/(100 + P) tokens, each of which spoils one group. So with more than t groups at least one group
  is the same in both sets. Sets that have a whole group in common (by a hash of its tokens) meet in a bucket. The
  number of groups is a function of the size class; a set enters its own class and the next one, as its partners can
  be larger by one class. Some spare groups make sure that an empty group never has to be matched, unless a set has
  more empty ones than that.
* The R-tree. The counts of tokens in VECTOR fixed groups are a point. No two sets share more tokens than the sum of
  their points' coordinate minima, nor a set and all those below a node more than the minima with the node's largest
  coordinates. In large sets the minima of so few coordinates leave too much, so their points have more (a power of
  two, about a quarter of the tokens), which add up to the VECTOR of the tree and to any number in between. What the
  bound leaves is verified on the token sets.

A bucket is never turned into all its pairs. Its members are first tied to one leader; what that verifies becomes
components, and only stars that stay torn are searched, each by itself, through R-trees of their members, skipping
pairs that are already in one component. All links between different components are found, hence the components are exact.

A bucket that more than one in HOT_KEYS entries falls into never comes to one task: its leader is known beforehand, from
counters that every task keeps of all its entries and that add up, so each entry is tied to it where it is made.

Sets and shingles are compared by 64 random bits. Among n different sets a pair is taken for one set with a chance of
n * n / 2 ** 65: 3 in 10,000 for 10 ** 8 sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Counters, at_home, chunks, discard, frequent, partitions, split_by, stored, texts_of
from .textops import inside, mix, ngrams, owner, words

#: Coordinates of a point in the tree; points in an R-tree leaf and in a block of a large star.
VECTOR, LEAF, BLOCK = 256, 16, 1024
#: Sets that a task remembers so as to send copies of one set only once.
SEEN = 500_000
#: Entries below which a bucket is not frequent.
LEAST_FREQUENT = 64
#: Members of a torn star that all others are compared with before all are compared with all.
PIVOTS = 32


@lru_cache
def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per class: its largest size, the groups it has, and how many of them are spare."""
    limits = [1]
    while limits[-1] < 1 << 40:
        limits.append(max(limits[-1] + 1, limits[-1] * 100 // percent))
    differ = [2 * size * (100 - percent) // (100 + percent) for size in limits]
    spare = []
    for kind, t in enumerate(differ):
        smallest, extra = limits[max(0, kind - 2)], 1
        while extra < t // 2 + 1:  # as many as a set of the smallest size that comes here has empty groups, but for rare ones
            empty = (t + 1 + extra) * math.exp(-smallest / (t + 1 + extra))
            if extra >= empty + 3 * math.sqrt(empty):
                break
            extra = math.ceil(extra * 1.1)
        spare.append(extra)
    return np.array(limits), np.array([t + 1 + s for t, s in zip(differ, spare, strict=True)]), np.array(spare)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different n-word shingles of each text, sorted within it, and each one's text.

    A-Z is folded. A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    w = words(raw, offsets, lower=True)
    whole = inside(w.first, n)
    hashes, text = ngrams(w.hash, n)[whole], owner(w.first)[: len(whole)][whole]
    counts = w.counts
    for t in np.flatnonzero((counts > 0) & (counts < n)):
        h = w.hash[w.first[t] : w.first[t + 1]]
        hashes = np.append(hashes, ngrams(h, len(h)) ^ np.uint64(len(h)))
        text = np.append(text, t)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def _sums(values: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """A hash of the multiset of values in each cell. (Halves of 32 bits are summed exactly in float64.)"""
    low = np.bincount(cell, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), cells).astype(np.uint64)
    high = np.bincount(cell, (values >> np.uint64(32)).astype(np.float64), cells).astype(np.uint64)
    return mix(low * np.uint64(0x9E3779B97F4A7C15) + mix(high))


def group_keys(hashes: np.ndarray, text: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each text, for its own size class and the next: keys and their texts."""
    limits, groups, spare = size_classes(percent)
    own, keys, of = np.searchsorted(limits, sizes), [], []
    for step in (0, 1):
        kind = own + step
        k = np.where(sizes > 0, groups[kind], 0)
        base = np.concatenate([[0], np.cumsum(k)])
        cell = base[text] + ((hashes >> np.uint64(20)) % k[text].astype(np.uint64)).astype(np.int64)
        held = np.bincount(cell, minlength=base[-1])
        whose = np.repeat(np.arange(len(sizes)), k)
        number = np.arange(base[-1]) - base[whose]
        label = mix((kind[whose] * (1 << 40) + number).astype(np.uint64))
        key = mix(_sums(mix(hashes), cell, int(base[-1])) ^ label)
        empties = np.bincount(whose[held == 0], minlength=len(sizes))
        use = (held > 0) | (empties > spare[kind])[whose]
        keys.append(key[use])
        of.append(whose[use])
    return np.concatenate(keys), np.concatenate(of)


def point_dims(sizes: np.ndarray) -> np.ndarray:
    """Coordinates of a set's point: VECTOR, and a power of two of a quarter of its tokens or more."""
    quarter = np.maximum(sizes // 4, 1)
    return np.maximum(VECTOR, 2 ** np.ceil(np.log2(quarter)).astype(np.int64))


def points_of(hashes: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Each set's point: tokens counted by the leading bits of their hashes, as little-endian unsigned 32-bit integers."""
    dims = point_dims(sizes)
    base = np.concatenate([[0], np.cumsum(dims)])
    bits = np.round(np.log2(dims)).astype(np.uint64)
    cell = base[text] + (hashes >> (np.uint64(64) - bits[text])).astype(np.int64)
    counts = np.bincount(cell, minlength=base[-1]).astype("<u4")
    return [counts[lo:hi].tobytes() for lo, hi in zip(base[:-1], base[1:], strict=True)]


def folded(point: bytes, dims: int) -> bytes:
    """The point with neighbouring coordinates added up to so many."""
    return point if len(point) == 4 * dims else np.frombuffer(point, "<u4").reshape(dims, -1).sum(1, dtype="<u4").tobytes()


def shared_at_most(p: list[bytes], q: list[bytes]) -> np.ndarray:
    """The sum of coordinate minima of each p and q, in as many coordinates as both have."""
    out = np.zeros(len(p), np.int64)
    dims = np.array([min(len(a), len(b)) // 4 for a, b in zip(p, q, strict=True)], np.int64)
    for d in np.unique(dims).tolist():
        at, step = np.flatnonzero(dims == d), max(1, (1 << 20) // d)
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            a, b = (np.frombuffer(b"".join(folded(x[i], d) for i in part), "<u4").reshape(-1, d) for x in (p, q))
            out[part] = np.minimum(a, b).sum(1, dtype=np.int64)
    return out


def _shingled(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """rows, hashes and their texts, sizes, sig (a set's hash) and new: whether the task meets a set here first (or again after SEEN others)."""
    seen: set[int] = set()
    for batch in batches:
        for rows, raw, offsets in chunks(batch):
            hashes, text = shingle_sets(raw, offsets, n)
            sizes = np.bincount(text, minlength=len(rows))
            sig = _sums(hashes, text, len(rows)).view(np.int64)
            new = np.zeros(len(rows), bool)
            if len(seen) > SEEN:
                seen.clear()
            named = rows.column(0).is_valid().to_pylist()
            for i, s in enumerate(sig.tolist()):
                if sizes[i] and named[i] and s not in seen:
                    seen.add(s)
                    new[i] = True
            yield rows, hashes, text, sizes, sig, new


def _signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size and sig of each document; a task's first document of a set also has its point.

    Further rows, without a size, hold each task's counters of its buckets: key, n and leader (null key: n of all).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counters = ["doc_id", "size", "sig", "point", "key", "n", "leader"], Counters()
        for rows, hashes, text, sizes, sig, new in _shingled(batches, n):
            point = pa.array([p if own else None for p, own in zip(points_of(hashes, text, sizes), new, strict=True)], pa.binary())
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(sig), point, none, none, none], names)
            take = new[text]
            keys, of = group_keys(hashes[take], text[take], np.where(new, sizes, 0), percent)
            counters.count(keys, sig[of])
        none = pa.nulls(len(counters.n) + 1, pa.int64())
        keys = pa.array([None, *counters.value.view(np.int64).tolist()], pa.int64())
        leaders = pa.array([None, *counters.payload.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(none), pa.binary()), keys, pa.array([counters.total, *counters.n.tolist()], pa.int64()), leaders], names)

    return docs.mapInArrow(run, "doc_id long, size long, sig long, point binary, key long, n long, leader long")


def _frequent_buckets(made: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys of frequent buckets, sorted, and a leader for each. The driver gets fewer than 1.4 * HOT_KEYS rows."""
    counts = stored(made.where("size is null").groupBy("key").agg(F.sum("n").alias("n"), F.min("leader").alias("leader")), "bucket-counts")
    found = frequent(counts, "key", LEAST_FREQUENT).select("key", "leader").collect()
    discard(counts)
    keys = np.array([row.key for row in found], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([row.leader for row in found], np.int64)[order]


def _bucketed(docs: DataFrame, n: int, percent: int, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key and sig: the buckets of each set; leader: of a frequent bucket, whose entries have keys of their own.

    They are made from the texts again, as on disk they would be larger than these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, leaders = often
        for _, hashes, text, sizes, sig, new in _shingled(batches, n):
            take = new[text]
            keys, of = group_keys(hashes[take], text[take], np.where(new, sizes, 0), percent)
            sigs, tied, leader = sig[of], np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                tied, leader = hot[at] == keys, leaders[at]
                keys = np.where(tied, mix(keys + mix(sigs.view(np.uint64))), keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sigs), pa.array(leader, mask=~tied)], ["key", "sig", "leader"])

    return docs.mapInArrow(run, "key long, sig long, leader long")


def _stars(keyed: DataFrame) -> DataFrame:
    """a, b and groups: in each bucket its leader, by default the smallest set (a), with each of the others, and in how many. Buckets stream past, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_leader = None
        for batch in batches:
            tied = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            key, sig, known = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).fill_null(0).to_numpy()
            a, b, key, sig = known[tied], sig[tied], key[~tied], sig[~tied]
            if len(key):
                begins = np.ones(len(key), bool)
                begins[1:] = key[1:] != key[:-1]
                at = np.flatnonzero(begins)
                leaders = sig[at].copy()
                if last_key is not None and key[0] == last_key:
                    leaders[0] = last_leader
                leader = np.repeat(leaders, np.diff(at, append=len(key)))
                last_key, last_leader = key[-1], leader[-1]
                a, b = np.concatenate([a, leader]), np.concatenate([b, sig])
            other = a != b
            order = np.lexsort((b[other], a[other]))
            a, b = a[other][order], b[other][order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(np.diff(at, append=len(a)))], ["a", "b", "groups"])

    spark = keyed.sparkSession
    dealt = keyed.repartition(partitions(spark), "key").sortWithinPartitions("key", "sig")
    return dealt.mapInArrow(run, "a long, b long, groups long").groupBy("a", "b").agg(F.sum("groups").alias("groups"))


def _needed(a, b, percent: int):
    """The tokens that sets of these sizes must share at least, times 100 + percent."""
    return percent * (a + b)


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """pairs with the sizes of both sets (na, nb), and may_link: whether the points' bound allows a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, groups, na, nb, pa_, pb = (batch.column(i) for i in range(7))
            shared = shared_at_most(pa_.to_pylist(), pb.to_pylist())
            may = (100 + percent) * shared >= _needed(na.to_numpy(), nb.to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([a, b, groups, na, nb, pa.array(may)], ["a", "b", "groups", "na", "nb", "may_link"])

    left = points.select(F.col("sig").alias("a"), F.col("size").alias("na"), F.col("point").alias("point_a"))
    right = points.select(F.col("sig").alias("b"), F.col("size").alias("nb"), F.col("point").alias("point_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "groups", "na", "nb", "point_a", "point_b")
    return joined.mapInArrow(run, "a long, b long, groups long, na long, nb long, may_link boolean")


def _verified(pairs: DataFrame, docs: DataFrame, homes: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of pairs (a, b, na, nb) that link, by token sets made again from the text of one document of each set.

    A set is made once for each pair where it is b and once for all where it is a, and crosses the network once. Of
    documents that no pair needs nearly all stay out of the join with the pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in chunks(batch):
                hashes, text = shingle_sets(raw, offsets, n)
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(rows)))]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*rows.columns[:4], tokens], ["sig", "a", "need", "role", "tokens"])

    need = _needed(F.col("na"), F.col("nb"), percent).alias("need")
    members = pairs.select(F.col("b").alias("sig"), "a", need, F.lit("member").alias("role"))
    leaders = pairs.select(F.col("a").alias("sig"), "a").distinct().select("sig", "a", F.lit(0).cast("long").alias("need"), F.lit("leader").alias("role"))
    wanted = stored(homes.join(members.unionByName(leaders), "sig"), "wanted")
    texts = split_by(docs, F.col("doc_id"), wanted, F.col("doc_id"))[0].join(wanted, "doc_id").select("sig", "a", "need", "role", "text")
    sets = stored(texts.mapInArrow(run, "sig long, a long, need long, role string, tokens array<long>"), "token-sets")
    left = sets.where("role = 'member'").select(F.col("sig").alias("b"), "a", "need", F.col("tokens").alias("tokens_b"))
    right = sets.where("role = 'leader'").select("a", F.col("tokens").alias("tokens_a"))
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    links = stored(left.join(right, "a").where(shared * (100 + percent) >= F.col("need")).select("a", "b"), "links")
    discard(sets, wanted)
    return links


class RTree:
    """Points with the sizes of their sets, packed by recursive halving along the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.arange(len(points))
        self.points, self.sizes = points, sizes
        self.root = self._build(0, len(points)) if len(points) else None

    def _build(self, lo: int, hi: int):
        rows = self.order[lo:hi]
        top, small, large = self.points[rows].max(0), self.sizes[rows].min(), self.sizes[rows].max()
        if hi - lo <= LEAF:
            return top, small, large, (lo, hi), None
        along = int(np.argmax(top - self.points[rows].min(0)))
        mid = (hi - lo) // 2
        self.order[lo:hi] = rows[np.argpartition(self.points[rows, along], mid)]
        return top, small, large, None, (self._build(lo, lo + mid), self._build(lo + mid, hi))

    def pairs(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indexes (of the queries, of this tree's points) whose bound allows a link; queries go down together."""
        todo = [(self.root, np.arange(len(points)))] if self.root and len(points) else []
        while todo:
            (top, small, large, leaf, below), who = todo.pop()
            n = sizes[who]
            # sizes alone: 100 * smaller >= percent * larger; then the minima with the node's largest coordinates
            fits = (100 * n >= percent * small) & (100 * large >= percent * n)
            shared = np.minimum(points[who], top).sum(1, dtype=np.int64)
            who = who[fits & ((100 + percent) * shared >= _needed(n, small, percent))]
            if not len(who):
                continue
            if leaf is None:
                todo += [(node, who) for node in below]
                continue
            rows = self.order[leaf[0] : leaf[1]]
            shared = np.minimum(points[who][:, None, :], self.points[rows][None]).sum(2, dtype=np.int64)
            i, j = np.nonzero((100 + percent) * shared >= _needed(sizes[who][:, None], self.sizes[rows][None], percent))
            yield who[i], rows[j]


def _searched(stars: DataFrame, labels: DataFrame, points: DataFrame, percent: int, by_pivots: bool) -> DataFrame:
    """a, b, na and nb: pairs within a star (a, b) but of different labels that the R-trees' bound leaves.

    by_pivots: only those pairs that hold one of the star's pivots, which are a set each of PIVOTS of its labels. They
    are PIVOTS times the members at most, and what they link need not be searched by all pairs, so a large group
    of near copies that its leader does not link to falls together before that.

    Only stars whose members have several labels are searched. A star is cut into blocks of about BLOCK members: a
    label with half a block or more has blocks of its own, the others share blocks. Each pair of blocks is a group
    of its own, but for two blocks of the same label, so a star that is one large component with a few stray members
    costs a pass over its members, not their square.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sig, label, size, block, pivot = (rows.column(c).to_numpy() for c in ("sig", "label", "size", "block", "pivot"))
        fine, leaders = rows.column("point").to_pylist(), [frozenset(x) for x in rows.column("leaders").to_pylist()]
        points_ = np.frombuffer(b"".join(folded(p, VECTOR) for p in fine), "<u4").reshape(-1, VECTOR)
        i, j = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for q, p in RTree(points_[right], size[right]).pairs(points_[left], size[left], percent):
            q, p = left[q], right[p]
            use = (label[q] != label[p]) & ((sig[q] < sig[p]) if i == j else True)
            if by_pivots:
                use &= pivot[q] | pivot[p]
            q, p = q[use], p[use]
            if not by_pivots:  # a pair of several stars is taken in the smallest of them
                here = np.array([min(leaders[x] & leaders[y]) == key[0].as_py() for x, y in zip(q.tolist(), p.tolist(), strict=True)], bool)
                q, p = q[here], p[here]
            shared = shared_at_most([fine[x] for x in q], [fine[x] for x in p])
            use = (100 + percent) * shared >= _needed(size[q], size[p], percent)
            found.append((q[use], p[use]))
        q, p = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": sig[q], "b": sig[p], "na": size[q], "nb": size[p]})

    spokes = stars.select("a", F.col("b").alias("sig")).unionByName(stars.select("a", F.col("a").alias("sig")).distinct())
    members = spokes.join(labels.select(F.col("node").alias("sig"), F.col("component").alias("label")), "sig", "left")
    members = stored(members.withColumn("label", F.coalesce("label", "sig")), "star-members")
    counts = members.groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"), F.min("sig").alias("head"))
    few = F.sum(F.when(F.col("n") < BLOCK // 2, F.col("n")).otherwise(0)).alias("few")
    torn = stored(counts.join(counts.groupBy("a").agg(F.count(F.lit(1)).alias("labels"), few).where("labels > 1"), "a"), "torn-stars")
    first = torn.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("label"))).where(F.col("rank") <= PIVOTS)
    pivots = first.select("a", F.col("head").alias("sig"), F.lit(True).alias("pivot"))
    own = F.col("n") >= BLOCK // 2
    number = lambda n: F.pmod(F.xxhash64("sig"), F.greatest(F.lit(1), F.ceil(n / BLOCK)))
    placed = members.join(torn, ["a", "label"]).select(
        "a", "sig", "label", F.when(own, F.col("label")).alias("pure"),
        F.when(own, F.xxhash64("label", number(F.col("n")))).otherwise(F.xxhash64(number(F.col("few")))).alias("block"),
    )
    placed = stored(placed.join(pivots, ["a", "sig"], "left").withColumn("pivot", F.coalesce("pivot", F.lit(False))), "placed")
    blocks = stored(placed.select("a", "block", "pure").distinct().groupBy("a").agg(F.collect_list(F.struct("block", "pure")).alias("blocks")), "blocks")
    dealt = placed.join(blocks, "a").withColumn("other", F.explode("blocks")).drop("blocks")
    dealt = dealt.where("pure is null or other.pure is null or pure <> other.pure")
    dealt = dealt.join(points, "sig").join(placed.groupBy("sig").agg(F.collect_set("a").alias("leaders")), "sig").select("a", F.least("block", "other.block").alias("i"), F.greatest("block", "other.block").alias("j"), "sig", "label", "size", "point", "block", "pivot", "leaders")
    return dealt.repartition(partitions(stars.sparkSession), "a", "i", "j").groupBy("a", "i", "j").applyInArrow(run, "a long, b long, na long, nb long")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with la and lb, the labels of a and b: a set without a label is its own."""
    for c in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"l{c}")), c, "left")
        pairs = pairs.withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    return pairs


def _more_links(pairs: DataFrame, docs: DataFrame, homes: DataFrame, n: int, percent: int) -> DataFrame | None:
    """Those of pairs (a, b, na, nb) that link; without pairs nothing is read again."""
    pairs = stored(pairs.select("a", "b", "na", "nb"), "pairs")
    return None if pairs.isEmpty() else _verified(pairs, docs, homes, n, percent)


def link_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of each document: links are Jaccard >= percent / 100 of n-word shingle sets.

    component_id is the smallest doc_id reachable by links. Texts are whole; sets are compared by 64-bit hashes of
    shingles, and documents of one set are one node (copies are never expanded into pairs). Documents without words
    have an empty set and are linked with nothing. A null text has no words. A row without doc_id ties
    nothing together; its component is that of documents with the same set, or null. Repeated rows are copies. An
    empty table gives no rows; other columns are left behind.
    """
    (docs,) = at_home(texts_of(docs))
    made = stored(_signatures(docs, n, percent), "signatures")
    points = stored(made.where("point is not null").groupBy("sig").agg(F.first("size").alias("size"), F.first("point").alias("point")), "points")
    homes = stored(made.where("size > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "homes")

    # the buckets' shuffle, the largest, has gone from disk before points are shuffled
    tied = stored(_stars(_bucketed(docs, n, percent, _frequent_buckets(made))), "tied")
    stars = stored(_bounded(tied, points, percent), "stars")
    discard(tied)
    # a member first tries the leader that it shares most groups with; then other leaders, if that left them apart
    best = Window.partitionBy("b").orderBy(F.desc("groups"), "a")
    likely = stars.where("may_link").withColumn("rank", F.row_number().over(best)).where("rank = 1").select("a", "b", "na", "nb")
    links = _verified(likely, docs, homes, n, percent)
    labels = stored(components(links, "a", "b"), "labels")
    apart = _labelled(stars.where("may_link").join(likely.select("a", "b"), ["a", "b"], "left_anti"), labels).where("la <> lb")
    if (more := _more_links(apart, docs, homes, n, percent)) is not None:
        links = links.unionByName(more)
        labels = stored(components(links, "a", "b"), "labels")

    # pairs of a star, and those of the pivots, are verified already
    tried = stars.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    for by_pivots in (True, False):
        found = _searched(stars, labels, points, percent, by_pivots).distinct().withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
        found = stored(found.join(tried, ["low", "high"], "left_anti"), "found")
        if (more := _more_links(found, docs, homes, n, percent)) is not None:
            links = links.unionByName(more)
            if by_pivots:
                labels = stored(components(links, "a", "b"), "labels")
        tried = tried.unionByName(found.select("low", "high"))
    discard(points, stars)

    # a set's node is its smallest doc_id from here on, so a component's smallest node is its id
    for c in ("a", "b"):
        links = links.join(homes.select(F.col("sig").alias(c), F.col("doc_id").alias(f"d{c}")), c)
    final = components(links, "da", "db")
    sets = homes.join(final, F.col("doc_id") == F.col("node"), "left").select("sig", F.coalesce("component", "doc_id").alias("component_id"))
    rows = made.where("size is not null").select("doc_id", F.col("size").alias("n_shingles"), "sig")
    out = rows.join(stored(sets, "components"), "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with its own columns, and of each group of linked documents only the row with the smallest doc_id.

    Of repeated rows with one doc_id one stays. Rows without a doc_id are not judged and all stay. Only texts of
    documents that go or are repeated are shuffled, and few others (see shared.split_by).
    """
    (docs,) = at_home(docs)
    groups = link_components(docs, n, percent).where("doc_id is not null").groupBy(F.col("doc_id").alias("__doc"))
    judged = groups.agg(F.count(F.lit(1)).alias("__rows"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("__chosen"))
    unsure = stored(judged.where("__rows > 1 or not __chosen"), "not-chosen-or-repeated")
    some, single = split_by(docs.where("doc_id is not null"), docs["doc_id"].cast("long"), unsure, F.col("__doc"))
    gone = unsure.where("not __chosen").select("__doc")
    some = some.join(gone, docs["doc_id"].cast("long") == F.col("__doc"), "left_anti").dropDuplicates(["doc_id"])
    return some.union(single).union(docs.where("doc_id is null"))
