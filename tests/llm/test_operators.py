"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, components, encoders, line_dedup, ngram_join, packing, quality_classifier, quality_rules, shared, substring_dedup, token_counts, url_rules, vector_search
from tessera.llm.queries import URL_RULES

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size long, h1 string, label string"


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = prose(60)
    texts = [prose(rng.randint(1, 300)) + "\n" + prose(30) for _ in range(40)]
    base = prose(200)
    for k in range(12):  # near copies
        words = base.split(" ")
        words[rng.randrange(200)] = f"changed{k}"
        texts.append(" ".join(words))
    texts += [base, base.upper(), texts[0], texts[0], f"{prose(50)} {shared} {prose(9)}", f"{shared}\n{prose(80)}", shared]
    texts += ["", None, " \n\t ", "one", "Same Same two", "a  b \n\n c's <|endoftext|> \x85　x", "solo " * 100, prose(30_000), "x" * 5_000, "line that is long enough to count\nshort\nline that is long enough to count"]
    texts += ["Line that is LONG enough to count \nq", "line that is long enough to count"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5]), (None, None)]
    rng.shuffle(rows)
    return rows


ROWS = corpus()
ONCE = list({d: (d, t) for d, t in ROWS if d is not None}.values())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None, None if d == 4 else f"host{(d or 0) % 3}", None, 1, 2, "h", "l") for d, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(df, expected):
    assert got(df) == sorted(expected, key=repr)


def test_packing(docs, none):
    tokenizer = encoders.library_tokenizer(JSON)
    pieces = packing.pack(docs, JSON, public_tokenizers.PATTERN, size=64, with_ids=True).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
        assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and p.length * 4 == len(p.ids)
    for parts in by_sequence.values():
        fill = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == fill
            fill += p.length
        assert fill == 64 or fill & (fill - 1) == 0
    assert by_doc.keys() == {d for d, _ in ROWS}
    alone = {d for d, n in Counter(d for d, _ in ROWS).items() if n == 1}
    for doc_id, text in ONCE:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        copies = sum(d == doc_id for d, _ in ROWS)
        parts = sorted(by_doc[doc_id], key=lambda p: p.start)
        assert {p.doc_tokens for p in parts} == {len(ids)} and sum(p.length for p in parts) == copies * len(ids)
        if copies == 1:
            assert np.frombuffer(b"".join(bytes(p.ids) for p in parts), "<u4").tolist() == ids
    for parts in by_sequence.values():  # what follows itself in a sequence is one piece
        parts.sort(key=lambda p: p.offset)
        assert not any((a.doc_id, a.start + a.length) == (b.doc_id, b.start) and b.doc_id in alone for a, b in zip(parts, parts[1:], strict=False))
    assert packing.pack(none, JSON, public_tokenizers.PATTERN).count() == 0


def test_packing_streams_hold_like_bytes(spark):
    """Long texts side by side on the curve, one of them as long as a stream, and many short ones."""
    long = [(k, "alpha beta gamma delta " * 2_000) for k in range(40)] + [(40, "alpha beta gamma delta " * 30_000)]
    short = [(100 + k, f"word{k % 50} other{k % 7} " * 40) for k in range(600)]
    pieces = packing.pack(spark.createDataFrame(long + short, "doc_id long, text string"), JSON, public_tokenizers.PATTERN).collect()
    streams = Counter()
    for p in pieces:
        streams[p.sequence_id // packing.STRIDE] += p.length
    total = sum(streams.values())
    assert total == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert len(streams) > 1 and max(streams.values()) < 0.5 * total


def test_hilbert_neighbours_touch():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = side[np.argsort(packing.hilbert_keys(side, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_byte_bpe(docs, none):
    encoding = encoders.rank_encoding(RANKS, public_tokenizers.PATTERN)
    expected = [(d, encoding.encode_ordinary(t or ""), (t or "").encode()) for d, t in ROWS]
    out = byte_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN)
    same(out, [(d, len(i), bytearray(np.array(i, "<u4").tobytes()), bytearray(b)) for d, i, b in expected])
    same(byte_bpe.decode(out, RANKS, public_tokenizers.PATTERN), [(d, bytearray(b)) for d, _, b in expected])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    same(byte_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN, digests=True), [(d, len(i), sha(np.array(i, "<u4").tobytes()), sha(b)) for d, i, b in expected])
    assert byte_bpe.encode_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_parts_are_safe():
    encoding = encoders.rank_encoding(RANKS, public_tokenizers.PATTERN)
    text = " ".join(t or "" for _, t in ROWS) + "  end\n\n don't  stop 's" * 50
    for size in (7, 100, 999):
        parts = encoders.safe_parts(text, size)
        assert len(parts) > 3 and "".join(parts) == text
        assert [i for p in parts for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_units_give_the_ids_of_whole_texts(monkeypatch):
    """Words, digits, apostrophes, odd white space and special strings, by units and by parts of a long text."""
    rng = random.Random(8)
    pieces = ["don't", "it's", "12,345", "é", "日本語", "\u3000", "\t", "\n", "\n\n", " ", "  ", "a", "Zebra", "<|endoftext|>", "😀", "x" * 50, "\x00", "'s", "--", "\x85"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts.append(" ".join(rng.choice(["alpha", "beta", "don't", "7"]) for _ in range(90_000)) + "  " + "<|endoftext|>")
    tokenizer = encoders.library_tokenizer(JSON)
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(encoders, "CACHE_UNITS", 50)
    assert len(texts[-1]) > 2 * encoders.LONG_TEXT
    assert [np.frombuffer(b, "<u4").tolist() for b in encoders.encode_all(encoders.json_encoding(JSON, public_tokenizers.PATTERN), texts)] == expected
    assert encoders.count_all(JSON, texts) == list(map(len, expected))


def test_token_counts(docs, none):
    tokenizer = encoders.library_tokenizer(JSON)
    n = {t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in ROWS}
    same(token_counts.count_tokens(docs, JSON, 512), [(d, len((t or "").encode()), n[t], n[t] > 512) for d, t in ROWS])
    assert token_counts.count_tokens(none, JSON, 512).count() == 0


def shingles(text, n):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def joined(rows, n, percent):
    sets, parent = {d: shingles(t, n) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_ngram_join(docs, none, n, percent):
    expected = joined(ONCE, n, percent)
    out = ngram_join.link_components(docs, n, percent)
    same(out.where("doc_id is not null"), [(d, *expected[d]) for d, _ in ROWS if d is not None])
    assert ngram_join.link_components(none, n, percent).count() == 0
    left = ngram_join.one_of_each(docs, n, percent)
    assert left.schema == docs.schema
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(d for d, (_, c) in expected.items() if d == c)


def test_ngram_join_of_hot_buckets_and_torn_stars(spark, monkeypatch):
    """A passage in most texts, a large group of near copies and strays beside it, with blocks and counts of a few sets."""
    rng = random.Random(6)
    prose = lambda n: [f"v{rng.randrange(300)}" for _ in range(n)]
    passage, base = prose(30), prose(80)
    rows = [(k, " ".join(prose(5) + passage + prose(4))) for k in range(60)]
    rows += [(100 + k, " ".join(base[: 79 - k % 4] + [f"n{k}"] * (k % 3))) for k in range(60)]
    rows += [(300 + k, " ".join(base[:60] + prose(4 + k))) for k in range(20)] + [(400, "v1 v2"), (401, "V1 v2"), (402, None), (100, rows[60][1])]
    expected = joined(list({d: (d, t) for d, t in rows}.values()), 4, 85)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for least in (64, 3):
        monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", least)
        same(ngram_join.link_components(frame), [(d, *expected[d]) for d, _ in rows])
    assert len({c for _, c in expected.values()}) < 140


def test_rtree_finds_all_pairs():
    rng = np.random.default_rng(2)
    points = rng.poisson(3, (300, ngram_join.VECTOR)).astype("<u4")
    points[150:] = np.maximum(points[:150].astype(int) + rng.integers(-1, 2, (150, ngram_join.VECTOR)) * (rng.random((150, ngram_join.VECTOR)) < 0.2), 0)
    sizes = points.sum(1).astype(np.int64)
    found = {(q, p) for a, b in ngram_join.RTree(points, sizes).pairs(points, sizes, 85) for q, p in zip(a.tolist(), b.tolist(), strict=True)}
    brute = {(i, j) for i in range(300) for j in range(300) if 185 * np.minimum(points[i], points[j]).sum() >= 85 * (sizes[i] + sizes[j])}
    assert found == brute


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    frame = spark.createDataFrame(edges, "a long, b long")
    here = dict(got(components.components(frame, "a", "b")))
    kept, components.LOCAL = components.LOCAL, 0
    try:
        assert dict(got(components.components(frame, "a", "b"))) == here
    finally:
        components.LOCAL = kept
    assert all(here[a] == here[b] for a, b in edges if a != b) and all(c <= n for n, c in here.items())
    assert components.components(frame.where("false"), "a", "b").count() == 0


def stats(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def judged(rows):
    """Brute force: (row's position) -> stats, lost words, kept, and the text that is left. rows: doc_id, text, host."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders, members = defaultdict(set), defaultdict(set)
    name = lambda d, t: ("text", t or "") if d is None else d
    for d, t, host in rows:
        members[host].add(name(d, t))
        for line in (t or "").split("\n"):
            if key(line):
                holders[host, key(line)].add(name(d, t))
    limit = {h: max(5, min(0.1 * len(m), 2 * len(m) ** 0.5)) for h, m in members.items()}
    out = []
    for _, t, host in rows:
        lines = (t or "").split("\n")
        above = [line for line in lines if len(holders.get((host, key(line)), ())) > limit[host]]
        lost, (n, *_, failed) = sum(len(WORD.findall(x)) for x in above), stats(t)
        kept = not failed and not (lost > 0 and (n - lost < 20 or n - lost <= 0.5 * n))
        out.append((*stats(t), lost, kept, "\n".join(x for x in lines if x not in above) if above else t))
    return out


def check_rules(spark_rows, rows):
    expected = judged(rows)
    same(quality_rules.judge(spark_rows), [(d, *e[:-1]) for (d, _, _), e in zip(rows, expected, strict=True)])
    left = quality_rules.accepted(spark_rows)
    assert left.schema == spark_rows.schema
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(((d, e[-1]) for (d, _, _), e in zip(rows, expected, strict=True) if e[-2]), key=repr)
    return expected


def test_quality_rules(docs, none):
    check_rules(docs, [(d, t, None if d == 4 else f"host{(d or 0) % 3}") for d, t in ROWS])
    assert quality_rules.judge(none).count() == quality_rules.accepted(none).count() == 0


def test_lines_above_limits_and_depleted_documents(spark):
    words = lambda k, n=30: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(k, f"Menu A\n{words(k)}\n\n \tmENU a\r\nÉtage {k % 2}\n", "a") for k in range(60)]
    rows += [(100 + k, f"{words(k)}\nno host", None) for k in range(30)] + [(200 + k, ("Menu A\n" if k % 2 else "") + f"{words(k)} b", "b") for k in range(20)]
    rows += [(400 + k, f"Menu A\n{words('m', 40)}\nonly {words(k, 50 if k == 3 else 9)}", "a") for k in range(8)]
    rows += [(500 + k, words("copied"), "c") for k in range(9)] + [(600 + k, words(k), "c") for k in range(30)]
    rows += [(700 + k, f"{words(k)}\n{'five' if k < 5 else 'six' if k < 11 else 'none'}", "d") for k in range(14)]
    rows += [(None, f"{words('n')}\nsix", "d"), (None, f"{words('n')}\nsix", "d"), (705, f"{words(5)}\nsix", "d"), (300, "Menu A", "a"), (301, None, "a")]
    expected = check_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), rows)
    verdict = {d: (e[-3], e[-2]) for (d, _, _), e in zip(rows, expected, strict=True)}
    assert not verdict[400][1] and verdict[403][1] and not verdict[500][1] and verdict[705][0] == 1 and verdict[700][0] == 0
    assert sum(lost > 0 for lost, _ in verdict.values()) > 100


def test_substring_dedup(docs, none):
    seen, expected = set(), {}
    for d, t in sorted(ONCE):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(tuple(w[i : i + 20]))
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[d] = (len(w), sum(gone), kept.decode())
    out = substring_dedup.remove_repeats(docs)
    same(out.where("doc_id is not null"), [(d, *expected[d]) for d, _ in ROWS if d is not None])
    assert all(r.n_removed == 0 for r in out.where("doc_id is null").collect()) and sum(n for _, n, _ in expected.values()) > 500
    new = substring_dedup.rewritten(docs)
    assert new.schema == docs.schema
    assert {r.doc_id: r.text for r in new.where("doc_id is not null").collect()} == {d: expected[d][2] if expected[d][1] else t for d, t in ONCE}
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_of_hot_seeds_and_passages(spark, monkeypatch):
    """A passage in every second text, a five-word phrase in all, near copies, and a frequent seed's own path."""
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    passage, phrase, base = prose(26), prose(5), prose(90)
    rows = [(k, f"{prose(12)} {passage if k % 2 else ''} {prose(9)} {phrase} {prose(20)}") for k in range(150)]
    rows += [(1000 + k, " ".join(x if j != k % 90 else f"new{k}" for j, x in enumerate(base.split()))) for k in range(120)]
    rows += [(2000, "ab " * 70), (2001, None), (1000, rows[150][1])]
    seen, expected = set(), {}
    for d, t in sorted({d: t or "" for d, t in rows}.items()):
        w = t.split()
        gone = set()
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone |= set(range(i, i + 20))
            seen.add(tuple(w[i : i + 20]))
        expected[d] = " ".join(x for i, x in enumerate(w) if i not in gone)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for least in (64, 3):
        monkeypatch.setattr(substring_dedup, "LEAST_FREQUENT", least)
        named = shared.texts_of(shared.at_home(docs)[0])
        assert (len(substring_dedup._frequent_seeds(named, 20)) > 0) == (least == 3) or least == 64
        assert {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(docs).collect()} == expected


def test_counters_miss_no_frequent_value():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.zipf(1.3, 20_000).astype(np.uint64), rng.integers(10**6, 10**9, 20_000).astype(np.uint64)])
    rng.shuffle(values)
    counters = shared.Counters(200)
    for part in np.array_split(values, 37):
        counters.count(part)
    found = dict(zip(counters.value.tolist(), counters.n.tolist(), strict=True))
    exact = Counter(values.tolist())
    assert len(found) <= 200 and counters.total == 40_000
    assert all(n - 200 <= found.get(v, 0) <= n for v, n in exact.items() if n > 200)


def test_line_dedup(docs, none):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = defaultdict(set)
    for d, t in ONCE:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    kept = lambda d, line: d is None or len(key(line)) < 20 or len(holders[key(line)]) < 3 or d == max(holders[key(line)])
    expected = []
    for d, t in ROWS:
        lines = (t or "").split("\n")
        stay = [x for x in lines if kept(d, x)]
        expected.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    same(line_dedup.counted(docs), expected)
    new = line_dedup.rewritten(docs)
    assert new.columns == docs.columns and sorted((r.doc_id or -1, r.text) for r in new.collect()) == sorted((e[0] or -1, e[1]) for e in expected)
    assert line_dedup.counted(none).count() == 0


def test_line_runs(spark):
    (spark_rows,) = shared.at_home(spark.range(1))
    make = spark_rows.sparkSession.createDataFrame
    runs = line_dedup.LineRuns(fanout=2)
    batches = [make([(90 - 10 * k + d, h, h) for d in range(3) for h in range(k, k + 3)], "doc_id long, h1 long, h2 long") for k in range(5)]
    for k, batch in enumerate(batches):
        assert sorted(r.h1 for r in runs.unseen(batch).select("h1").distinct().collect()) == ([0, 1, 2] if k == 0 else [k + 2])
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    # a hash's keeper is the largest document of the batch that the anti-join found it new in
    assert {r.h1: (r.n_docs, r.keeper) for r in runs.entries().collect()} == {h: (3 * sum(k <= h < k + 3 for k in range(5)), 90 - 10 * max(0, h - 2) + 2) for h in range(7)}
    assert sorted(r.h1 for r in runs.unseen(make([(1, 3, 3), (1, 99, 99)], "doc_id long, h1 long, h2 long")).collect()) == [99]
    text = runs.unseen(batches[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "LeftAnti" in text


def texts_shuffled(df):
    """Rows with a text that the exchanges of the last query of df wrote."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec" and "text#" in node.output().toString():
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        todo += below or [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_texts_that_change_nothing_are_not_shuffled(spark):
    prose = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    common = "a line of the menu that is long enough"
    rows = [(k, prose(k) + (f"\n{common}" if k < 30 else ""), "host") for k in range(600)] + [(600 + k, prose(599), "host") for k in range(20)] + [(3, prose(3), "host")]
    (docs,) = shared.at_home(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    docs.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    docs = shared.stored(docs, "docs")
    for rewritten, least in ((quality_rules.accepted, 0), (line_dedup.rewritten, 29), (ngram_join.one_of_each, 2)):
        assert least <= texts_shuffled(rewritten(docs)) <= 60, rewritten


def test_split_by_misses_no_key(spark):
    (rows,) = shared.at_home(spark.range(40_000).selectExpr("if(id = 7, null, id) as id", "id % 5 as other"))
    keys = shared.stored(rows.selectExpr("id * 8 as k").where("k < 40000"), "keys")
    some, rest = shared.split_by(rows, rows["id"], keys, keys["k"])
    some, rest = ([r.id for r in part.collect()] for part in (some, rest))
    assert sorted((some + rest), key=str) == sorted((r.id for r in rows.collect()), key=str)
    assert {i for i in range(0, 40_000, 8) if i != 56} <= set(some) and len(some) < 5_100
    some, rest = shared.split_by(rows, rows["id"], keys.where("false"), F.col("k"))
    assert some.count() == 0 and rest.count() == 40_000


def test_line_dedup_with_a_line_in_a_third_of_all_documents(spark):
    common = "the same long line in very many documents"
    rows = [(k, f"{common}\nonly here, in document {k}" if k % 3 == 0 else f"nothing but document number {k}") for k in range(3000)]
    rows += [(0, rows[0][1]), (1, rows[1][1])]
    out = line_dedup.counted(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(out) == 3002 and sum(r.n_dropped for r in out) == 1000
    assert [r.doc_id for r in out if common in r.kept_text] == [2997]


def test_classifier(spark, docs, none):
    rng = random.Random(9)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(60)]
    rows = [(k, " ".join(rng.choices(good if k % 3 else bad, k=30) + rng.choices(["the", "of"], k=20)), "l") for k in range(600)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), None) for k in range(600)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(texts, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in out)
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in out if r.held_out]) > 0.95
    blank = quality_classifier.classify(docs, labels.where("false"))
    assert blank.count() == len(ROWS) and {r.score for r in blank.collect()} == {0.5}
    assert quality_classifier.classify(none, labels).count() == 0


def test_classifier_against_plain_updates(spark):
    """The same updates one feature at a time, on words and pairs by name: equal scores, so hashing and arrays add nothing."""
    q, rng = quality_classifier, random.Random(4)
    vocabulary = "alpha Beta gamma delta epsilon zeta".split()
    rows = [(k, " ".join(rng.choices(vocabulary, (6, 1, 1, 1, 1, 1) if k % 2 else (1, 1, 1, 1, 1, 4), k=rng.randint(0, 25)))) for k in range(120)] + [(500, None)]

    def bag(text):
        w = WORD.findall(text or "")
        found = Counter(w) + Counter("the same twice" if a == b else (a, b) for a, b in itertools.pairwise(w))
        return {f: c / math.sqrt(found.total()) for f, c in found.items()} | {"the bias": 1.0}

    z, n = defaultdict(float), defaultdict(float)
    weight = lambda f: 0.0 if abs(z[f]) <= q.L1 else -(z[f] - math.copysign(q.L1, z[f])) / ((q.OFFSET + math.sqrt(n[f])) / q.STEP + q.L2)
    chance = lambda x: 1 / (1 + math.exp(-sum(weight(f) * v for f, v in x.items())))
    learned, order = np.array([k for k in range(120) if zlib.crc32(str(k).encode()) % 4 != 2]), np.random.Generator(np.random.PCG64(3))
    for _ in range(q.EPOCHS):
        for k in order.permutation(learned).tolist():
            x = bag(rows[k][1])
            wrong = chance(x) - k % 2
            for f, w, v in [(f, weight(f), v) for f, v in x.items()]:
                z[f] += wrong * v - (math.sqrt(n[f] + (wrong * v) ** 2) - math.sqrt(n[f])) / q.STEP * w
                n[f] += (wrong * v) ** 2
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in q.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels).collect()}
    assert out.keys() == {k for k, _ in rows} and max(out.values()) > 0.8 and min(out.values()) < 0.2
    assert all(abs(out[k] - chance(bag(t))) < 1e-5 for k, t in rows)


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return host.translate(FOLD), path


URLS = ["http://A.Example.com/en/7x?q=1", "https://example.com/en/8", "http://b.example.net/de/80", "http://example.net/de/7", "http://x.org/es/", "http://x.org/ES/", "http://", "nothing", None, "", "http://com/en/", "http://notcom/en/1", "http://h.example.com?x://y/en/", "HTTP://spam.example.org/fr/1#a", "http://x.org/es/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, html string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rank = sorted(URL_RULES, key=lambda r: -len(r[1]))
    expected = []
    for i, url in enumerate(URLS):
        host, path = url_parts(url)
        fits = [(r, v) for v, r in rank if (f".{host}").endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
        expected.append((i, host, path, *(fits[0] if fits else (None, "allow"))))
    same(url_rules.judge(pages, URL_RULES, labels), expected)
    assert url_rules.judge(pages.where("false"), URL_RULES, labels).count() == 0


def mined(labelled, support, certainty):
    """Brute force over all token sets: {(tokens, label): certainty} after pruning."""
    baskets = [(frozenset(t), "block" if bad else "allow") for t, bad in labelled]
    share, above = Counter(label for _, label in baskets), {}
    for size in (1, 2, 3):
        for tokens in {c for t, _ in baskets for c in itertools.combinations(sorted(t), size)}:
            having = Counter(label for t, label in baskets if t.issuperset(tokens))
            for label, n in having.items():
                base = share[label] / len(baskets)
                sure = (n / sum(having.values()) - base) / (1 - base) if base < 1 else 0
                if n >= support * len(baskets) and sure >= certainty:
                    above[tokens, label] = sure
    return {(t, x): c for (t, x), c in above.items() if not any(x == y and set(p) < set(t) and d >= c for (p, y), d in above.items())}


def test_mined_url_rules(spark):
    rng = random.Random(2)
    urls = [f"http://{rng.choice(['a.', 'm.', ''])}{rng.choice(['pills', 'news', 'shop'])}.{rng.choice(['net', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{k}{rng.choice(['?ref=1&page=2', '', '.html'])}" for k in range(240)]
    urls += [urls[0], "http://long.net/" + "x/" * 30_000 + "end?" + "&".join(f"q{'abcdefgh'[i % 8]}={i}" for i in range(9_000)), "nothing", "http://"]
    bad = [rng.random() < (0.8 if "pills" in u and "/fr/" in u else 0.5 if "shop" in u else 0.1) for u in urls]
    labelled = spark.createDataFrame(list(zip(urls, bad, strict=True)), "url string, bad boolean")
    (own,) = shared.at_home(labelled)
    tokens = {r.url: r.t for r in own.select("url", url_rules.tokens_of(own.url).alias("t")).collect()}
    expected = mined([(tokens[u], b) for u, b in zip(urls, bad, strict=True)], 0.02, 0.1)
    rules = url_rules.mine(own)
    assert {(tuple(r.tokens), r.label): round(r.certainty, 9) for r in rules.collect()} == {k: round(v, 9) for k, v in expected.items()}
    assert {label for _, label in expected} == {"allow", "block"} and max(len(t) for t, _ in expected) > 1
    others = own.select("url").unionByName(own.sparkSession.createDataFrame([("https://pills.example/fr/x",)], "url string")).distinct()
    best = {u: max(((c, x) for (t, x), c in expected.items() if set(t) <= set(ts)), default=None) for u, ts in (tokens | {"https://pills.example/fr/x": ["host:pills", "host:example", "path:fr", "path:x"]}).items()}
    assert {r.url: r.verdict for r in url_rules.matched(others, rules).collect()} == {u: b[1] for u, b in best.items() if b}


@pytest.mark.parametrize(("shard", "block"), [(8192, 1024), (200, 16)])
def test_vector_search(spark, monkeypatch, shard, block):
    monkeypatch.setattr(vector_search, "SHARD", shard)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((1500, 16)).astype(np.float32)
    vectors[300:400] = vectors[300]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [float("inf")] * 16), (None, [1.0] * 16), (0, rows[0][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    out = vector_search.nearest(table, table.where("vec_id % 20 = 0"), k=10)
    found = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert found.keys() == set(range(0, 1500, 20))
    exact, hits = vectors.astype(np.float64), 0
    for q, rows_ in found.items():
        score = (exact * exact[q]).sum(1)
        assert [r[0] for r in rows_] == list(range(1, 11)) and all(abs(s - score[v]) < 1e-12 and v != q for _, v, s in rows_)
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1500), -score))[:10].tolist()) & {v for _, v, _ in rows_})
    assert hits >= 0.95 * 10 * len(found)
    few = vector_search.nearest(table.where("vec_id < 5"), table.where("vec_id = 0"), k=10)
    assert [r.vec_id for r in few.collect() if r.vec_id == 0] == [] and few.count() == 4
    assert vector_search.nearest(table.where("false"), table.where("false")).count() == 0


def test_finer_points_bound_shared_tokens():
    rng = np.random.default_rng(3)
    both = rng.integers(0, 2**63, 9000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(both[:6000]), np.unique(both[1000:]), np.unique(both[:300]), np.unique(both[5900:9000])]
    sizes = np.array([len(s) for s in sets])
    points = ngram_join.points_of(np.concatenate(sets), np.repeat(np.arange(4), sizes), sizes)
    assert [len(p) // 4 for p in points] == ngram_join.point_dims(sizes).tolist() == [2048, 2048, 256, 1024]
    pairs = [(i, j) for i in range(4) for j in range(4)]
    bound = ngram_join.shared_at_most([points[i] for i, _ in pairs], [points[j] for _, j in pairs])
    coarse = ngram_join.shared_at_most([ngram_join.folded(points[i], 256) for i, _ in pairs], [points[j] for _, j in pairs])
    exact = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in pairs])
    assert (exact <= bound).all() and (bound <= coarse).all()
