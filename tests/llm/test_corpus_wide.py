"""Decontamination, whitening and spelling variants against brute force, and their edge rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterbook.llm import spelling, suffix_search, whitening
from meterbook.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, word string, __text string, __items int"
ITEMS = "item_id bigint, text string, doc_id int"
TEN = " ".join(f"w{i}" for i in range(10))
LONG = " ".join(f"long{i % 700}" for i in range(3000))


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower().decode())


def brute_hits(docs, items):
    """{position in docs: (n_words, n_hit, ids)} window by window."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for at in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[at:at + 10])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for size in sizes:
            for at in range(len(w) - size + 1):
                found = windows.get(tuple(w[at:at + size]))
                if found:
                    hit |= set(range(at, at + size))
                    ids |= found
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


CASES = [(1, f"Before {TEN.upper()} after"), (2, None), (3, ""), (4, "short one"), (4, "a SHORT-one b short one"), (None, TEN),
         (6, TEN + " " + TEN), (7, " ".join(TEN.split()[:9])), (8, LONG), (9, "x " * 3000 + LONG), (10, "ÄÖ ß 漢字 short one"),
         (11, TEN), (11, TEN), (12, " \n\t.,;"), (13, " ".join(TEN.split()[::-1]))]
BENCH = [(100, TEN), (9, TEN + " w10 w11"), (20, "Short one"), (None, "ß 漢字"), (30, None), (31, " .. "), (100, "short one"),
         (50, LONG), (60, " ".join(TEN.split()[3:]) + " " + TEN)]


@pytest.mark.parametrize("block_bytes", [1 << 24, 12_000])
def test_decontamination_is_brute_force(spark, block_bytes):
    docs = spark.createDataFrame([(i, t, "w", "t", 1) for i, t in CASES], DOCS)
    bench = spark.createDataFrame([(i, t, 0) for i, t in BENCH], ITEMS)
    found = suffix_search.report(docs, bench, block_bytes=block_bytes)
    got = sorted((tuple(r)[:6] for r in found.collect()), key=str)
    assert got == brute_hits(CASES, BENCH)
    assert all(sum(h["end"] - h["start"] for h in r["hits"]) == r["n_hit"] for r in found.collect())
    clean = suffix_search.decontaminate(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert sorted(r.text or "" for r in clean.collect()) == sorted(t or "" for (i, t), r in zip(
        CASES, (brute_hits([c], BENCH)[0] for c in CASES), strict=True) if not r[5])


def test_documents_are_cut_into_shards(monkeypatch):
    monkeypatch.setattr(suffix_search, "SHARD_WORDS", 64)
    block = suffix_search.Block([(str(i), (t or "").encode().lower()) for i, t in BENCH])
    texts = [suffix_search.word_hashes((t or "").encode().lower()) for _, t in CASES]
    small = block.locations(texts)
    monkeypatch.undo()
    assert np.array_equal(small, block.locations(texts))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 4, int(n)).astype(np.uint64) for n in rng.integers(0, 60, 30)]
    shard = suffix_search.Shard(texts, 64)
    flat = shard.words.tolist()
    suffixes = [flat[i:i + 70] for i in shard.order.tolist()]
    ends = [s[:s.index(0)] for s in suffixes]
    assert ends == sorted(ends) and len(ends) == sum(map(len, texts))


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(30)) + " y"), (2, LONG), (3, TEN)], "doc_id int, text string")
    bench = spark.createDataFrame([(7, "q " + " ".join(f"w{i}" for i in range(5, 25)) + " z"), (8, LONG), (9, "w3 w4")], "item_id int, text string")
    got = sorted(tuple(r) for r in suffix_search.matches(docs, bench).collect())
    # LONG repeats itself every 700 words: each shift of it is a match as far as both texts go.
    shifts = [(2, "8", a, b, 3000 - max(a, b)) for k in range(5) for a, b in {(700 * k, 0), (0, 700 * k)}]
    assert got == sorted([(1, "7", 1, 6, 20), (1, "9", 0, 4, 2), (3, "9", 0, 3, 2), *shifts])


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(i, t, "w", "t", 1) for i, t in CASES], DOCS)
    assert suffix_search.report(docs, bench).count() == 0
    assert suffix_search.report(some, bench).where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0
    assert suffix_search.report(some, bench).count() == len(CASES)


def test_rank_one_updates():
    rng = np.random.default_rng(5)
    for _ in range(60):
        k = int(rng.integers(1, 40))
        full, d, q = np.zeros((k, k)), np.zeros(k), np.eye(k)
        for _ in range(int(rng.integers(1, 2 * k + 2))):
            v = rng.normal(size=k) * 10.0 ** rng.integers(-6, 6)
            v[rng.random(k) < 0.3] = 0
            full += np.outer(v, v)
            d, q = whitening.rank_one(d, q, v)
        assert np.all(np.diff(d) >= 0)
        assert np.abs(q @ np.diag(d) @ q.T - full).max() <= 1e-12 * max(np.abs(full).max(), 1e-300)
        assert np.abs(q.T @ q - np.eye(k)).max() < 1e-12


def numpy_whitened(vectors, k):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    away = (n * x - s) / n
    values, turn = np.linalg.eigh(away.T @ away / n)
    values, turn = values[::-1], turn[:, ::-1]
    return away @ turn[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), ((n * x - s) ** 2).sum(1)


def test_whitening_is_numpy(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").repartition(7)
    rows = sorted(whitening.whiten(vectors).collect(), key=lambda r: (r.vec_id, r.component))
    plain = sorted((r.vec_id, r.embedding) for r in vectors.collect())
    want, shares, deviations = numpy_whitened([v for _, v in plain], 8)
    got = np.array([r.whitened for r in rows]).reshape(-1, 8)
    got *= np.sign((got * want).sum(0))
    assert np.abs(got - want).max() < 1e-9
    assert np.allclose([r.explained for r in rows[:8]], shares, rtol=1e-9)
    assert [r.deviation for r in rows[::8]] == deviations.tolist() and rows[0].n == len(plain)
    assert rows[0].identity_error < 1e-9 and len({r.identity_error for r in rows}) == 1


def test_whitening_edges(spark):
    schema = "vec_id bigint, embedding array<double>, component string, n string"
    good = [[0.1, 2.0, 3.0], [1.0, -2.0, 0.5], [0.3, 0.7, 9.0], [5.0, 1.0, 1.0], [5.0, 1.0, 1.0]]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 1.0, 2.0], [1.0, 2.0], [1e30, 1.0, 1.0]]
    rows = [(i, v, "c", "n") for i, v in enumerate(good)] + [(100 + i, v, None, None) for i, v in enumerate(bad)] + [(None, good[0], "c", "n")]
    out = sorted(whitening.whiten(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (str(r.vec_id), r.component))
    assert collections.Counter(r.vec_id for r in out) == {**{i: 3 for i in range(5)}, None: 3}
    want, _, deviations = numpy_whitened([*good, good[0]], 3)
    got = np.array([r.whitened for r in out]).reshape(-1, 3)
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-9
    assert [r.deviation for r in out[::3]] == deviations.tolist()
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "c", "n")], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "c", "n")], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 2
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "c", "n"), (2, [3.0, 2.0], "c", "n")], schema)).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: (r.vec_id, r.component))] == [False, True] * 2
    huge = whitening.whiten(spark.createDataFrame([(1, [1e15], "c", "n"), (2, [-1e15], "c", "n")], schema)).collect()
    assert [r.deviation for r in huge] == [None, None] and {round(abs(r.whitened), 9) for r in huge} == {1.0}


def brute_variants(docs):
    counts = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").encode().lower().decode()):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    vocabulary = {w: n for w, n in counts.items() if n >= 5}
    near = collections.defaultdict(set)
    gaps = collections.defaultdict(set)
    for w in vocabulary:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1:]
            gaps[w[:i], w[i + 1:]].add(w)
            if shorter in vocabulary:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best and vocabulary[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (form[w], root(w), n, len(near[w]), vocabulary.get(form[w])) for w, n in vocabulary.items()}


@pytest.mark.parametrize("hot_chars", [spelling.HOT_CHARS, 40])
def test_spelling_is_brute_force(spark, hot_chars):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame(
        [(None, "kéttle Kéttle KÉTTLE kettle kettlé " * 30, "x"), (-1, "abcdef abcdeg abcdefg bcdefg aabcdef " * 5, "x"), (-2, None, "x"), (-3, "", "x"),
         (-4, ("y" * 700 + " " + "y" * 701 + " ") * 6, "x"), (-5, "×÷àáâã " * 9, "x"), (-5, "×÷àáâã " * 9, "x"), (-6, "漢字kanjii漢字 " * 9, "x"),
         (-7, "straße strasse strase " * 40 + "strassen " * 8 + "strassens " * 5, "x"), (-8, "z1zzzzzz_zzzzzzz " * 50, "x")],
        "doc_id bigint, text string, word string")
    docs = docs.select("doc_id", "text").withColumn("word", F.lit("x")).unionByName(extra)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, hot_chars=hot_chars).collect()}
    want = brute_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20


def test_spelling_pages_find_every_near_pair():
    rng = np.random.default_rng(11)
    for s in (6, 7, 20):
        base = "".join(rng.choice(list("ab"), s))
        words_ = {base}
        while len(words_) < 90:
            w = list(rng.choice(sorted(words_)))
            at = int(rng.integers(0, len(w)))
            if rng.random() < 0.5:
                w[at] = str(rng.choice(list("abc")))
            elif len(w) == s:
                w.insert(at, str(rng.choice(list("abc"))))
            words_.add("".join(w))
        page = sorted(words_)
        a, b = spelling.near_in_page(page, s)
        got = {(page[i], page[j]) for i, j in zip(a, b, strict=True)}

        def near(x, y):
            if len(x) == len(y):
                return sum(p != q for p, q in zip(x, y, strict=True)) == 1
            x, y = sorted((x, y), key=len)
            return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))
        # Pairs of the longer words belong to the page of their own length.
        assert got == {(x, y) for x in page for y in page if near(x, y) and min(len(x), len(y)) == s}


def test_spelling_of_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_queries_are_registered():
    assert {"op11_decontaminate", "op12_embedding_whitening", "op13_spelling_variants"} <= set(QUERIES)
