"""The training-data operators against brute force, round trips and edge rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterbook.llm import (bloom_cascade, chat_format, exact_dedup, graph, merge_dropout, pii_crf, quality_cascade,
                           source_mix, suffix_family, token_groups, toxicity)
from meterbook.llm.queries import QUERIES
from tools.oracle_check import digest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int"
BASE = " ".join(f"word{i}" for i in range(120))
ROWS = [(1, BASE, "en", "a", 1, 1), (2, BASE, "en", "a", 1, 1), (3, BASE + " tail", "en", "b", 1, 1), (4, None, None, None, 0, 0),
        (5, "", "en", "b", 0, 0), (6, "one two", "en", None, 7, 0), (7, "one two", "en", None, 7, 0), (7, "one two", "en", None, 7, 0),
        (None, BASE, "en", "a", 1, 1), (9, "é漢🙂 " * 2000, "en", "c", 1, 1), (10, "x" * 50_000, "en", "c", 1, 1),
        (11, " \n\t ", "en", "c", 1, 1)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.oracle])
def test_oracle(spark, duck, name):
    df = QUERIES[name].build(spark, SMALL)
    cur = duck.execute(QUERIES[name].oracle)
    want = digest([d[0] for d in cur.description], cur.fetchall())[0]
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == want


def test_cascade_parts_are_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("host"), "id").alias("key"))
    listed = keys.where("hash(key) % 3 = 0")
    cascade = bloom_cascade.Cascade.build(keys, listed, max_bits=2048)
    assert len(cascade.parts) > 1
    got = {r[0] for r in keys.where(cascade.listed(F.col("key"))).collect()}
    assert got == {r[0] for r in listed.collect()}
    nothing = bloom_cascade.Cascade.build(keys.limit(0), listed)
    assert keys.where(nothing.listed(F.col("key"))).count() == 0


def test_cascade_levels_stay_within_max_bits(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("host"), "id").alias("key"))
    listed = keys.where("cast(substr(key, 5) as int) % 1000 = 0")
    cascade = bloom_cascade.Cascade.build(keys, listed, max_bits=2048)
    assert max(level.size for part in cascade.parts for level in part) <= 2048
    assert {r[0] for r in keys.where(cascade.listed(F.col("key"))).collect()} == {r[0] for r in listed.collect()}


def test_dedup_edges(edge, empty):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.refine(edge).collect()}
    assert {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (4, 5, 2, False), (5, 5, 2, True), (6, 7, 3, False),
            (7, 7, 3, True)} <= got
    assert exact_dedup.refine(edge).count() == len(ROWS) and exact_dedup.refine(empty).count() == 0
    kept = exact_dedup.dedup(edge)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 7, 9, 10, 11] and kept.columns == edge.columns


def test_dedup_id_with_several_texts(spark):
    rows = [(5, "A"), (9, "A"), (5, "B"), (5, "C"), (3, "C"), (None, "A"), (None, "D")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, exact_dedup.dedup(df).collect()), key=str) == sorted(
        [(9, "A"), (5, "B"), (5, "C"), (None, "D")], key=str)


def test_quality_edges(edge, empty):
    got = {r.doc_id: r for r in quality_cascade.judge(edge).collect()}
    assert got[4].n_words == 0 and got[4].base_failed and not got[4].kept and got[1].kept
    assert got[9].n_repeat_words == 2000 and got[10].n_words == 1
    assert quality_cascade.judge(empty).count() == 0 and quality_cascade.keep_good(empty).count() == 0


def test_mix_targets_and_pieces(spark, edge, empty, small):
    targets = source_mix.source_targets([("a", 10), ("b", 1000), (None, 100), ("c", 0)])
    assert [t["target"] for t in targets][0] == 30 and abs(sum(t["target"] for t in targets) - 1110) < 1e-6
    assert all(t["target"] <= 3 * t["source_size"] + 1e-9 for t in targets)
    for n in (1, 2, 7, 100, 1023):
        a, c = source_mix.affine(n, 1, "s", 0)
        assert sorted((a * x + c) % n for x in range(n)) == list(range(n))
    rows = source_mix.mix_report(small).collect()
    assert len(rows) == small.count() and all(r.taken <= 3 * r.size for r in rows)
    taken, target = collections.Counter(), {}
    of = {r.doc_id: r.source for r in small.collect()}
    for r in rows:
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= max(32, 0.02 * t) for s, t in target.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, source_mix.mix_report(small.repartition(5)).collect()))
    assert source_mix.mix_report(edge).count() == len(ROWS) and source_mix.mix_report(empty).count() == 0
    assert source_mix.mix(empty).count() == 0
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    mixed = source_mix.mix(small)
    by_doc = collections.Counter()
    for r in mixed.collect():
        by_doc[r.doc_id] += words(r.text)
    assert mixed.columns == small.columns and by_doc == {r.doc_id: r.taken for r in rows if r.taken}


def brute_components(rows):
    sets, where = {}, collections.defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, s in sets.items():
        for j, n in collections.Counter(j for g in s for j in where[g]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for g in s:
            where[g].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_token_groups(spark, edge, empty, small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert {r[0]: (r[1], r[2]) for r in token_groups.join(small).collect()} == brute_components(rows)
    # A text with many near copies that do not link with each other, and more nodes than a part holds.
    words = [f"w{i}" for i in range(100)]
    copies = [(1000 + k, " ".join(f"z{k}" if i == k % 90 or i == (k * 7 + 3) % 90 else w for i, w in enumerate(words)))
              for k in range(300)] + [(999, " ".join(words))]
    df = spark.createDataFrame(copies, "doc_id bigint, text string")
    assert {r[0]: (r[1], r[2]) for r in token_groups.join(df).collect()} == brute_components(copies)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in token_groups.join(edge).collect()}
    assert {(1, 116, 1), (2, 116, 1), (3, 117, 1), (4, 0, 4), (6, 1, 6), (7, 1, 6), (11, 0, 11)} <= got
    assert token_groups.join(empty).count() == 0
    assert 2 not in {r.doc_id for r in token_groups.one_of_each(edge).collect()}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "u bigint, v bigint")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90


def brute_removal(rows, n=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k:k + n] for _, b in data for k in range(len(b) - n + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k:k + n]] > 1:
                gone[k:k + n] = b"\1" * n
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_family(spark, edge, empty, small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert sorted(map(tuple, suffix_family.remove(small).collect()), key=str) == brute_removal(rows)
    some = [(r[0], (r[1] or "")[:6000] if r[1] is not None else None) for r in ROWS]
    df = spark.createDataFrame(some, "doc_id bigint, text string")
    assert sorted(map(tuple, suffix_family.remove(df, batches=3).collect()), key=str) == brute_removal(some)
    assert suffix_family.remove(empty).count() == 0


def test_suffix_family_hot_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(suffix_family, "HOT_CLASSES", 3)
    shared = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, f"{'a%d ' % i * (50 + i)}{shared}{' b%d' % i * 60}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, suffix_family.remove(df).collect()), key=str) == brute_removal(rows)


def test_merge_dropout(edge, empty, small):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.MODEL)
    texts = [r.text for r in small.collect()]
    plain = merge_dropout.Codec(merge_dropout.load_vocabulary(), 0.0, 1, 1)
    for text, ids in zip(texts, plain.encode_texts(range(len(texts)), texts, plain.caches), strict=True):
        assert list(ids) == model.encode(text)
    for df in (edge, small):
        back = {}
        for r in merge_dropout.encode(df).collect():
            back.setdefault(r.doc_id, set()).add((r.text_sha256, tuple(r.ids)))
        for r in df.collect():
            sha = hashlib.sha256((r.text or "").encode()).hexdigest()
            assert sha in {x for x, _ in back[r.doc_id]}
    assert merge_dropout.encode(empty).count() == 0
    first = merge_dropout.encode(small).collect()
    assert sorted(map(str, first)) == sorted(map(str, merge_dropout.encode(small.repartition(3)).collect()))
    tokens = merge_dropout.encode(small)
    texts_back = {r.doc_id: r.text for r in merge_dropout.decode(tokens).collect()}
    assert texts_back == {r.doc_id: r.text for r in small.collect()}


def test_merge_dropout_agendas_agree():
    codec = merge_dropout.Codec(merge_dropout.load_vocabulary())
    rows = set()
    with np.errstate(over="ignore"):
        for chunk in (" international", " été", "▁漢", " aaaaaaaaaaaa", "\n", " the"):
            for v in range(4):
                one = codec.encode_long(chunk, codec.key(chunk, v)).tobytes()
                assert one == codec.encode_many([chunk, " x"], [v, 0])[0]
                rows.add((chunk, one))
    assert len(rows) > 8       # segmentations vary


def test_merge_dropout_draws_per_occurrence():
    codec = merge_dropout.Codec(merge_dropout.load_vocabulary())
    split = lambda ids: [x.tolist() for x in np.split(ids, np.flatnonzero(starts[ids]))[1:]]
    starts = np.array([p.startswith("▁") for p, _, _ in merge_dropout.load_vocabulary()])
    seen = collections.Counter(map(tuple, split(codec.encode_texts([1], [" ".join(["international"] * 5000)], codec.caches)[0])))
    assert sum(seen.values()) == 5000 and len(seen) > 20
    one, two = codec.encode_texts([1, 2], [" ".join("a" * 20_000)] * 2, codec.caches)
    assert one.tolist() != two.tolist()
    assert all(0.09 < len(x) / 20_000 - 1 < 0.11 for x in (one, two))     # one candidate, skipped in a tenth
    words = ["international", "the", "x" * 60, "été", "漢字", "understanding"] * 200
    base = int.from_bytes(hashlib.blake2b(repr(7).encode(), digest_size=8).digest(), "big")
    want = []
    with np.errstate(over="ignore"):
        for i, w in enumerate(words):
            place = merge_dropout._mix_int(base + i * 0x9FB21C651E98DF25)
            want += codec.encode_long(" " + w, codec.key(" " + w, place)).tolist()
    assert codec.encode_texts([7], [" ".join(words)], codec.caches)[0].tolist() == want


def test_pii(spark, edge, empty, small):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = np.random.default_rng(5)
    for _ in range(3000):
        t = "".join(rng.choice(list("a.@_%1-é b+9"), 25))
        assert [(s, e) for k, s, e in pii_crf.base_spans(t) if k == 0] == [m.span() for m in email.finditer(t)]
    assert pii_crf.base_spans("1.2.3.4.5.6.7.8 300.1.1.1") == [(1, 0, 7), (1, 8, 15)]
    field = pii_crf.fit([r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()])
    base, every = pii_crf.find("call +1 (415) 555-0132, later 415-555-0132", field)
    assert len(base) == 1 and len(every) == 2 and {k for k, _, _ in every} == {3}
    assert pii_crf.find("order 12345678 only", field) == ([], [])
    got = {r.doc_id: r for r in pii_crf.detect(edge, field).collect()}
    assert got[4].base_sha256 == hashlib.sha256(b"").hexdigest() and got[4].spans == ""
    assert pii_crf.detect(empty, pii_crf.train(empty)).count() == 0


def test_pii_without_a_span_of_the_rules(spark):
    field = pii_crf.fit([r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()])
    base, every = pii_crf.find("phone (415) 555-0132 or 415-555-0132", field)
    assert base == [] and [k for k, _, _ in every] == [3, 3]


def test_pii_fit_counts_copies_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(pii_crf, "fit", read.extend)
    rows = [(i, f"call 555-{i:04d}") for i in range(400)] + [(1000 + i, "call 415-555-0132") for i in range(200)]
    for about in (1000, 100, 20):
        read.clear()
        pii_crf.train(spark.createDataFrame(rows, "doc_id bigint, text string"), max_texts=about)
        assert len(read) == len(set(read)) <= 2 * about and (about < 1000 or len(read) == 401)


def test_toxicity(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    known = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "text", "toxic")
    rows = toxicity.score(known, model).join(known.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out for r in rows) and zlib.crc32(str(rows[0].doc_id).encode()) % 5 == 0
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93
    low, gapped, spaced = model.decisions(["the", "i.d*i*o-t", "".join("i d i o t".split())])
    assert min(gapped, spaced) > low
    assert all(0 <= r.score <= 1 for r in toxicity.score(edge, model).collect())
    assert toxicity.score(empty, None).count() == 0


def test_chat_layouts_and_escapes(spark, empty):
    import json
    nasty = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| \\n"
    rows = [{"conv_id": 1, "messages": [{"role": "user", "content": nasty}, {"role": "assistant", "content": None}]},
            {"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": nasty}]},
            {"id": 3, "instruction": "do", "input": None, "output": "done"}, {"id": 4, "prompt": "p", "completion": "c"},
            {"id": 5, "data": {"messages": [{"author": {"role": "a\\n\nb"}, "content": "x"}]}}, {"other": 1}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("no json",), (None,)], "record string")
    turns = chat_format.canonical_turns(df)
    assert turns.where("layout IS NULL").count() == 3
    known = turns.where("layout IS NOT NULL")
    back = chat_format.read_back(chat_format.format_turns(known))
    key = lambda r: (r.conv_id, r.turn)
    want = [(r.conv_id, r.turn, r.role, r.text) for r in sorted(known.collect(), key=key)]
    assert [(r.conv_id, r.turn, r.role, r.text) for r in sorted(back.collect(), key=key)] == want
    assert (2, 1, "assistant", nasty) in want and (3, 1, "assistant", "done") in want
    segment = chat_format.format_turns(known.where("conv_id = 1 and turn = 0")).first().segment
    assert segment.count("<|im_start|>") == 1 and segment.count("<|im_end|>") == 1
    assert chat_format.conversation_digests(known.limit(0)).count() == 0


def test_chat_long_turn(spark, tmp_path):
    n = 21_000_000
    one = spark.range(1).select(F.lit(5).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"),
                                F.lit("assistant").alias("role"), F.expr(f"repeat('x', {n})").alias("text"))
    none = one.withColumn("conv_id", F.lit(None).cast("bigint")).withColumn("text", F.lit(None).cast("string"))
    one.unionByName(none).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op7_chat_format"].build(spark, str(tmp_path)).collect()}
    assert set(got) == {5, None, -1} and got[5].loss_chars == n and got[None].loss_chars == 0
    assert got[5].turns_sha256 == hashlib.sha256(b"assistant\n" + b"x" * n + b"\n").hexdigest()
    with pytest.raises(Exception, match="no layout"):
        chat_format.table_turns(one.withColumn("more", F.lit(1))).collect()


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], SMALL).cache())
        assert steps[-1].columns == docs.columns, name
    good, unlike, apart = ({r.doc_id for r in s.select("doc_id").collect()} for s in steps[1:4])
    rejected = {r.doc_id for r in quality_cascade.judge(docs).collect() if not r.kept}
    assert good == {r.doc_id for r in docs.collect()} - rejected
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert unlike == set({texts[i]: i for i in sorted(good)}.values())
    assert apart == {root for _, root in brute_components([(i, texts[i]) for i in sorted(unlike)]).values()}
    final = corpus_pipeline.run(spark, SMALL)
    assert final.count() == steps[4].count()
