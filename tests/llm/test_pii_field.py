"""The personal-data field: rules against plain regular expressions, mentions, marginals, spans that it adds."""

import itertools
import re
import time

import numpy as np
import pytest

from meterbook.llm import pii_crf as P

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text or "" for r in spark.read.parquet(DOCS).collect()]


def plain(text):
    """The contract's rules, one regular expression each."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        doubled = sum(sum(divmod(2 * v, 10)) if i % 2 else v for i, v in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and doubled % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


HARD = ["1.2.3.4.5.6.7.8 300.1.1.1 1.2.3.256 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (415) 555-0132.", "+49 30 1234567 +1 2", "a@b.c a@@b.c a.b@c..d x@y-z.q.w", "", "+", "@", "4111111111111111 10.0.0.1"]


def test_rules_equal_plain_expressions(texts):
    for t in texts + HARD:
        assert P.base_spans(t) == plain(t)


def test_long_lists_of_addresses_take_linear_time():
    def seconds(n):
        t = " ".join(f"user{i:06d}@mail.example.com and user{i:06d}." for i in range(n))
        base = P.base_spans(t)
        start = time.perf_counter()
        assert len(P.mentions(t, base)) == 2 * n
        return time.perf_counter() - start
    seconds(100)
    assert seconds(16_000) < 20 * max(seconds(2_000), 0.002)


def test_number_groups_are_cut_where_one_number_must_end():
    t = "x +1 (269) 555-3296 4524132264652876 y"
    assert [t[s:e] for s, e in P.pieces(t, 2, len(t) - 2)] == ["+1 (269) 555-3296", "4524132264652876"]
    t = "10.0.0.1 4111111111111111"
    base = P.base_spans(t)
    assert [(k, t[s:e]) for k, s, e in base] == [(1, "10.0.0.1")]
    assert P.mentions(t, base) == [(0, 8, 1), (9, 25, P.CUT)]


@pytest.mark.parametrize("seed", range(5))
def test_marginals_equal_enumeration_on_trees(seed):
    rng = np.random.default_rng(seed)
    field = P.Field(rng.normal(size=(P.N_LABELS, P.N_FEATURES)), (a := rng.normal(size=(P.N_LABELS,) * 2)) + a.T,
                    np.abs(rng.normal(size=3)))
    x = rng.integers(0, 2, (4, P.N_FEATURES)).astype(float)
    edges, kinds = np.array([[0, 1], [1, 2], [1, 3]]), np.array([0, 1, 3])
    clamped = np.array([P.NONE, P.NONE, 2, P.NONE])
    local, pair = x @ field.unary.T, field.pair(kinds)
    want = np.zeros((4, P.N_LABELS))
    for labels in itertools.product(range(P.N_LABELS), repeat=4):
        if labels[2] == 2:
            weight = np.exp(sum(local[i, k] for i, k in enumerate(labels))
                            + sum(pair[e, labels[i], labels[j]] for e, (i, j) in enumerate(edges)))
            for i, k in enumerate(labels):
                want[i, k] += weight
    want /= want.sum(1, keepdims=True)
    assert np.abs(field.marginals(x, edges, kinds, clamped) - want).max() < 0.02


def test_the_field_adds_what_the_rules_lose(texts):
    field = P.fit(texts)
    for text, lost in [("call +1 (269) 555-3296 4524132264652876 now", ["+1 (269) 555-3296", "4524132264652876"]),
                       ("from 27.65.93.188 4451718024887799 on", ["4451718024887799"]),
                       ("+1 (843) 555-7672 170.106.47.218", ["+1 (843) 555-7672"])]:
        base, every = P.find(text, field)
        assert set(base) <= set(every)
        assert [text[s:e] for s, e in sorted((s, e) for _, s, e in set(every) - set(base))] == lost
    for clean in ("order 12345678 and 9807915762804490 only", 'token = "63169548663bbc1ce380e67a23c5d852ac69"',
                  "password=135299847ac0e0f0dc", "part 9566113270 of it"):
        assert P.find(clean, field) == ([], [])


def test_training_through_tasks_equals_the_local_fit(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:300] + texts[:20] + [None, "", "1" * 90_000])],
                                 "doc_id bigint, text string")
    distinct = sorted({t for t in texts[:300] + ["1" * 90_000] if re.search("[0-9]{3}|@", t)})
    got, want = P.train(docs), P.fit(distinct)
    assert np.allclose(got.unary, want.unary) and np.allclose(got.chain, want.chain) and np.allclose(got.skip, want.skip)
