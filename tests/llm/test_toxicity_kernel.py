"""The string-kernel machine: kernel against enumeration, misspelt insults, labels that are missing."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterbook.llm import toxicity as T

SF = "/root/testdata/sf0.1"
WORDS = ["idiot", "idxiot", "tr ash", "trash", "banana", "aaaa", "abc", "ab", "", "réeux", "thateranshsh"]


def plain_kernel(a, b):
    """Sum over common subsequences of ORDER letters of DECAY to the stretches that they span in both."""
    def features(w):
        out = {}
        for places in itertools.combinations(range(len(w)), T.ORDER):
            u = "".join(w[i] for i in places)
            out[u] = out.get(u, 0) + T.DECAY ** (places[-1] - places[0] + 1)
        return out
    fa, fb = features(a), features(b)
    return sum(v * fb.get(u, 0) for u, v in fa.items())


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        old = 0
        for j, d in enumerate(b):
            old, row[j + 1] = row[j + 1], old + 1 if c == d else max(row[j + 1], row[j])
    return row[-1]


def test_kernel_equals_enumeration():
    landmarks = ["idiot", "trash", "aaab", "réeu"]
    own = T.self_kernels(landmarks)
    got = T.kernel_matrix(WORDS, landmarks, own)
    for i, w in enumerate(WORDS):
        for j, m in enumerate(landmarks):
            want = 0.0
            if plain_lcs(w, m) >= max(T.ORDER, math.ceil(T.SHARED * len(m))):
                want = plain_kernel(w, m) / math.sqrt(plain_kernel(w, w) * plain_kernel(m, m))
            assert got[i, j] == pytest.approx(want, abs=1e-4), (w, m)


def test_common_subsequence_equals_plain():
    codes, _ = T._codes(WORDS)
    for m in ("idiot", "aab", "thrash", "x"):
        assert T._common(codes, m).tolist() == [plain_lcs(w, m) for w in WORDS]


@pytest.fixture(scope="module")
def model(spark):
    return T.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_misspelt_insults_stay_toxic(spark, model):
    """Landmarks that a tenth of the toxic texts hold: plain, one letter in between, split, set apart, in a sentence."""
    insults = ["idiot", "moron", "stupid", "clown", "scum", "trash", "pathetic", "loser", "disgusting", "worthless"]
    assert set(insults) <= set(model.landmarks)

    def probability(words):
        return model.probability(np.array(model.decisions(words)))

    for w in insults:
        assert probability([w, w.upper() + "!"]).min() >= 0.5
        inserted = [w[:i] + c + w[i:] for i in range(1, len(w)) for c in "xaeqz*"]
        assert probability(inserted).min() >= 0.5, w
    texts = ["you tr ash", "an id iot here", "s  c  u  m", "m.o.r.o.n", "such a clo wn", "the shop is open",
             "we read from a book", "ash tray", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.predicted for r in T.score(docs, model).collect()}
    assert [got[i] for i in range(len(texts))] == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0]


def test_held_out_quality(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    known = docs.join(labels, "doc_id").where(T.held_out(F.col("doc_id"))).select("doc_id", "text", "toxic")
    rows = T.score(known, model).join(known.select("doc_id", "toxic"), "doc_id").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    order = np.concatenate([s[y == 1], s[y == 0]])
    wins = (s[y == 1][:, None] > s[y == 0][None]).mean() + (s[y == 1][:, None] == s[y == 0][None]).mean() / 2
    assert len(order) == len(rows) and wins > 0.88
    assert (s[y == 1] >= 0.5).mean() > 0.7 and (s[y == 0] >= 0.5).mean() < 0.02


@pytest.mark.parametrize("toxic", [[], [0, 0], [1, 1], [None, None]])
def test_missing_labels_give_no_model(spark, toxic):
    docs = spark.createDataFrame([(0, "some text"), (1, "idiot"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id bigint, toxic int")
    model = T.train(docs, labels)
    assert model is None and {r.score for r in T.score(docs, model).collect()} == {0.0}


def test_long_texts_take_part_in_the_fit(spark):
    long = "plain word and " * 20_000 + "zzinsult"
    rows = [(i, "zzinsult here" if i % 2 else f"quiet line {i}") for i in range(40)] + [(101, long)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = T.train(docs, labels)
    got = {r.doc_id: r.predicted for r in T.score(docs, model).collect()}
    assert got[101] == 1 and all(got[i] == i % 2 for i in range(40))
