"""Toxicity by a subsequence string kernel machine with Nyström landmarks.

Sentences are read as windows of one word, of two neighbouring words of at most
``PIECE_CHARS`` characters each, and of three or more single characters set
apart by white space. Windows are compared with landmarks by the gap-weighted
subsequence kernel of order ``ORDER`` (every common subsequence counts ``DECAY``
to the power of the stretch it spans in both), normalised; white space inside a
window is a gap. Inserted characters and gaps lower the kernel gently, so
"idxiot", "id iot" and "id.i*ot" stay close to "idiot". A window that has less
than ``SHARED`` of a landmark as a common subsequence counts as unlike it
(kernel 0): a bit-parallel longest-common-subsequence test finds these exactly,
and the dynamic program runs for the others only.

Landmark words chosen from the labelled texts span a subspace; the Nyström map
puts a window into it, and a linear support vector machine over that map scores
it. A sentence scores as its most toxic window, a text as its most toxic
sentence. Labels belong to texts, so training takes words that occur nearly only in
toxic texts, and the witness of each toxic text by turns with fitting
(multiple-instance learning), against all windows of clean texts. Spellings of
the landmarks with one letter inserted or two swapped are virtual examples.

Fitting reads about ``MAX_PER_CLASS`` labelled texts of each class, taken by
hash, whatever their length (their distinct windows go to the driver);
everything is scored. Bounds of the fit: ``CANDIDATES`` words are looked at for
landmarks, and the ``HARD`` clean windows that score highest train each round.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, text_of

ORDER, DECAY = 3, 0.9
SHARED = 0.75                  # of a landmark's letters
MAX_PER_CLASS = 1500           # labelled texts of either class that the fit reads
LANDMARKS, PLAIN_LANDMARKS = 24, 12
CANDIDATES, HARD = 1500, 20_000
OFTEN, MOSTLY = 0.1, 10        # a word in this share of the toxic texts, this many times that of clean ones, is an example
VIRTUAL = 3                    # letters tried at each place of a landmark
PIECE_CHARS = 4                # neighbouring words of at most this length make a window
WINDOW = 24                    # letters; longer words are scored by overlapping windows
CACHE_WORDS = 600_000
BATCH_WORDS = 1 << 15          # words that meet the landmarks at a time
BATCH_TEXTS = 1000
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")      # letters set apart by spaces
NO_LETTERS = re.compile(r"[\W\d_]+")
DIGITS = str.maketrans("01345", "oieas")                   # digits that stand for letters
ROUNDS, RIDGE = 4, 2e-4


def letters(token: str) -> str:
    low = token.lower()
    if " " in low:
        return " ".join(map(letters, low.split(" ")))
    return low if low.isalpha() else NO_LETTERS.sub("", low.translate(DIGITS))


def tokens(text: str) -> set[str]:
    """Distinct windows of a text: words, short neighbours, and letters set apart by white space as one word."""
    words = text.split()
    found = set(words)
    short = [len(w) <= PIECE_CHARS for w in words]
    found.update([f"{words[i]} {words[i + 1]}" for i, (a, b) in enumerate(zip(short, short[1:])) if a and b])
    for m in SPACED.finditer(text):
        found.add("".join(m.group().split()))
    return found


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i:i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as a matrix of code points, padded with 0, and the lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    width = max(1, int(lengths.max(initial=0)))
    matrix = np.zeros((len(words), width), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    matrix[np.arange(width)[None, :] < lengths[:, None]] = flat
    return matrix, lengths


def _common(codes: np.ndarray, landmark: str) -> np.ndarray:
    """Length of the longest common subsequence of each word with the landmark (at most 24 letters)."""
    alphabet = np.unique(np.array([ord(c) for c in landmark], np.uint32))
    return _lcs(_places(codes, alphabet), alphabet, landmark)


def _places(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Each letter's place in the sorted alphabet, or its size; one row per position."""
    at = np.minimum(np.searchsorted(alphabet, codes.T), len(alphabet) - 1)
    return np.where(alphabet[at] == codes.T, at, len(alphabet)).astype(np.uint8 if len(alphabet) < 256 else np.int64)


def _lcs(places: np.ndarray, alphabet: np.ndarray, landmark: str) -> np.ndarray:
    full = np.uint32((1 << len(landmark)) - 1)
    masks = np.zeros(len(alphabet) + 1, np.uint32)
    for i, c in enumerate(landmark):
        masks[np.searchsorted(alphabet, ord(c))] |= np.uint32(1 << i)
    state = np.full(places.shape[1], full, np.uint32)
    for row in places:
        both = state & masks[row]
        state = ((state + both) | (state - both)) & full
    return len(landmark) - np.bitwise_count(state).astype(np.int64)


def needed(landmark: str) -> int:
    return max(ORDER, int(np.ceil(SHARED * len(landmark))))


def _kernel(codes: np.ndarray, other) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row with ``other``: a landmark, or None for the row itself."""
    n, width = codes.shape
    target = [codes[:, j] for j in range(width)] if other is None else [np.uint32(ord(c)) for c in other]
    size, decay = len(target), np.float32(DECAY)
    square = decay * decay
    prefix = np.zeros((ORDER, size + 1, n), np.float32)
    prefix[0] = 1
    total = np.zeros(n, np.float32)
    for c in range(width):
        letter = codes[:, c]
        equal = [((letter == t) & (letter != 0)).astype(np.float32) * square for t in target]
        for j in range(ORDER - 1, size):
            total += equal[j] * prefix[ORDER - 1, j]
        for i in range(ORDER - 1, 0, -1):
            run = np.zeros(n, np.float32)
            for j in range(i - 1, size):
                run *= decay
                run += equal[j] * prefix[i - 1, j]
                prefix[i, j + 1] *= decay
                prefix[i, j + 1] += run
    return total


def kernel_matrix(words: list[str], landmarks: list[str], self_kernels: np.ndarray) -> np.ndarray:
    """Normalised kernels of words with landmarks."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not words:
        return out
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    alphabet = np.unique(np.array([ord(c) for landmark in landmarks for c in landmark], np.uint32))
    for a in range(0, len(order), BATCH_WORDS):
        rows = order[a:a + BATCH_WORDS]
        codes, _ = _codes([words[i] for i in rows])
        some = np.zeros(len(rows), bool)
        near = []
        places = _places(codes, alphabet)
        for landmark in landmarks:
            hit = np.flatnonzero(_lcs(places, alphabet, landmark) >= needed(landmark))
            near.append(hit)
            some[hit] = True
        own = np.ones(len(rows), np.float32)
        if some.any():
            own[some] = _kernel(codes[some], None)
        for j, hit in enumerate(near):
            if hit.size:
                out[rows[hit], j] = _kernel(codes[hit], landmarks[j]) / np.sqrt(own[hit] * self_kernels[j])
    return out


def self_kernels(words: list[str]) -> np.ndarray:
    codes, _ = _codes(words)
    return _kernel(codes, None)


@dataclass
class Model:
    landmarks: list[str]
    own: np.ndarray            # the landmarks' kernels with themselves
    weights: np.ndarray        # of the kernels with the landmarks: Nyström map and linear machine in one
    bias: float
    curve: np.ndarray          # of the probability

    def decisions(self, raw: list[str]) -> list[float]:
        """Decision value of every raw token."""
        spelt = list(map(letters, raw))
        names = list(set(spelt))
        long = [(w, i) for i, name in enumerate(names) if len(name) > WINDOW for w in windows(name)]
        short = [i for i, name in enumerate(names) if ORDER <= len(name) <= WINDOW]
        value = np.full(len(names), self.bias, np.float32)
        parts = [names[i] for i in short] + [w for w, _ in long]
        if parts:
            np.maximum.at(value, short + [i for _, i in long],
                          kernel_matrix(parts, self.landmarks, self.own) @ self.weights + self.bias)
        of = dict(zip(names, value.tolist(), strict=True))
        return list(map(of.__getitem__, spelt))

    def probability(self, decision):
        return 1 / (1 + np.exp(-np.clip(_sides(decision) @ self.curve, -30, 30)))


def _linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """L2-regularised squared hinge, by accelerated gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    step = 1 / (2 * np.linalg.eigvalsh((x1 * weight[:, None]).T @ x1)[-1] + 1e-3)
    w = v = np.zeros(x1.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        grad = -2 * ((weight * y * slack) @ x1) + RIDGE * np.append(v[:-1], 0)
        new = v - step * grad
        w, v = new, new + t / (t + 3) * (new - w)
    return w[:-1], float(w[-1])


def _sides(decision) -> np.ndarray:
    """Decisions below and above the boundary apart, and a constant."""
    d = np.asarray(decision, float)
    return np.stack([np.minimum(d, 0), np.maximum(d, 0), np.ones_like(d)], -1)


def _calibrate(decision: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic curve over decisions, with a slope of its own on either side of the boundary.

    Toxic texts without a known word lie among the clean ones; with one slope they would pull the middle upwards.
    """
    x, w = _sides(decision), np.array([1.0, 1.0, 0.0])
    t = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y <= 0) + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-2 * np.eye(3), (p - t) @ x + 1e-2 * w)
        w = w - np.clip(step, -1, 1)
        w[:2] = np.maximum(w[:2], 0.05)
    return w


def bag(text: str) -> list[str]:
    return sorted({w for t in tokens(text) for w in windows(letters(t)) if len(w) >= ORDER})


def misspelt(word: str) -> list[str]:
    """The word with one letter inserted (``VIRTUAL`` letters at each place, by checksum) or two neighbours swapped."""
    inserted = {word[:i] + "abcdefghijklmnopqrstuvwxyz"[zlib.crc32(f"{word}:{i}:{r}".encode()) % 26] + word[i:]
                for i in range(1, len(word)) for r in range(VIRTUAL)}
    spaced = {word[:i] + " " + word[i:] for i in range(1, len(word))}
    swapped = {word[:i] + word[i + 1] + word[i] + word[i + 2:] for i in range(len(word) - 1)}
    return sorted((inserted | spaced | swapped) - {word})


def _landmarks(count: dict[str, list[int]], odds: dict[str, float]) -> tuple[list[str], int]:
    """Toxic words by evidence, then the clean windows most like them; and how many are toxic."""
    chosen: list[str] = []
    by_evidence = sorted((w for w in count if odds[w] > 0 and " " not in w), key=lambda w: (-count[w][1] * odds[w], w))
    for w in by_evidence[:CANDIDATES]:
        if len(chosen) < LANDMARKS and (not chosen or kernel_matrix([w], chosen, self_kernels(chosen)).max() < 0.7):
            chosen.append(w)
    toxic = len(chosen)
    if chosen:
        clean = sorted(w for w, (c, t) in count.items() if c > t and " " not in w)
        like = kernel_matrix(clean, chosen, self_kernels(chosen))
        for j in range(toxic):             # each in turn is told from the clean word most like it
            near = int(like[:, j].argmax()) if clean else 0
            if len(chosen) < toxic + PLAIN_LANDMARKS and clean and like[near, j] > 0:
                if kernel_matrix([clean[near]], chosen, self_kernels(chosen)).max() < 0.9:
                    chosen.append(clean[near])
    return chosen, toxic


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """A model from labelled texts; None if either class is missing."""
    return fit_bags([bag(x) for x in texts], toxic)


def fit_bags(bags: list[list[str]], toxic: list[int]) -> Model | None:
    y = np.array([1 if t else -1 for t in toxic])
    if not (y > 0).any() or not (y < 0).any():
        return None
    count: dict[str, list[int]] = {}
    for words, label in zip(bags, y, strict=True):
        for w in words:
            count.setdefault(w, [0, 0])[int(label > 0)] += 1
    n_toxic, n_clean = int((y > 0).sum()), int((y < 0).sum())
    odds = {w: np.log((t + .5) / (n_toxic + 1)) - np.log((c + .5) / (n_clean + 1)) for w, (c, t) in count.items()}
    chosen, n_known = _landmarks(count, odds)
    if not chosen:
        return None
    own = self_kernels(chosen)
    values, vectors = np.linalg.eigh(kernel_matrix(chosen, chosen, own).astype(float))
    keep = values > 1e-4
    nystroem = vectors[:, keep] / np.sqrt(values[keep])
    vocabulary = sorted(count)
    place = {w: i for i, w in enumerate(vocabulary)}
    mapped = kernel_matrix(vocabulary, chosen, own) @ nystroem
    sure = [w for w in vocabulary if count[w][1] >= OFTEN * n_toxic and odds[w] > np.log(MOSTLY)]
    known = set(sure)
    virtual = [(v, count[w][1]) for w in chosen[:n_known] if w in known for v in misspelt(w) if v not in count]
    extra = np.array([place[w] for w in sure], np.int64)
    spelt = kernel_matrix([v for v, _ in virtual], chosen, own) @ nystroem
    spelt_weight = np.array([t for _, t in virtual], float)
    positive = [np.array([place[w] for w in words]) for words, label in zip(bags, y, strict=True) if label > 0 and words]
    clean = np.array(sorted(place[w] for w, (c, t) in count.items() if c and w not in known), np.int64)
    innocent = [np.array([place[w] for w in words]) for words, label in zip(bags, y, strict=True) if label < 0 and words]
    clean_weight = np.array([count[vocabulary[i]][0] for i in clean], float)
    value = np.array([odds[w] * np.log1p(count[w][1]) for w in vocabulary])
    for _ in range(ROUNDS):
        witness = np.concatenate([extra, np.array([words[np.argmax(value[words])] for words in positive], np.int64)])
        hard = np.argsort(-value[clean], kind="stable")[:HARD]
        worst = np.array([words[np.argmax(value[words])] for words in innocent], np.int64)
        x = np.vstack([mapped[witness], spelt, mapped[clean[hard]], mapped[worst]])
        label = np.concatenate([np.ones(len(witness) + len(spelt)), -np.ones(len(hard) + len(worst))])
        # A witness counts by the toxic texts that share it, so that texts without a known one do not blur the rest.
        support = np.array([count[vocabulary[i]][1] for i in witness], float)
        weight = np.concatenate([support / support.sum() / 2, 2 * spelt_weight / max(1.0, spelt_weight.sum()),
                                 clean_weight[hard] / max(1.0, clean_weight[hard].sum()),
                                 np.ones(len(worst)) / max(1, len(worst))])
        w, bias = _linear_svm(x, label, weight)
        value = mapped @ w + bias
    best = np.array([max([value[place[w]] for w in words], default=bias) for words in bags])
    return Model(chosen, own, (nystroem @ w).astype(np.float32), bias, _calibrate(best, y))


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Rows whose crc32 of the id as text is 0 modulo ``folds``: their labels are never learnt."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
          max_per_class: int = MAX_PER_CLASS) -> Model | None:
    """Fits on about ``max_per_class`` labelled texts of each class (at most twice as many), chosen by hash of the id."""
    marks = (labels.where(~held_out(F.col(id_column)) & F.col(label).isNotNull())
             .groupBy(F.col(id_column).alias("__id")).agg(F.max(label).alias("__toxic")))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            bags = pa.array([bag(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), bags], names=["__id", "bag"])

    rows = []
    for value in (0, 1):
        ids = hash_sample(marks.where(F.col("__toxic") == value), F.col("__id"), max_per_class)
        found = (docs.join(F.broadcast(ids), F.col(id_column) == F.col("__id"))
                 .select("__id", text_of(text).alias("__text")).dropDuplicates(["__id"]))
        rows += [(r["__id"], r["bag"], value) for r in found.mapInArrow(run, f"__id {kind}, bag array<string>").collect()]
    rows.sort(key=lambda r: r[0])
    return fit_bags([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column``, held_out, score, predicted for every document.

    Null and empty texts score as a text without a toxic word. Without a model
    (no labelled texts of both classes) every score is 0. Other columns are
    not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            owners, texts = batch.column(0), batch.column(2).to_pylist()
            best = np.zeros(len(texts))
            if model is not None:
                for a in range(0, len(texts), BATCH_TEXTS):
                    bags = [tokens(x) for x in texts[a:a + BATCH_TEXTS]]
                    new = list(set().union(*bags) - cache.keys())
                    cache.update(zip(new, model.decisions(new), strict=True))
                    best[a:a + BATCH_TEXTS] = [max(map(cache.__getitem__, bag), default=model.bias) for bag in bags]
                    if len(cache) > CACHE_WORDS:
                        cache = {w: cache[w] for w in set().union(*bags)}
                best = model.probability(best)
            yield pa.RecordBatch.from_arrays(
                [owners, batch.column(1), pa.array(best, pa.float64()), pa.array((best >= 0.5).astype(np.int32))],
                names=[id_column, "held_out", "score", "predicted"])

    return (docs.select(id_column, held_out(F.col(id_column)).alias("held_out"), text_of(text).alias("__text"))
            .mapInArrow(run, f"`{id_column}` {kind}, held_out boolean, score double, predicted int"))
