"""Personal data by rules and a skip-chain conditional random field.

The rules find plain e-mail addresses, IP addresses, card and phone numbers.
The field looks at every mention that could be one: the rules' spans, number
groups of seven digits or more, and words equal to the name part of an address
in the text. The rules take neighbours of different kinds as one number and
drop it ("10.0.0.1 4111111111111111" has no card by them); what is left of such
a group beside the rules' spans is cut into groups that can each be a number. A chain joins neighbouring mentions; skip edges join a mention to
the previous one that repeats or resembles it (the same digits, the same last
seven digits, the same name), however far away. Each edge kind has its own
potential. Loopy message passing with damping gives every mention a
distribution over {none, email, ip, card, phone}, with the rules' spans
clamped, so that a number that is a phone number in one place is one in the
others too. Mentions that are likely a kind add a span, if their form allows it (a card
passes Luhn, an address has four parts); the rules' spans stay. Digits inside a
word, as in a hexadecimal key, are no mention.

The weights are fitted by pseudo-likelihood on the rules' labels in a sample
of about ``FIT_TEXTS`` texts, whatever their length; tasks turn them into
features, so no text goes to the driver. Cut groups have no label by the rules
and take no part in the fit. Surface cues are masked in half of the sample,
so that the edges have to carry their part. A Gaussian prior pulls the
resemblance weights to ``SKIP_PRIOR``.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, text_of

KINDS = ("email", "ip", "card", "phone")            # fixed values, in the contract's order
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"[+(]{0,2}[0-9]++(?:[ ().-]{1,2}[0-9]++)*")
BLANKLESS = re.compile(r"[^ ]+")
RUN = re.compile(r"[\w.@%+-]+")
HINT = re.compile(r"[0-9@]")

FIT_TEXTS = 1500
MIN_DIGITS = 7
MAX_DIGITS = 19              # no kind has more
ROUNDS, DAMPING = 12, 0.5
SURE = 0.6                   # probability from which a mention adds a span
SKIP_PRIOR = (4.0, 3.0, 3.0)  # same digits, same last digits, same name
NONE = len(KINDS)            # label number of "none"
N_LABELS = NONE + 1
CUT = N_LABELS               # a mention that the rules gave no label
N_FEATURES = 13              # the last one marks masked cues


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the rules, by kind and start; each kind is matched leftmost, without overlaps or retries."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            free = m.end()
        else:
            free = max(free, start)
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = only_digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(only_digits(m.group())) <= 15:
            found.append((3, *m.span()))
    return found


def pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A number group cut at white space into groups of at most ``MAX_DIGITS`` digits, from the left."""
    found, first, last, digits = [], start, start, 0
    for m in BLANKLESS.finditer(text, start, end):
        more = len(only_digits(m.group()))
        if digits and digits + more > MAX_DIGITS:
            found.append((first, last))
            digits = 0
        if not digits:
            first = m.start()
        last, digits = m.end(), digits + more
    if digits:
        found.append((first, last))
    return found


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of everything that the field looks at.

    The label is the rule's kind, ``NONE``, or ``CUT`` for a part of a number
    group that the rules read as a whole. Every character is looked at a fixed
    number of times.
    """
    taken = sorted((s, e, k) for k, s, e in base)
    free = []
    i = 0
    for m in NUMBER.finditer(text):
        s, e = m.span()
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        parts, j, at = [], i, s
        while j < len(taken) and taken[j][0] < e:
            parts.append((at, taken[j][0]))
            at = max(at, taken[j][1])
            j += 1
        parts.append((at, e))
        whole = len(parts) == 1
        found = [p for a, b in parts if b > a for p in pieces(text, a, b)]
        free += [(a, b, NONE if whole and len(found) == 1 else CUT) for a, b in found
                 if len(only_digits(text[a:b])) >= MIN_DIGITS and not text[a - 1:a].isalnum() and not text[b:b + 1].isalnum()]
    names = {name for k, s, e in base if k == 0 and len(name := text[s:text.index("@", s)].rstrip(".")) >= 4}
    if names:
        free += [(m.start(), m.start() + len(word), NONE) for m in RUN.finditer(text)
                 if (word := m.group().rstrip(".")) in names]
    places, i, end = [], 0, 0
    for s, e, k in sorted(free):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if (i == len(taken) or taken[i][0] >= e) and s >= end:
            places.append((s, e, k))
            end = e
    return sorted(places + taken)


def possible(s: str) -> list[bool]:
    """Which labels a mention's form allows: nothing like a number is an address, no kind has digits it cannot have."""
    groups = re.findall(r"[0-9]+", s)
    n = sum(map(len, groups))
    address = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    return [n < MIN_DIGITS, address, 13 <= n <= 19 and luhn("".join(groups)), MIN_DIGITS <= n <= 15 and not address, True]


def features(s: str) -> list[float]:
    digits = only_digits(s)
    n = len(digits)
    return [1.0, "@" in s, s.startswith("+"), "(" in s, s.count(".") == 3, n == 0, MIN_DIGITS <= n <= 8, 9 <= n <= 12,
            13 <= n <= 19, n > 19, 13 <= n <= 19 and luhn(digits), " " in s or "-" in s, 0.0]


def graph(text: str, places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the mentions; edges (i, j); their kinds: 0 chain, 1 same digits, 2 same last digits, 3 same name."""
    x = np.array([features(text[s:e]) for s, e, _ in places], float).reshape(-1, N_FEATURES)
    edges, kinds = [], []
    last: dict[tuple, int] = {}
    exact: list[str] = []
    for i, (s, e, _) in enumerate(places):
        word = text[s:e]
        digits = only_digits(word)
        exact.append(digits)
        if i:
            edges.append((i - 1, i))
            kinds.append(0)
        keys = []
        if len(digits) >= MIN_DIGITS and "@" not in word:
            keys.append(("digits", digits[-MIN_DIGITS:]))
        if "@" in word or not digits or not word[0].isdigit():
            keys.append(("name", word.partition("@")[0].lower()))
        for key in keys:
            if key in last and last[key] != i:
                edges.append((last[key], i))
                kinds.append(3 if key[0] == "name" else 1 if exact[last[key]] == digits else 2)
            last[key] = i
    return x, np.array(edges, int).reshape(-1, 2), np.array(kinds, int)


class Field:
    """Log-linear weights: labels x features, a chain matrix, and one weight for each kind of resemblance."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def pair(self, kinds: np.ndarray) -> np.ndarray:
        """Log potentials of the edges: edge x label of i x label of j."""
        out = np.repeat(self.chain[None], len(kinds), 0)
        like = kinds > 0
        out[like] = np.eye(N_LABELS)[None] * self.skip[kinds[like] - 1][:, None, None]
        return out

    def marginals(self, x, edges, kinds, clamped, allowed=None) -> np.ndarray:
        """Loopy sum-product over all edges at once, with damping; labels that are not allowed keep no weight."""
        local = x @ self.unary.T
        if allowed is not None:
            local[~allowed] = -30.0
        known = clamped != NONE
        local[known] = -30.0
        local[known, clamped[known]] = 0.0
        if not len(edges):
            return _softmax(local)
        pair = self.pair(kinds)
        both = np.concatenate([pair, pair.transpose(0, 2, 1)])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), N_LABELS))
        belief = local
        for _ in range(ROUNDS):
            belief = local.copy()
            np.add.at(belief, target, message)
            inner = belief[source] - message[back]
            new = _logsumexp(inner[:, :, None] + both, 1)
            new -= new.max(1, keepdims=True)
            if np.abs(new - message).max() < 1e-4:
                break
            message = DAMPING * message + (1 - DAMPING) * new
        return _softmax(belief)


def _logsumexp(a, axis):
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def _softmax(a):
    e = np.exp(a - a.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


PACKED = (np.uint8, np.uint8, np.int32, np.uint8)     # features, labels, edges, edge kinds of one text, as bytes


def example(text: str) -> tuple[bytes, ...] | None:
    """Features, labels, edges and their kinds of a text's labelled mentions, cues masked in half of them."""
    places = [p for p in mentions(text, base_spans(text)) if p[2] != CUT]
    if not places:
        return None
    x, edges, kinds = graph(text, places)
    hidden = np.array([zlib.crc32(f"{text[s:e]}:{s}".encode()) % 2 == 0 for s, e, _ in places])
    x[np.ix_(hidden, [1, 2, 3, 4, 10])] = 0
    x[hidden, N_FEATURES - 1] = 1
    labels = np.array([k for _, _, k in places])
    return tuple(a.astype(kind).tobytes() for a, kind in zip((x, labels, edges, kinds), PACKED, strict=True))


def fit(sample: list, steps: int = 300) -> Field:
    """Pseudo-likelihood of the rules' labels given the neighbours' labels, by gradient steps.

    ``sample`` holds texts, or rows whose last four fields are what ``example`` makes of a text.
    """
    packed = [e for t in sample if (e := example(t) if isinstance(t, str) else t[-4:])]
    unary, chain, skip = np.zeros((N_LABELS, N_FEATURES)), np.zeros((N_LABELS, N_LABELS)), np.array(SKIP_PRIOR, float)
    if not packed:
        unary[NONE, 0] = 4.0
        return Field(unary, chain, skip)
    xs, ys, eds, kds = zip(*([np.frombuffer(b, kind) for b, kind in zip(e, PACKED, strict=True)] for e in packed),
                           strict=True)
    starts = np.cumsum([0, *map(len, ys)])
    n = int(starts[-1])
    x, y = np.concatenate(xs).reshape(n, N_FEATURES).astype(float), np.concatenate(ys).astype(int)
    edges = np.vstack([e.reshape(-1, 2).astype(int) + at for e, at in zip(eds, starts, strict=False)])
    kinds = np.concatenate(kds).astype(int)
    truth = np.eye(N_LABELS)[y]
    ends = np.concatenate([edges, edges[:, ::-1]])
    both = np.concatenate([kinds, kinds])
    is_chain = both == 0
    for step in range(steps):
        logits = x @ unary.T
        np.add.at(logits, ends[is_chain, 0], chain[y[ends[is_chain, 1]]])
        for k in range(1, 4):
            np.add.at(logits, ends[both == k, 0], skip[k - 1] * truth[ends[both == k, 1]])
        gap = truth - _softmax(logits)
        rate = 2.0 / (1 + step / 50)
        unary += rate * (gap.T @ x / n - 1e-3 * unary)
        grad = np.zeros_like(chain)
        np.add.at(grad, y[ends[is_chain, 1]], gap[ends[is_chain, 0]])
        chain += rate * ((grad + grad.T) / 2 / n - 1e-2 * chain)
        for k in range(1, 4):
            of_kind = both == k
            gain = (gap[ends[of_kind, 0]] * truth[ends[of_kind, 1]]).sum() / n
            skip[k - 1] += rate * (gain - 1e-2 * (skip[k - 1] - SKIP_PRIOR[k - 1]))
    return Field(unary, chain, np.maximum(skip, 0))


def find(text: str, field: Field) -> tuple[list, list]:
    """(the rules' spans, all spans), each by kind and start."""
    if not HINT.search(text):
        return [], []
    base = base_spans(text)
    places = mentions(text, base)
    added = []
    if any(k >= NONE for _, _, k in places):      # also where the rules find nothing
        clamped = np.array([min(k, NONE) for _, _, k in places])
        allowed = np.array([possible(text[s:e]) for s, e, _ in places])
        x, edges, kinds = graph(text, places)
        alone = ~np.isin(np.arange(len(places)), edges[kinds > 0])
        bare = np.array([text[s:e].isdigit() for s, e, _ in places])
        allowed[alone & bare, KINDS.index("phone")] = False      # plain digits are a phone only where they repeat one
        p = field.marginals(x, edges, kinds, clamped, allowed)
        for (s, e, k), row in zip(places, p, strict=True):
            if k >= NONE and (best := int(row.argmax())) != NONE and row[best] >= SURE:
                added.append((best, s, e))
    return base, sorted(base + added)


def spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def train(docs: DataFrame, id_column: str = "doc_id", text: str = "text", max_texts: int = FIT_TEXTS) -> Field:
    """Fits on about ``max_texts`` distinct texts that hold a mention (at most twice as many are expected), by hash."""
    body = text_of(text)
    hinting = docs.select(body.alias("t")).where(F.col("t").rlike(r"[0-9]{3}|@"))
    # Copies count once: hashes of the texts are counted, and one text of each chosen hash is used.
    hashed = hinting.withColumn("h", F.xxhash64("t"))
    chosen = hash_sample(hashed, F.col("h"), max_texts, hashed.select("h").distinct().count())

    def run(batches):
        for batch in batches:
            found = [(h, *e) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                     if (e := example(t))]
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                names=["h", "x", "y", "edges", "kinds"])

    rows = (chosen.dropDuplicates(["h"]).select("h", "t")
            .mapInArrow(run, "h bigint, x binary, y binary, edges binary, kinds binary").collect())
    return fit(sorted((r["h"], *map(bytes, r[1:])) for r in rows))


def detect(docs: DataFrame, field: Field, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column``, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document.

    Counts and digest are of the rules' spans, ``spans`` lists these and the
    field's (kind:start:end in code points). Null and empty texts have none.
    Every row gives a row, repeated ones too; other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for t in batch.column(1).to_pylist():
                base, every = find(t, field)
                for k, column in enumerate(counts):
                    column.append(sum(b[0] == k for b in base))
                digests.append(hashlib.sha256(spell(sorted(base)).encode()).hexdigest())
                spans.append(spell(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())],
                names=[id_column, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return (docs.select(id_column, text_of(text).alias("__text"))
            .mapInArrow(run, f"`{id_column}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                             "base_sha256 string, spans string"))
