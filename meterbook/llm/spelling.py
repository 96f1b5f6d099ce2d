"""Spelling variants by a bit-sliced position index over the vocabulary.

Words are counted in one pass over the texts. Two words are near when they
differ by exactly one inserted, deleted or replaced code point. The index has
a bitset for every (position, letter): bit i says that word i has that letter
there. A query word runs over its letters with two sets of candidates at a
time, those without an error so far and those with one: a replaced letter
keeps the position, an inserted one shifts the index by a position. Each step
is a few operations on machine words, 64 candidates at once and many query
words side by side.

The vocabulary is dealt out so that near words meet: the error lies in one
half of the shorter word, so the other half agrees. Words are indexed
together that share such a half; one that too many share is split again, in
halves of what may still differ, so no page of the index grows with the
vocabulary. At the end of such a split all but one letter agree and at most a
few hundred words are left. A page answers for all words that it holds, and
only near pairs leave it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash, text_of
from .shingles import _BYTE, mix, powers

# Fixed values of the contract.
MISSPELT = 199                 # a run is misspelt where this divides its checksum
LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5                      # a form occurs at least so many times as often

SLICE_BYTES = 4 << 20          # text that is taken apart at a time
LONG_RUN = 64                  # bytes; longer runs are checked one by one
HELD_WORDS = 1 << 18           # of a task's counts before they are passed on
PAGE_WORDS = 1024              # words indexed together
PAGE_CHARS = 1 << 22           # and their letters, at most
HOT_CHARS = 1 << 15            # letters of the words that share a half before they are split again
PART_ENTRIES = 1 << 16         # index entries in a task
QUERY_CELLS = 1 << 17          # machine words of a set, over the query words that run side by side
MANY_KEYS = 1_000_000          # split halves that are broadcast at most


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def misspell(start: int, run: bytes) -> str:
    """The word that a run stands for; ``start`` is the checksum of ``<doc_id>:``."""
    word, h = run.decode(), zlib.crc32(run, start)
    if h % MISSPELT:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _pieces(data: bytes):
    """Stretches of a text, cut where no run of letters is cut."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data) and (data[end] >= 128 or 97 <= data[end] <= 122):
            end += 1
        yield data[at:end]
        at = end


def _count(starts_of: list[int], pieces: list[bytes], counts: dict[bytes, int]) -> None:
    """Add the words of lower-cased pieces to ``counts``."""
    data = b" ".join(pieces)
    raw = np.frombuffer(data, np.uint8)
    lead = raw == 0xC3                       # U+00C0 to U+00FF are two bytes, the first of them C3
    letter = (raw >= 97) & (raw <= 122) | lead
    letter[1:] |= lead[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]])))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return
    n = last - first
    order = np.argsort(-n, kind="stable")
    first, last, n = first[order], last[order], n[order]
    ends = np.cumsum([len(p) + 1 for p in pieces])
    start = np.array(starts_of, np.uint32)[np.searchsorted(ends, first, side="right")]
    state = start ^ np.uint32(0xFFFFFFFF)
    for j in range(int(min(n[0], LONG_RUN))):
        k = int(np.searchsorted(-n, -j, side="left"))       # runs of more than j bytes
        state[:k] = _CRC[(state[:k] ^ raw[first[:k] + j]) & np.uint32(255)] ^ (state[:k] >> np.uint32(8))
    apart = ((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(MISSPELT) == 0) | (n > LONG_RUN)
    for i in np.flatnonzero(apart).tolist():
        word = misspell(int(start[i]), data[first[i]:last[i]])
        if len(word) >= LEAST_LETTERS:
            key = word.encode()
            counts[key] = counts.get(key, 0) + 1
    inside = np.concatenate([[0], np.cumsum((raw & 0xC0) == 0x80)])
    plain = ~apart & (n - (inside[last] - inside[first]) >= LEAST_LETTERS)
    first, last = first[plain], last[plain]
    with np.errstate(over="ignore"):
        up, down = powers(len(raw) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * up[:len(raw)])])
        keys = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    _, index, many = np.unique(keys, return_index=True, return_counts=True)
    for a, b, m in zip(first[index].tolist(), last[index].tolist(), many.tolist(), strict=True):
        key = data[a:b]
        counts[key] = counts.get(key, 0) + m


def _counted(batches):
    counts: dict[bytes, int] = {}

    def flushed():
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())],
                                         names=["word", "n"])
        counts.clear()
        return out

    for b in batches:
        held, starts, size = [], [], 0
        for doc, text in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            start = zlib.crc32(f"{doc}:".encode())
            for piece in _pieces(text.lower()):
                held.append(piece)
                starts.append(start)
                size += len(piece) + 1
                if size >= SLICE_BYTES:
                    _count(starts, held, counts)
                    held, starts, size = [], [], 0
        if held:
            _count(starts, held, counts)
        if len(counts) > HELD_WORDS:
            yield flushed()
    yield flushed()


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of every word that is long and frequent enough."""
    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), text_of(text).alias("text"))
    return (rows.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


KEY = ["s", "a", "b", "fixed"]


def _fixed(a, b):
    """What words with letters ``a`` to ``b`` of ``s`` in doubt have to share."""
    tail = F.col("s") - b
    return F.concat(F.substring("word", F.lit(1), a), F.lit("\u0001"),
                    F.substring("word", F.char_length("word") - tail + 1, tail))


def _halves(frame: DataFrame) -> DataFrame:
    """Entries for both halves of the stretch in doubt."""
    mid = F.expr("a + (b - a) div 2")
    cut = F.explode(F.array(F.struct(F.col("a").alias("x"), mid.alias("y")), F.struct(mid.alias("x"), F.col("b").alias("y")))).alias("cut")
    return (frame.select("word", "n", "s", cut).select("word", "n", "s", F.col("cut.x").alias("a"), F.col("cut.y").alias("b"))
            .withColumn("fixed", _fixed(F.col("a"), F.col("b"))))


def _pages(table: pa.Table):
    """(words, counts, s) that are indexed together: groups of one key, packed by the length of the shorter word."""
    columns = {c: table.column(c).to_pylist() for c in ("s", "a", "b", "fixed", "word", "n")}
    keys = list(zip(*(columns[c] for c in KEY), strict=True))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    page: list[int] = []
    size = 0
    at = 0
    while at < len(order):
        key, end = keys[order[at]], at + 1
        while end < len(order) and keys[order[end]] == key:
            end += 1
        group = order[at:end]
        at = end
        s = key[0]
        lengths = [len(columns["word"][i]) for i in group]
        if len(group) < 2 or s not in lengths:
            continue
        if page and (size != s or len(page) + len(group) > PAGE_WORDS or (len(page) + len(group)) * (s + 1) > PAGE_CHARS):
            yield [columns["word"][i] for i in page], [columns["n"][i] for i in page], size
            page = []
        page += group
        size = s
    if page:
        yield [columns["word"][i] for i in page], [columns["n"][i] for i in page], size


def near_in_page(words: list[str], s: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (a, b) of near words, in both directions; ``words`` have ``s`` or ``s + 1`` letters, the shorter one of a pair ``s``."""
    m = len(words)
    codes = np.frombuffer("".join(w.ljust(s + 1, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(m, s + 1)
    letters, kind = np.unique(codes, return_inverse=True)
    kind = kind.reshape(m, s + 1)
    wide = -(-m // 64) * 64

    def bits(flags: np.ndarray) -> np.ndarray:
        padded = np.zeros((*flags.shape[:-1], wide), bool)
        padded[..., :m] = flags
        return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)

    index = np.stack([bits(kind.T == k) for k in range(len(letters))], axis=1)     # position, letter, machine word
    same_length, longer = bits(codes[:, s] == 0), bits(codes[:, s] != 0)
    queries = np.flatnonzero(codes[:, s] == 0)
    step = max(1, QUERY_CELLS // (wide // 64))
    found = []
    for at in range(0, len(queries), step):
        q = queries[at:at + step]
        none = np.full((len(q), wide // 64), ~np.uint64(0))         # no error so far
        replaced = np.zeros_like(none)                              # one, at this position or before
        inserted = np.zeros_like(none)                              # one more letter than the query word has
        for j in range(s):
            here, shifted = index[j][kind[q, j]], index[j + 1][kind[q, j]]
            replaced = (replaced & here) | (none & ~here)
            inserted = (inserted | none) & shifted
            none &= here
        near = (replaced & same_length) | ((inserted | none) & longer)
        row, cell = np.nonzero(near)
        flags = np.unpackbits(near[row, cell].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, bit = np.nonzero(flags)
        found.append((q[row[i]], cell[i] * 64 + bit))
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    back = codes[b, s] != 0                 # equally long words find each other
    return np.concatenate([a, b[back]]), np.concatenate([b, a[back]])


def _links(table: pa.Table) -> pa.Table:
    out = []
    for words, counts, s in _pages(table):
        a, b = near_in_page(words, s)
        if len(a):
            w, n = pa.array(words), pa.array(counts, pa.int64())
            out.append(pa.table({"word": w.take(pa.array(a)), "near": w.take(pa.array(b)), "near_n": n.take(pa.array(b))}))
    empty = pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string()), "near_n": pa.array([], pa.int64())})
    return pa.concat_tables(out).group_by(["word", "near", "near_n"]).aggregate([]) if out else empty


def near_words(vocab: DataFrame, hot_chars: int = HOT_CHARS) -> DataFrame:
    """(word, near, near_n): every pair of near words, both ways, once. ``vocab`` has distinct words and n."""
    size = F.char_length("word")
    frame = (vocab.select("word", "n", F.explode(F.array(size, size - 1)).alias("s")).where(F.col("s") >= LEAST_LETTERS)
             .withColumn("a", F.lit(0)).withColumn("b", F.col("s")))
    entries = stash(_halves(frame), "halves")
    ready = []
    while True:
        hot = stash(entries.groupBy(*KEY).count().where((F.col("count") * (F.col("s") + 1) > hot_chars) & (F.col("b") - F.col("a") > 1))
                    .drop("count"), "hot-halves")
        n_hot = hot.count()
        if not n_hot:
            ready.append(entries)
            break
        keys = F.broadcast(hot) if n_hot <= MANY_KEYS else hot
        ready.append(entries.join(keys, KEY, "left_anti"))
        entries = stash(_halves(entries.join(keys, KEY, "left_semi")), "halves")
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    parts = max(1, -(-every.count() // PART_ENTRIES))
    links = (every.withColumn("part", F.pmod(F.xxhash64(*KEY), F.lit(parts)))
             .groupBy("part").applyInArrow(lambda t: _links(t), "word string, near string, near_n bigint"))
    return links.distinct()


def variants(docs: DataFrame, id_column: str = "doc_id", text: str = "text", hot_chars: int = HOT_CHARS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    A form is the near word of largest n, the smallest in code-point order of
    equals, where it occurs at least five times as often; the root is the end
    of the chain of forms. Null and empty texts have no words; a null id counts
    as an empty one in the checksum. Repeated rows count as often as they
    occur. A table without words gives no row. Other columns are not read.
    Runs of any length are words; counts within a task are kept by 64-bit
    hashes of runs of up to 64 bytes.
    """
    small_batches(docs.sparkSession)
    vocab = stash(vocabulary(docs, id_column, text), "vocabulary")
    best = near_words(vocab, hot_chars).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    joined = vocab.join(best, "word", "left")
    enough = -F.col("best.less") >= TIMES * F.col("n")
    rows = stash(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                               F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    # A form occurs five times as often as its word, so chains are short and end; each round doubles the stretch followed.
    ends = stash(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = stash(ends.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"),
                                                               F.col("beyond").isNotNull().alias("moved")), "roots")
        ends = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return (rows.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
