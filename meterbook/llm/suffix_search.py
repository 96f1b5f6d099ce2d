"""Benchmark decontamination by suffix arrays of the training texts.

The texts of a task are taken apart into words and dealt into shards of a
bounded number of words. A shard gets a suffix array over its words: the
order of all its suffixes, by prefix doubling until no two are alike or the
longest benchmark text is covered. Every suffix of every benchmark text is
then searched by bisection, all of them side by side. A search gives the
stretch of the array whose suffixes begin with the window at that place, and
so all its locations; windows that follow each other in both texts join to the
longest verbatim matches. Documents are scanned once and nothing is shuffled.

The benchmark travels to the tasks in blocks of a bounded number of bytes, one
pass over the texts for each block; one block is the rule, and between blocks
the rows are written. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash, text_of
from .shingles import _BYTE, mix, powers

# Fixed values of the contract: what is no word, after A-Z are lower-cased, and the words in a window.
NO_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WINDOW = 10

SHARD_WORDS = (1 << 20) - 4096     # of a suffix array; a rank and a place take 20 bits each
CHUNK_BYTES = 1 << 20
HELD_BYTES = 8 << 20               # texts whose shards are built together
BLOCK_BYTES = 16 << 20             # benchmark text that is broadcast at a time

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of every word of lower-cased bytes, in order."""
    found = []
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        while end < len(data) and _IN_WORD[data[end]] and _IN_WORD[data[end - 1]]:
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], _IN_WORD[raw], [False]])))
        first, last = edge[::2], edge[1::2]
        if len(first):
            with np.errstate(over="ignore"):
                up, down = powers(len(raw) + 1)
                total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * up[:len(raw)])])
                found.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


class Shard:
    """Suffix array over the words of some texts; no match crosses from one text to the next."""

    def __init__(self, texts: list[np.ndarray], depth: int):
        sizes = [len(t) + 1 for t in texts]
        self.begins = np.concatenate([[0], np.cumsum(sizes)])          # of each text; a text ends with a 0
        n = int(self.begins[-1])
        words = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.uint64))]) if texts else np.zeros(0, np.uint64)
        is_word = np.ones(n, bool)
        is_word[self.begins[1:] - 1] = False
        self.known = np.unique(words[is_word])
        # Ranks of known words are even; an unknown one falls between two of them.
        self.words = np.zeros(n + WINDOW, np.int64)
        self.words[:n][is_word] = 2 * np.searchsorted(self.known, words[is_word]) + 2
        place = np.arange(n, dtype=np.int64)
        rank, width = self.words[:n] >> 1, 1
        while True:
            after = np.zeros(n, np.int64)
            after[:max(0, n - width)] = rank[width:]
            # One number holds both ranks and the place, so a plain sort gives the order.
            held = np.sort(rank << 40 | after << 20 | place)
            order, both = held & 0xFFFFF, held >> 20
            new = np.concatenate([[False], both[1:] != both[:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            width *= 2
            if width >= depth or not n or int(rank[order[-1]]) == n - 1:
                break
        self.order = order[is_word[order]]          # suffixes that begin with a word
        heads = self.words[self.order]
        ranks = np.arange(len(self.known)) * 2 + 2
        self.heads = np.concatenate([np.searchsorted(heads, ranks, side="left"), [len(heads)]])

    def ranks(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, words)
        hit = np.zeros(len(words), bool)
        hit[at < len(self.known)] = self.known[at[at < len(self.known)]] == words[at < len(self.known)]
        return 2 * at + 1 + hit

    def search(self, queries: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lo, hi) in the array of the suffixes that begin with ``size`` words of ``queries`` (ranks) at ``start``."""
        lo, hi = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        head = queries[start]
        some = np.flatnonzero((head & 1) == 0)
        known = head[some] // 2 - 1
        left, right = self.heads[known], self.heads[known + 1]
        lo[some] = self._bisect(queries, start[some], size[some], left, right, False)
        found = lo[some] < right
        found[found] = self._compare(queries, start[some][found], size[some][found], self.order[lo[some][found]]) == 0
        hi[some] = lo[some]
        some, right = some[found], right[found]
        hi[some] = self._bisect(queries, start[some], size[some], lo[some], right, True)
        return lo, hi

    def _bisect(self, queries, start, size, lo, hi, past_equal: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            side = self._compare(queries, start[live], size[live], self.order[mid])
            less = side <= 0 if past_equal else side < 0
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo

    def _compare(self, queries, start, size, suffix) -> np.ndarray:
        """-1, 0, 1: the suffix comes before, begins with, or comes after the query."""
        side = np.zeros(len(start), np.int8)
        live, j = np.arange(len(start)), 0
        while len(live):
            live = live[size[live] > j]
            mine, other = self.words[suffix[live] + j], queries[start[live] + j]
            side[live] = np.sign(mine - other)
            live = live[mine == other]
            j += 1
        return side


class Block:
    """Benchmark texts that are searched together: their words, windows and ids."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        texts = [word_hashes(t) for _, t in rows]
        self.ids = sorted({i for i, _ in rows})
        number = {i: k for k, i in enumerate(self.ids)}
        self.words = np.concatenate([np.zeros(0, np.uint64), *texts])
        self.depth = max([WINDOW, *(len(t) for t in texts)])
        owner, start, size, offset = [], [], [], []
        at = 0
        for (i, _), t in zip(rows, texts, strict=True):
            many = max(1, len(t) - WINDOW + 1) if len(t) else 0
            owner += [number[i]] * many
            start += range(at, at + many)
            offset += range(many)
            size += [min(len(t), WINDOW)] * many
            at += len(t)
        self.owner, self.offset = np.array(owner, np.int64), np.array(offset, np.int64)
        start, size = np.array(start, np.int64), np.array(size, np.int64)
        # Equal windows are searched once: a hash of each is enough to tell them apart.
        with np.errstate(over="ignore"):
            key = size.astype(np.uint64)
            for j in range(WINDOW):
                inside = size > j
                key[inside] = mix(key[inside] + self.words[start[inside] + j] * np.uint64(0x9E3779B97F4A7C15))
        _, first, kind = np.unique(key, return_index=True, return_inverse=True)
        self.window_size = size
        self.start, self.size = start[first], size[first]
        by_kind = np.argsort(kind, kind="stable")
        self.users = by_kind                                   # windows of each kind, one kind after the other
        self.user_at = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=len(first)))]).astype(np.int64)

    def locations(self, texts: list[np.ndarray]):
        """(text, word, kind) of every place where a window of some kind begins."""
        found = []
        pieces, room = [], SHARD_WORDS
        cut = [(i, at, t[at:at + SHARD_WORDS // 2 + WINDOW - 1]) for i, t in enumerate(texts) for at in range(0, len(t), SHARD_WORDS // 2)]
        for k, piece in enumerate(cut):
            pieces.append(piece)
            room -= len(piece[2]) + 1
            if k + 1 < len(cut) and len(cut[k + 1][2]) < room:
                continue
            shard = Shard([p[2] for p in pieces], self.depth)
            lo, hi = shard.search(shard.ranks(self.words), self.start, self.size)
            many = hi - lo
            kind = np.repeat(np.arange(len(lo)), many)
            at = np.arange(len(kind)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            place = shard.order[at]
            which = np.searchsorted(shard.begins, place, side="right") - 1
            texts_at = np.array([p[0] for p in pieces], np.int64)[which]
            found.append(np.stack([texts_at, place - shard.begins[which] + np.array([p[1] for p in pieces], np.int64)[which], kind]))
            pieces, room = [], SHARD_WORDS
        every = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        # The stretch that two pieces of a long text share is seen twice.
        return np.unique(every, axis=1) if len(cut) > len({c[0] for c in cut}) else every[:, np.lexsort(every[::-1])]

    def windows_of(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, window): the windows of each row's kind."""
        many = self.user_at[kind + 1] - self.user_at[kind]
        row = np.repeat(np.arange(len(kind)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.user_at[kind], many)
        return row, self.users[at]


def blocks(benchmark: DataFrame, id_column: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES):
    """The benchmark's texts, as blocks of about ``block_bytes`` each."""
    rows = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), text_of(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield Block([(r.id, r.text.encode().lower()) for r in part.collect()])


def _runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _groups(batches):
    """Tables of some batches each, with the words of their texts."""
    held, texts, size = [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            data = [(t or "").encode().lower() for t in part.column("__text").to_pylist()]
            held.append(part)
            texts += [word_hashes(x) for x in data]
            size += sum(map(len, data))
            if size >= HELD_BYTES:
                yield pa.Table.from_batches(held), texts
                held, texts, size = [], [], 0
    if held:
        yield pa.Table.from_batches(held), texts


HITS = "__n_words bigint, __hits array<struct<start:bigint,end:bigint>>, __items array<string>"


def _marker(shared):
    """Adds what a block hits to the columns of ``HITS``."""
    def scan(batches):
        block = shared.value
        for table, texts in _groups(batches):
            where, at, kind = block.locations(texts)
            ends = np.searchsorted(where, np.arange(len(texts)), side="right")
            hits, items = table.column("__hits").to_pylist(), table.column("__items").to_pylist()
            begin = 0
            for i, end in enumerate(ends.tolist()):
                if end > begin:
                    mask = np.zeros(len(texts[i]) + 1, np.int32)
                    np.add.at(mask, at[begin:end], 1)
                    np.add.at(mask, at[begin:end] + block.size[kind[begin:end]], -1)
                    for run in hits[i]:
                        mask[run["start"]] += 1
                        mask[run["end"]] -= 1
                    hits[i] = _runs(np.cumsum(mask[:-1]) > 0)
                    _, window = block.windows_of(np.unique(kind[begin:end]))
                    items[i] = sorted({*items[i], *(block.ids[k] for k in np.unique(block.owner[window]).tolist())})
                begin = end
            names = table.schema.names
            put = {"__n_words": pa.array([len(t) for t in texts], pa.int64()),
                   "__hits": pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                   "__items": pa.array(items, pa.list_(pa.string()))}
            yield from pa.table({c: put.get(c, table.column(c)) for c in names}).to_batches()
    return scan


def _marked(rows: DataFrame, benchmark: DataFrame, item_column: str, item_text: str, block_bytes: int) -> DataFrame:
    """``rows`` has __text; the result also has the columns of ``HITS``."""
    spark = rows.sparkSession
    small_batches(spark)
    frame = rows.selectExpr("*", "CAST(0 AS BIGINT) AS __n_words", "CAST(array() AS array<struct<start:bigint,end:bigint>>) AS __hits",
                            "CAST(array() AS array<string>) AS __items")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    for k, block in enumerate(blocks(benchmark, item_column, item_text, block_bytes)):
        frame = stash(frame, "marked") if k else frame
        frame = frame.mapInArrow(_marker(spark.sparkContext.broadcast(block)), f"{fields}, {HITS}")
    return frame


def report(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id",
           item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_column``, n_words, n_hit, n_items, items_sha256, contaminated and hits of every row.

    ``hits`` lists the stretches of words (start, end exclusive) that windows
    of the benchmark cover. Null and empty texts have no words, in documents
    and benchmark alike; an empty benchmark hits nothing. Rows that repeat an
    id are judged each by its own text. Items with one id are one item; a null
    item id counts as an empty one. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("__id"), text_of(text).alias("__text"))
    n_hit = F.aggregate("__hits", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    return (_marked(rows, benchmark, item_column, item_text, block_bytes)
            .select(F.col("__id").alias(id_column), F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"),
                    F.size("__items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
                    (F.size("__hits") > 0).alias("contaminated"), F.col("__hits").alias("hits")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_column: str = "item_id",
                  item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns; cases as in ``report``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), text_of(text).alias("__text"))
    return _marked(rows, benchmark, item_column, item_text, block_bytes).where(F.size("__hits") == 0).select("__row.*")


MATCH = "item_id string, item_start bigint, doc_start bigint, n_words bigint"


def matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id",
            item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim matches: ``id_column``, item_id, item_start, doc_start, n_words, at least a window long.

    A match can be lengthened on neither side; places count words. Items that
    repeat an id are told apart by nothing, so their matches are listed for each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_column).alias("__id"), text_of(text).alias("__text"))
    out = None
    for block in blocks(benchmark, item_column, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            block = shared.value
            for table, texts in _groups(batches):
                where, at, kind = block.locations(texts)
                row, window = block.windows_of(kind)
                where, at = where[row], at[row]
                # Windows of one item at the same distance follow each other in both texts.
                base = window - block.offset[window]
                order = np.lexsort((at, at - block.offset[window], base, where))
                where, at, window, base = where[order], at[order], window[order], base[order]
                new = np.ones(len(at), bool)
                if len(at):
                    new[1:] = (where[1:] != where[:-1]) | (base[1:] != base[:-1]) | (at[1:] != at[:-1] + 1) | (window[1:] != window[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at))[:len(first)] - 1
                size = block.window_size[window[first]] + last - first
                yield from pa.table({"__id": table.column("__id").take(pa.array(where[first])),
                                     "item_id": pa.array([block.ids[k] for k in block.owner[window[first]].tolist()], pa.string()),
                                     "item_start": pa.array(block.offset[window[first]]), "doc_start": pa.array(at[first]),
                                     "n_words": pa.array(size)}).to_batches(max_chunksize=1 << 16)

        part = rows.mapInArrow(scan, f"__id {rows.schema['__id'].dataType.simpleString()}, {MATCH}")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("__id", id_column)


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^{NO_WORD}]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{NO_WORD}]+') AS w
      FROM benchmark),
places AS (SELECT item, w, least(len(w), {WINDOW}) AS m, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS pos FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, pos, pos + m - 1), ' ') AS gram FROM places),
sizes AS (SELECT DISTINCT m FROM windows),
grams AS (SELECT doc_id, m, pos, array_to_string(list_slice(w, pos, pos + m - 1), ' ') AS gram
          FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS pos FROM d, sizes WHERE len(w) >= m)),
found AS (SELECT DISTINCT g.doc_id, g.pos, g.m, v.item FROM grams g JOIN windows v ON g.m = v.m AND g.gram = v.gram),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + m)) AS p FROM (SELECT DISTINCT doc_id, pos, m FROM found))
        GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.list, '')) AS items_sha256, hit.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
