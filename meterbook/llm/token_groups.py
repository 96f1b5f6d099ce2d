"""N-gram Jaccard join with a token-group matrix.

Every text is its set of word shingles (64-bit hashes). Equal sets are one
node. Similar nodes are put into groups: nodes with the same smallest shingle
meet in parts of bounded size, where each joins the first earlier member it
links with, and the leaders meet again until a shingle's nodes fit one part.
A group is thus connected already, whatever it holds.

The matrix has a row for every token and a column for every group: a group's
tokens are the union of its members'. A link needs at least three quarters of
the query's tokens, so among any quarter plus one of them there must be a
match; the matrix therefore keeps each member's prefix only, in an order that
puts frequent tokens last. Groups that share a matrix row with a query are its
candidates. A bit union of the group's whole token sets bounds the overlap
from above; only groups that can still reach it are opened, and their members
are compared by bit sets (an exact bound on the difference) and then by their
sets. Before that, every member of a row meets the row's most typical member
only; groups that these links join need not be opened to each other. Nothing
is sampled, and no list is cut.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom_cascade import Level, bit_array, hits
from .common import small_batches, stash, text_of
from .graph import components
from .shingles import shingle_set

NEED = (75, 100)                 # 100 * intersection >= 75 * union
PART = 128                       # nodes that are compared directly in one task
HEAVY = 32                       # texts from which on a token counts as frequent
MAX_HEAVY = 500_000              # frequent tokens that are broadcast; more raise the limit above HEAVY
SLICE_BYTES = 4 << 20            # text that a Python worker turns into sets at a time
RANGE_CHARS = 16 << 20           # text per range of tokens
MAX_SIGNATURE_BITS = 1 << 16
MAX_FILTER_BITS = 1 << 26


def prefix_length(n: int) -> int:
    return n - -(-NEED[0] * n // NEED[1]) + 1


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets link."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or NEED[1] * len(small) < NEED[0] * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return NEED[1] * both >= NEED[0] * (len(a) + len(b) - both)


def signature(tokens: np.ndarray) -> bytes:
    """Bit set of the tokens, about four bits for each; sizes are powers of two, so a larger one folds onto a smaller."""
    size = min(MAX_SIGNATURE_BITS, max(64, 1 << (4 * max(1, len(tokens)) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(a: bytes, b: bytes) -> tuple[int, int, int]:
    """Both signatures as integers of the smaller one's size, and the number of bits."""
    size = 8 * min(len(a), len(b))
    out = []
    for raw in (a, b):
        x, width = int.from_bytes(raw, "little"), 8 * len(raw)
        while width > size:
            width //= 2
            x = (x >> width) | (x & ((1 << width) - 1))
        out.append(x)
    return out[0], out[1], size


def may_link(a: bytes, n_a: int, b: bytes, n_b: int) -> bool:
    """False only if the bit sets prove that the sets differ in too many tokens.

    J >= 3/4 allows a symmetric difference of (n_a + n_b) / 7 tokens at most;
    every bit that differs is a token that differs.
    """
    if NEED[1] * min(n_a, n_b) < NEED[0] * max(n_a, n_b):
        return False
    x, y, _ = _fold(a, b)
    return (NEED[1] + NEED[0]) * (x ^ y).bit_count() <= (NEED[1] - NEED[0]) * (n_a + n_b)


def may_open(query: bytes, n: int, union: bytes) -> bool:
    """False only if the query has too many tokens outside the group's union to link with any member."""
    x, y, size = _fold(query, union)
    return (x & ~y & ((1 << size) - 1)).bit_count() <= n - -(-NEED[0] * n // NEED[1])


def _slices(texts: list):
    """Ranges of rows with about SLICE_BYTES of text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > SLICE_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    heads = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else \
        np.zeros(0, np.int64)
    return heads, np.diff(np.append(heads, len(sorted_values)))


SCAN = "range int, tokens binary, counts binary, ids binary, sizes binary, digests binary, least binary, signatures array<binary>"
SUMMARY = ("token bigint, df bigint, doc_id bigint, n_shingles bigint, digest binary, least bigint, signature binary")


def _summary(docs: DataFrame, bits: int) -> DataFrame:
    """One pass: a row per document (size, digest, smallest token, signature) and a row per frequent token.

    Tokens travel in packed arrays, one for each slice of texts and range of
    hashes; 32 bits after the range's are enough to count with, as the counts
    only order tokens. Document rows travel along, in ranges after the tokens'.
    """
    ranges = 1 << bits

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                sets = [shingle_set(t) for t in texts[a:b]]
                kept = [i is not None for i in ids[a:b]]
                every = np.concatenate(sets)
                every.sort()
                every >>= np.uint64(32 - bits)
                heads, counts = _runs(every)
                every, counts = every[heads], np.minimum(counts, 255).astype(np.uint8)
                cuts = np.searchsorted(every, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32))
                rows = [(r, every[x:y].astype(np.uint32).tobytes(), counts[x:y].tobytes(), None, None, None, None, None)
                        for r, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
                rows.append((ranges + int(every[0] if len(every) else 0) % ranges, None, None,
                             np.array([-1 if i is None else i for i in ids[a:b]], np.int64).tobytes() + np.array(kept).tobytes(),
                             np.array([len(s) for s in sets], np.int64).tobytes(),
                             b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets),
                             np.array([s[0] if len(s) else 0 for s in sets], np.uint64).tobytes(),
                             [signature(s) for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 6,
                                                                           pa.list_(pa.binary())), strict=True)],
                    names=["range", "tokens", "counts", "ids", "sizes", "digests", "least", "signatures"])

    def reduce(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        names = ["token", "df", "doc_id", "n_shingles", "digest", "least", "signature"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        if r >= ranges:
            out: list[list] = [[] for _ in range(5)]
            for i in range(table.num_rows):
                get = lambda c, i=i: table.column(c)[i].as_py()
                sizes = np.frombuffer(get("sizes"), np.int64)
                n = len(sizes)
                raw = get("ids")
                ids, there = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, bool, n, 8 * n)
                digests = get("digests")
                out[0] += [i if t else None for i, t in zip(ids.tolist(), there.tolist(), strict=True)]
                out[1] += sizes.tolist()
                out[2] += [digests[16 * j:16 * j + 16] for j in range(n)]
                out[3] += np.frombuffer(get("least"), np.int64).tolist()
                out[4] += get("signatures")
            none = [None] * len(out[0])
            return pa.table([pa.array(c, t) for c, t in zip([none, none, *out], types, strict=True)], names=names)
        tokens = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("tokens")])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")])
        order = np.argsort(tokens)
        tokens, counts = tokens[order], counts[order]
        heads, _ = _runs(tokens)
        df = np.add.reduceat(counts.astype(np.int64), heads) if len(heads) else heads
        some = df > HEAVY
        n = int(some.sum())
        none = [None] * n
        found = tokens[heads[some]].astype(np.int64) | np.int64(r) << np.int64(32)
        return pa.table([pa.array(found), pa.array(df[some]), *[pa.array(none, t) for t in types[2:]]], names=names)

    return docs.mapInArrow(scan, SCAN).groupBy("range").applyInArrow(reduce, SUMMARY)


def only(docs: DataFrame, ids: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that may be among ``ids``, by a bit filter of bounded size; a join settles the rest.

    A filter that is too small for the ids lets more rows pass, nothing else.
    """
    n = ids.count()
    size = min(MAX_FILTER_BITS, max(64, 64 * (10 * n // 64 + 1)))
    level = Level(stash(bit_array(ids.select(F.col(ids.columns[0]).alias("key")), "key", size, 3), "filter"), size, 3, n)
    return docs.where(F.col(id_column).isNotNull() & hits(level, F.col(id_column)))


def _cluster(table: pa.Table) -> pa.Table:
    """Leaders within a part: each node joins the first earlier leader it links with."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    sets = [shingle_set(t) for t in texts]
    marks = np.zeros((len(ids), 64), np.uint64)
    for i, s in enumerate(sets):
        bits = np.zeros(4096, bool)
        bits[(s & np.uint64(4095)).astype(np.int64)] = True
        marks[i] = np.packbits(bits, bitorder="little").view(np.uint64)
    sizes = np.array([len(s) for s in sets])
    leaders: list[int] = []
    found = []
    for i in sorted(range(len(ids)), key=lambda i: (-len(sets[i]), ids[i])):
        at = np.array(leaders, np.int64)
        differ = np.bitwise_count(marks[at] ^ marks[i]).sum(1) if len(at) else at
        near = at[(NEED[1] + NEED[0]) * differ <= (NEED[1] - NEED[0]) * (sizes[at] + sizes[i])] if len(at) else at
        leader = next((int(j) for j in near if links(sets[j], sets[i])), i)
        if leader == i:
            leaders.append(i)
        found.append((ids[i], ids[leader]))
    return pa.table({"doc_id": pa.array([x for x, _ in found], pa.int64()),
                     "leader": pa.array([x for _, x in found], pa.int64())})


def _groups(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, grp): the leader that the node hangs on, itself for most. ``nodes``: node, least."""
    members = nodes.select("node", "least")
    pointer = None
    while True:
        sizes = members.groupBy("least").agg(F.count("*").alias("n")).where("n > 1")
        placed = stash(members.join(sizes, "least")
                       .withColumn("part", F.pmod(F.xxhash64("node", F.lit(len(pointer.columns) if pointer is not None else 0)),
                                                  F.ceil(F.col("n") / PART)))
                       .select("node", "least", "n", "part"), "parts")
        if placed.isEmpty():
            break
        texts = (only(docs, placed.select("node")).join(placed, F.col("doc_id") == F.col("node"))
                 .select("least", "part", "doc_id", "text"))
        led = stash(texts.groupBy("least", "part").applyInArrow(lambda t: _cluster(t), "doc_id bigint, leader bigint")
                    .where("doc_id <> leader").dropDuplicates(["doc_id"]), "leaders")
        step = led.select(F.col("doc_id").alias("__from"), F.col("leader").alias("__to"))
        pointer = stash(step.select(F.col("__from").alias("node"), F.col("__to").alias("grp")) if pointer is None else
                        pointer.join(step, pointer.grp == F.col("__from"), "left")
                        .select("node", F.coalesce("__to", "grp").alias("grp"))
                        .unionByName(step.select(F.col("__from").alias("node"), F.col("__to").alias("grp"))), "pointer")
        before = placed.where(F.col("n") > PART)
        again = stash(before.join(step, F.col("node") == F.col("__from"), "left_anti"), "again")
        n_before, n_after = before.count(), again.count()
        # Parts without copies do not shrink; their members stay groups of their own.
        if not n_after or n_after > 0.75 * n_before:
            break
        members = again.select("node", "least")
    if pointer is None:
        return nodes.select("node", F.col("node").alias("grp"))
    moved = pointer.select(F.col("node").alias("__node"), "grp")
    return stash(nodes.join(moved, nodes.node == F.col("__node"), "left")
                 .select("node", F.coalesce("grp", "node").alias("grp")).dropDuplicates(["node"]), "groups")


def _postings(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], bits: int) -> DataFrame:
    """(token, doc_id, place, frequent) of every prefix token that two or more rows have in their prefixes.

    ``place`` is the token's rank in the row's set, ``frequent`` how many of the set's tokens are frequent.
    """
    ranges = 1 << bits
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def scan(batches):
        names, often = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                tokens, owners, places = [], [], []
                frequent = np.zeros(b - a, np.int64)
                for i, text in enumerate(texts[a:b]):
                    s = shingle_set(text)
                    if not len(s) or ids[a + i] is None:
                        continue
                    if len(names):
                        short = s >> np.uint64(32 - bits)
                        at = np.searchsorted(names, short)
                        at[at == len(names)] = 0
                        df = np.where(names[at] == short, often[at], 0)
                        if df.any():
                            s = s[np.lexsort((s, df))]
                        frequent[i] = np.count_nonzero(df)
                    s = s[:prefix_length(len(s))]
                    tokens.append(s)
                    places.append(np.arange(len(s), dtype=np.uint32))
                    owners.append(np.full(len(s), i, np.uint32))
                if not tokens:
                    continue
                every = np.concatenate(tokens) >> np.uint64(32 - bits)
                order = np.argsort(every)
                every, owner, place = every[order], np.concatenate(owners)[order], np.concatenate(places)[order]
                cuts = np.searchsorted(every, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32)).tolist()
                own = np.array([-1 if i is None else i for i in ids[a:b]], np.int64).tobytes() + frequent.tobytes()
                rows = [(r, every[x:y].astype(np.uint32).tobytes(), owner[x:y].tobytes(), place[x:y].tobytes(), own)
                        for r, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)],
                    names=["range", "tokens", "owners", "places", "ids"])

    def reduce(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        tokens, owners, rows, places = [], [], [], []
        for i in range(table.num_rows):
            tokens.append(np.frombuffer(table.column("tokens")[i].as_py(), np.uint32))
            owners.append(np.frombuffer(table.column("owners")[i].as_py(), np.uint32))
            places.append(np.frombuffer(table.column("places")[i].as_py(), np.uint32))
            rows.append(np.full(len(tokens[-1]), i, np.uint32))
        every = np.concatenate(tokens)
        order = np.argsort(every)
        every = every[order]
        _, counts = _runs(every)
        some = np.repeat(counts > 1, counts)
        order = order[some]
        row, owner = np.concatenate(rows)[order], np.concatenate(owners)[order]
        both = [np.frombuffer(x.as_py(), np.int64) for x in table.column("ids")]
        starts = np.cumsum([0] + [len(x) // 2 for x in both])
        ids = np.concatenate([x[:len(x) // 2] for x in both])[starts[row] + owner]
        often = np.concatenate([x[len(x) // 2:] for x in both])[starts[row] + owner]
        return pa.table({"token": every[some].astype(np.int64) | np.int64(r) << np.int64(32), "doc_id": ids,
                         "place": np.concatenate(places)[order].astype(np.int64), "frequent": often})

    return (docs.mapInArrow(scan, "range int, tokens binary, owners binary, places binary, ids binary")
            .groupBy("range").applyInArrow(reduce, "token bigint, doc_id bigint, place bigint, frequent bigint"))


def _where(pairs: DataFrame, test, left: list[str], right: list[str]) -> DataFrame:
    """Rows of ``pairs`` (u, v first) for which ``test`` of the named columns holds; only u and v are kept."""
    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*left, *right)]
            keep = [test(*x) for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))
    return pairs.mapInArrow(run, "u bigint, v bigint")


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs of nodes that link: first by signatures, then by the texts' sets."""
    a = nodes.select(F.col("node").alias("u"), F.col("signature").alias("s1"), F.col("n_shingles").alias("n1"))
    b = nodes.select(F.col("node").alias("v"), F.col("signature").alias("s2"), F.col("n_shingles").alias("n2"))
    near = stash(_where(pairs.join(a, "u").join(b, "v"), may_link, ["s1", "n1"], ["s2", "n2"]), "near")
    ids = stash(near.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "ends")
    texts = stash(only(docs, ids).join(ids, F.col("doc_id") == F.col("node"), "left_semi").select("doc_id", "text"), "texts")
    first = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("t1"))
    second = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("t2"))
    return stash(_where(near.join(first, "u").join(second, "v"), lambda x, y: links(shingle_set(x), shingle_set(y)),
                        ["t1"], ["t2"]).distinct(), "links")


def _unions(nodes: DataFrame) -> DataFrame:
    """(grp, signature): the bit union of the members' tokens."""
    def union(table: pa.Table) -> pa.Table:
        rows = table.column("signature").to_pylist()
        size = min(map(len, rows))
        total = 0
        for raw in rows:
            total |= _fold(raw, bytes(size))[0]
        return pa.table({"grp": table.column("grp").slice(0, 1).cast(pa.int64()),
                         "signature": pa.array([total.to_bytes(size, "little")], pa.binary())})

    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    single = nodes.join(sizes.where("n = 1"), "grp").select("grp", "signature")
    rows = (nodes.join(sizes.where("n > 1"), "grp")
            .withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART))).select("grp", "part", "signature"))
    parts = rows.groupBy("grp", "part").applyInArrow(lambda t: union(t), "grp bigint, signature binary")
    whole = parts.groupBy("grp").applyInArrow(lambda t: union(t), "grp bigint, signature binary")
    return stash(whole.unionByName(single), "unions")


def join(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column``, n_shingles, component_id for every row.

    A text's set is its distinct 5-word shingles (A-Z lower-cased), or its
    whole word sequence if it has one to four words; null texts and texts
    without words have an empty set and link with nothing. Two rows link when
    100 * intersection >= 75 * union. component_id is the smallest id reachable
    by links, the row's own included. Rows that repeat an id are one node with
    all their links. A null id has no component. Other columns are not read;
    an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(2, math.ceil(math.log2(total / RANGE_CHARS + 1)))
    scanned = stash(_summary(docs, bits), "scan")
    rows = scanned.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest", "least", "signature")
    # Equal sets are one node, named by its smallest id.
    sets = stash(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("least").alias("least"),
        F.first("signature").alias("signature")), "sets")
    ids = stash(rows.select("doc_id", "n_shingles", "digest")
                .join(sets.select("digest", "node"), "digest", "left").select("doc_id", "n_shingles", "node"), "ids")
    groups = _groups(docs, sets.select("node", "least"))
    nodes = stash(sets.select("node", "n_shingles", "signature").join(groups, "node"), "nodes")

    classes = {r["c"]: r["n"] for r in scanned.where("token IS NOT NULL").groupBy(
        F.floor(F.log2(F.col("df").cast("double"))).alias("c")).agg(F.count("*").alias("n")).collect()}
    limit, held = HEAVY, sum(classes.values())
    for c in sorted(classes):
        if held <= MAX_HEAVY:
            break
        held -= classes[c]
        limit = (1 << (c + 1)) - 1
    often = scanned.where(F.col("token").isNotNull() & (F.col("df") > limit)).select("token", "df").toPandas().sort_values("token")
    heavy = (often["token"].to_numpy(np.uint64), often["df"].to_numpy(np.int64))

    # The matrix: (token, grp), with the members that have the token in their prefix, its place there and their size.
    owner = ids.where("node IS NOT NULL").select("doc_id", "node", "n_shingles").dropDuplicates(["doc_id", "node"])
    cells = stash(_postings(docs, heavy, bits).join(owner, "doc_id").join(groups, "node")
                  .select("token", "node", "grp", "place", "frequent", "n_shingles").dropDuplicates(["token", "node"]), "cells")
    # First every member of a row meets the row's most typical one only, the one with the largest share of frequent
    # tokens: copies of one text mostly link to the text itself, and then need not be compared with each other.
    typical = F.struct((F.col("frequent") / F.col("n_shingles")).alias("share"), (-F.col("node")).alias("turned"), "grp")
    pivots = cells.groupBy("token").agg(F.min("grp").alias("a"), F.max("grp").alias("b"), F.max(typical).alias("pivot")).where("a <> b")
    stars = stash(cells.join(pivots, "token").where("grp <> pivot.grp")
                  .select(F.least("node", -F.col("pivot.turned")).alias("u"), F.greatest("node", -F.col("pivot.turned")).alias("v"))
                  .distinct(), "stars")
    led = _verified(docs, stars, nodes)
    named = groups.select(F.col("node").alias("u"), F.col("grp").alias("gu"))
    joined = components(led.join(named, "u").join(named.toDF("v", "gv"), "v").select(F.col("gu").alias("u"), F.col("gv").alias("v")))
    label = stash(groups.join(joined.toDF("__grp", "component"), F.col("grp") == F.col("__grp"), "left")
                  .select("node", F.coalesce("component", "grp").alias("label")), "label")
    # Then queries meet the groups that are not one component with them: rows of the matrix with several labels.
    labelled = stash(cells.join(label, "node"), "labelled")
    split = labelled.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("token")
    matrix = stash(labelled.join(split, "token", "left_semi"), "matrix")
    q, m = matrix.alias("q"), matrix.alias("m")
    # What two sets share from a common token on is no more than either has left there.
    left = F.least(F.col("q.n_shingles") - F.col("q.place"), F.col("m.n_shingles") - F.col("m.place"))
    enough = (NEED[0] + NEED[1]) * left >= NEED[0] * (F.col("q.n_shingles") + F.col("m.n_shingles"))
    asked = stash(q.join(m, "token").where((F.col("q.label") < F.col("m.label")) & enough)
                  .select(F.col("q.node").alias("u"), F.col("m.grp").alias("v"), F.col("m.node").alias("w")).distinct(), "asked")
    query = nodes.select(F.col("node").alias("u"), F.col("signature").alias("s1"), F.col("n_shingles").alias("n1"))
    unions = _unions(nodes)
    opened = stash(_where(asked.select("u", "v").distinct().join(query, "u")
                          .join(unions.select(F.col("grp").alias("v"), F.col("signature").alias("s2")), "v"),
                          may_open, ["s1", "n1"], ["s2"]), "opened")
    inner = asked.join(opened, ["u", "v"], "left_semi").select("u", "w")
    found = _verified(docs, inner.select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("v")).distinct(), nodes)

    repeated = (ids.where("doc_id IS NOT NULL AND node IS NOT NULL").groupBy("doc_id")
                .agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v").select("u", "v"))
    edges = (led.unionByName(found).unionByName(repeated)
             .unionByName(groups.where("node <> grp").select(F.col("node").alias("u"), F.col("grp").alias("v"))))
    merged = components(edges)
    return (ids.join(merged, "node", "left")
            .select(F.col("doc_id").alias(id_column), "n_shingles",
                    F.coalesce("component", "node", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: of each component the one with the smallest id, with all its columns."""
    gone = stash(join(docs, id_column, text).where(F.col(id_column) != F.col("component_id"))
                 .select(F.col(id_column).alias("__gone")).distinct(), "gone")
    return docs.join(gone, F.col(id_column) == F.col("__gone"), "left_anti")
