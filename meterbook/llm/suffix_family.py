"""Repeated passages by a logarithmic family of suffix indexes.

A passage of ``LENGTH`` bytes that occurs twice has to be found wherever it
starts. Every window of that length has an anchor: the place of the smallest
hash among its ``GRAM``-byte strings, leftmost of equals. Equal windows have
their anchor at the same offset, so it is enough to index the suffixes that
start at anchors, about one in 170. An entry holds the fingerprint of the
suffix's first ``GRAM`` bytes, a digest of the whole stretch that its windows
cover, and where it is; a batch's index is its entries sorted by fingerprint,
in ranges that are stored as packed arrays.

A new batch is indexed by itself and merge-scanned against every level: the
entries whose fingerprint occurs on both sides are reported, on both sides.
Then levels of equal size merge, as digits carry in a binary counter, so an
entry is rewritten a logarithmic number of times.

Entries whose whole stretch equals another entry's need no further look. The
others, at the edges of passages, are compared window by window with all that
share their fingerprint. Removal is judged on the input alone.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash, text_of
from .shingles import _BYTE, mix, powers
from .token_groups import only

LENGTH = 400                   # bytes of a repeated string; fixed value of the contract
GRAM = 64
SPAN = LENGTH - GRAM + 1       # strings of GRAM bytes in a window
BATCHES = 4
CHUNK = 1 << 18                # window starts that are looked at at a time
SLICE_BYTES = 4 << 20
RANGE_BYTES = 8 << 20        # text per range of fingerprints
ROW_ENTRIES = 2048             # of a packed row; small rows keep the writers' pages small
PART_ROWS = 8192               # edge entries that are compared in one task
HOT_CLASSES = 4096             # a fingerprint with more different stretches is compared by window hashes over all tasks

_POSITION = np.uint64((1 << 21) - 1)
ENTRY = np.dtype([("fp", np.uint64), ("cls", np.uint64), ("doc", np.int64), ("key", np.uint32), ("lo", np.uint32),
                  ("len", np.uint16), ("known", np.uint8)])


def _prefix(raw: np.ndarray):
    up, down = powers(len(raw) + 1)
    return np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * up[:len(raw)])]), down


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(fingerprint, digest, lo, hi) of every anchor: it is the anchor of the windows that start at lo to hi."""
    span = length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        raw = np.frombuffer(data, np.uint8, min(CHUNK + length - 1, len(data) - at), at)
        n = len(raw)
        with np.errstate(over="ignore"):
            total, down = _prefix(raw)
            grams = mix((total[gram:] - total[:n - gram + 1]) * down[:n - gram + 1])
            keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
            padded = np.full(-(-len(keys) // span) * span, ~np.uint64(0))
            padded[:len(keys)] = keys
            blocks = padded.reshape(-1, span)
            ahead = np.minimum.accumulate(blocks, 1).ravel()
            behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
            starts = n - length + 1
            anchor = (np.minimum(behind[:starts], ahead[span - 1:span - 1 + starts]) & _POSITION).astype(np.int64)
            lo = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            hi = np.append(lo[1:], starts) - 1
            place = anchor[lo]
            digest = mix(mix((total[hi + length] - total[lo]) * down[lo]) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                         + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        # Anchors are minima: mixed again, their fingerprints are spread evenly over the ranges.
        with np.errstate(over="ignore"):
            yield mix(grams[place] + np.uint64(1)), digest, lo + at, hi + at


def window_hashes(data: bytes, length: int = LENGTH) -> np.ndarray:
    """Hash of every window of a short stretch."""
    raw = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        total, down = _prefix(raw)
        n = len(raw) - length + 1
        return mix((total[length:] - total[:n]) * down[:n])


def text_key(data: bytes) -> int:
    """Tells rows that repeat an id apart."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=4).digest(), "little")


HIT = "doc bigint, key bigint, fp bigint, cls bigint, lo bigint, hi bigint"
PACKED = f"range int, entries binary, {HIT}"
_HIT_NAMES = ["doc", "key", "fp", "cls", "lo", "hi"]


def _hit_columns(found: np.ndarray) -> list[pa.Array]:
    lo = found["lo"].astype(np.int64)
    return [pa.array(found["doc"]), pa.array(found["key"].astype(np.int64)), pa.array(found["fp"].view(np.int64)),
            pa.array(found["cls"].view(np.int64)), pa.array(lo), pa.array(lo + found["len"])]


def _packed(r: int, entries: list[np.ndarray], found: np.ndarray) -> pa.Table:
    """Rows of a level (range, entries) and of the entries found (the others)."""
    kept = [e[i:i + ROW_ENTRIES] for e in entries for i in range(0, len(e), ROW_ENTRIES)]
    blanks = [pa.nulls(len(kept), pa.int64())] * 6
    level = pa.table([pa.array([r] * len(kept), pa.int32()), pa.array([e.tobytes() for e in kept], pa.binary()), *blanks],
                     names=["range", "entries", *_HIT_NAMES])
    rows = [np.ascontiguousarray(x) for x in (found[name] for name in ENTRY.names)]
    found = dict(zip(ENTRY.names, rows, strict=True))
    hit = pa.table([pa.nulls(len(found["fp"]), pa.int32()), pa.nulls(len(found["fp"]), pa.binary()), *_hit_columns(found)],
                   names=["range", "entries", *_HIT_NAMES])
    return pa.concat_tables([level, hit])


def _entries(table: pa.Table) -> np.ndarray:
    """Entries of a range, by fingerprint."""
    if not table.num_rows:
        return np.zeros(0, ENTRY)
    e = np.frombuffer(b"".join(table.column("entries").to_pylist()), ENTRY)
    return e[np.argsort(e["fp"], kind="stable")]


def _index(docs: DataFrame, bits: int, batches: int) -> DataFrame:
    """Packed entries of every batch: batch, range, entries. One pass over the texts."""
    def scan(parts):
        for part in parts:
            ids, owner, texts = (part.column(i).to_pylist() for i in range(3))
            held, size = [], 0
            for i in range(len(ids) + 1):
                if size > SLICE_BYTES or (i == len(ids) and held):
                    every = np.concatenate(held)
                    held, size = [], 0
                    place = every["batch"].astype(np.int64) << bits | (every["e"]["fp"] >> np.uint64(64 - bits)).astype(np.int64)
                    order = np.argsort(place, kind="stable")
                    place, every = place[order], every["e"][order]
                    heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((place[heads] >> bits).astype(np.int32)),
                         pa.array((place[heads] & ((1 << bits) - 1)).astype(np.int32)),
                         pa.array([x.tobytes() for x in np.split(every, heads[1:])], pa.binary())],
                        names=["batch", "range", "entries"])
                if i == len(ids):
                    break
                data = (texts[i] or "").encode()
                size += len(data)
                if len(data) < LENGTH:
                    continue
                key = text_key(data)
                for fp, cls, lo, hi in anchors(data):
                    e = np.zeros(len(fp), [("batch", np.int32), ("e", ENTRY)])
                    e["batch"], x = owner[i], e["e"]
                    x["fp"], x["cls"], x["doc"], x["key"], x["lo"], x["len"] = fp, cls, ids[i], key, lo, hi - lo
                    held.append(e)
    owner = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    return docs.select("doc_id", owner, "text").mapInArrow(scan, "batch int, range int, entries binary")


def _build(table: pa.Table) -> pa.Table:
    """A batch's index of one range: sorted entries; those whose fingerprint repeats inside it are found."""
    r = table.column("range")[0].as_py()
    e = _entries(table)
    fp = e["fp"]
    same = np.concatenate([[False], fp[1:] == fp[:-1]])
    again = same | np.append(same[1:], False)
    e["known"] = again
    return _packed(r, [e], e[again])


def _scan(merge: bool):
    """Merge-scan of a level's range and a batch's: what both hold is found on both sides."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r = (left if left.num_rows else right).column("range")[0].as_py()
        a, b = _entries(left), _entries(right)

        def among(x, y):
            at = np.searchsorted(y["fp"], x["fp"]) if len(y) else np.zeros(len(x), np.int64)
            at[at == len(y)] = 0
            return (y["fp"][at] == x["fp"]) if len(y) else np.zeros(len(x), bool)
        both_a, both_b = among(a, b), among(b, a)
        found = np.concatenate([a[both_a & (a["known"] == 0)], b[both_b & (b["known"] == 0)]])
        a["known"] |= both_a
        b["known"] |= both_b
        if merge:
            every = np.concatenate([a, b])
            return _packed(r, [every[np.argsort(every["fp"], kind="stable")]], found)
        return _packed(r, [], found)
    return run


class Family:
    """Levels of suffix indexes; level i holds 2^i batches."""

    def __init__(self):
        self.levels: list[DataFrame | None] = []
        self.found: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """``batch``: packed entries (range, entries) of new texts."""
        built = stash(batch.groupBy("range").applyInArrow(lambda t: _build(t), PACKED), "batch")
        self.found.append(built.where("range IS NULL"))
        new = built.where("range IS NOT NULL").select("range", "entries")
        # The levels that the carry will swallow are scanned as they merge; the others are scanned alone.
        carry = 0
        while carry < len(self.levels) and self.levels[carry] is not None:
            carry += 1
        fresh = new
        for i, level in enumerate(self.levels):
            if level is None:
                continue
            if i < carry and i == 0:
                merged = stash(self._against(level, fresh, True), "level")
            elif i < carry:
                # What the batch shares with this level is found against the carried level, which contains the batch.
                merged = stash(self._against(level, new, True), "level")
            else:
                merged = stash(self._against(level, fresh, False), "scan")
            self.found.append(merged.where("range IS NULL"))
            if i < carry:
                new = merged.where("range IS NOT NULL").select("range", "entries")
                self.levels[i] = None
        if carry == len(self.levels):
            self.levels.append(None)
        self.levels[carry] = new

    @staticmethod
    def _against(level: DataFrame, batch: DataFrame, merge: bool) -> DataFrame:
        run = _scan(merge)
        return (level.groupBy("range").cogroup(batch.groupBy("range"))
                .applyInArrow(lambda a, b: run(a, b), PACKED))


def _edges(docs: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc, key, start, end) of repeated windows of entries whose stretch is unlike all others."""
    alone = classes.groupBy("fp").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1 AND kinds > 1")
    shown = stash(classes.join(alone, "fp").select("fp", "kinds", F.col("n") > 1, "at.*")
                  .toDF("fp", "kinds", "whole", "doc", "key", "lo", "hi"), "shown")
    n = shown.count()
    parts = max(1, -(-n // PART_ROWS))
    # A document's entries travel as one list; they are as many as its own length allows.
    wanted = shown.groupBy("doc", "key").agg(F.collect_list(F.struct("fp", "kinds", "whole", "lo", "hi")).alias("places"))
    texts = only(docs.withColumnRenamed("doc_id", "doc"), shown.select("doc").distinct(), "doc")

    def cut(batches):
        for b in batches:
            rows = []
            for doc, key, text, places in zip(*[b.column(c).to_pylist() for c in ("doc", "key", "text", "places")], strict=True):
                data = text.encode()
                if text_key(data) != key:
                    continue
                for p in places:
                    rows.append((p["fp"], p["kinds"] > HOT_CLASSES, p["whole"], doc, key, p["lo"], data[p["lo"]:p["hi"] + LENGTH]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, (
                    pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["fp", "hot", "whole", "doc", "key", "lo", "stretch"])

    stretches = stash(texts.select("doc", "text").join(wanted, "doc").dropDuplicates(["doc", "key", "text"])
                      .mapInArrow(cut, "fp bigint, hot boolean, whole boolean, doc bigint, key bigint, lo bigint, stretch binary"),
                      "stretches")

    def hashed(table):
        stretch = table.column("stretch").to_pylist()
        hashes = [window_hashes(x) for x in stretch]
        sizes = np.array([len(h) for h in hashes], np.int64)
        row = np.repeat(np.arange(len(hashes)), sizes)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), row, offset

    def compare(table: pa.Table) -> pa.Table:
        h, row, offset = hashed(table)
        order = np.argsort(h)
        same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
        again = np.zeros(len(h), bool)
        again[order] = same | np.append(same[1:], False)
        again &= ~np.array(table.column("whole").to_pylist(), bool)[row]
        row, offset = row[again], offset[again]
        first = np.concatenate([[True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(row) else np.zeros(0, bool)
        last = np.append(first[1:], True) if len(row) else first
        lo = np.array(table.column("lo").to_pylist(), np.int64)
        pick = pa.array(row[first])
        return pa.table({"doc": table.column("doc").take(pick), "key": table.column("key").take(pick),
                         "start": pa.array(lo[row[first]] + offset[first]),
                         "end": pa.array(lo[row[last]] + offset[last] + LENGTH)})

    out = "doc bigint, key bigint, start bigint, end bigint"
    usual = (stretches.where("not hot").withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(parts)))
             .groupBy("part").applyInArrow(lambda t: compare(t.drop_columns(["part"])), out))

    def spread(batches):
        for b in batches:
            table = pa.Table.from_batches([b])
            h, row, offset = hashed(table)
            lo = np.array(table.column("lo").to_pylist(), np.int64)
            pick = pa.array(row)
            yield from pa.table({"hash": pa.array(h.view(np.int64)), "whole": table.column("whole").take(pick),
                                 "doc": table.column("doc").take(pick), "key": table.column("key").take(pick),
                                 "start": pa.array(lo[row] + offset)}).to_batches(max_chunksize=1 << 16)

    windows = stash(stretches.where("hot").mapInArrow(
        spread, "hash bigint, whole boolean, doc bigint, key bigint, start bigint"), "windows")
    twice = stash(windows.groupBy("hash").count().where("count > 1").select("hash"), "twice")
    hot = (windows.where("not whole").join(twice, "hash")
           .select("doc", "key", "start", (F.col("start") + LENGTH).alias("end")))
    return usual.unionByName(hot)


def _removal(batches):
    """Bytes that stay, for rows of doc, key, text, spans."""
    for b in batches:
        out: list[tuple] = []
        for doc, key, text, spans in zip(*[b.column(c).to_pylist() for c in ("doc", "key", "text", "spans")], strict=True):
            data = text.encode()
            if text_key(data) != key:
                continue
            runs: list[list[int]] = []
            for s, e in sorted((x["start"], x["end"]) for x in spans):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            kept, at = hashlib.sha256(), 0
            for s, e in runs:
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            out.append((doc, key, sum(e - s for s, e in runs), len(runs), kept.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5,
                                           (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
            names=["doc", "key", "n_removed", "n_spans", "sha"])


def repeated_passages(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc, key, start, end): stretches of bytes, overlapping, whose windows of ``LENGTH`` bytes occur elsewhere.

    ``docs`` has doc_id (not null) and text; ``key`` tells rows with one id apart.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, math.ceil(math.log2(total / RANGE_BYTES + 1)))
    index = stash(_index(docs, bits, batches), "index")
    family = Family()
    for i in range(batches):
        family.add(index.where(F.col("batch") == i).select("range", "entries"))
    found = family.found[0]
    for more in family.found[1:]:
        found = found.unionByName(more)
    # A level that was scanned without merging reports an entry again when a later batch has it too.
    found = stash(found.select(*_HIT_NAMES).distinct(), "found")
    # A stretch that occurs twice is repeated as a whole, copies within one text included.
    classes = stash(found.groupBy("fp", "cls").agg(F.count("*").alias("n"),
                                                   F.min(F.struct("doc", "key", "lo", "hi")).alias("at")), "classes")
    several = classes.where("n > 1").select("fp", "cls")
    whole = found.join(several, ["fp", "cls"], "left_semi").select(
        "doc", "key", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))
    return stash(whole.unionByName(_edges(docs, found, classes)), "repeats")


def remove(docs: DataFrame, id_column: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """``id_column``, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Texts are UTF-8 bytes, null is empty. Removed is every byte in a string of
    400 bytes that also starts anywhere else, the same text included. Shorter
    texts lose nothing. Rows that repeat an id are documents of their own; null
    ids are handled as any other. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    no_id = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(no_id)).alias("doc_id"), text_of(text).alias("text"))
    spans = repeated_passages(rows, batches).groupBy("doc", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = stash(spans, "spans")
    touched = (only(rows.withColumnRenamed("doc_id", "doc"), spans.select("doc").distinct(), "doc").join(spans, "doc")
               .withColumn("text_id", F.sha2("text", 256)))
    cut = stash(touched.dropDuplicates(["doc", "key", "text_id"]).select("doc", "key", "text", "spans")
                .mapInArrow(_removal, "doc bigint, key bigint, n_removed bigint, n_spans bigint, sha string"), "cut")

    def keyed(parts):
        for b in parts:
            data = [x.encode() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([text_key(x) for x in data], pa.int64()),
                 pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data])],
                names=["doc", "key", "n_bytes", "own"])

    plain = stash(rows.mapInArrow(keyed, "doc bigint, key bigint, n_bytes bigint, own string"), "plain")
    # Rows alike in id and text have the same places; each is repeated by the other as a whole.
    again = stash(plain.where(F.col("n_bytes") >= LENGTH).groupBy("doc", "key", "own").count().where("count > 1")
                  .select("doc", "key", "own", F.lit(True).alias("again")), "again")
    joined = plain.join(cut, ["doc", "key"], "left").join(again, ["doc", "key", "own"], "left")
    all_gone = F.coalesce("again", F.lit(False))
    return joined.select(
        F.when(F.col("doc") != no_id, F.col("doc")).alias(id_column), "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"))
