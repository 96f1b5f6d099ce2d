"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary is a public byte-fallback BPE model. A text gets a leading
space, spaces are the model's space symbol, and it is cut where no piece can
reach across: before a run of spaces and around line feeds. Within such a
chunk the agenda always takes the best-scored adjacent pair, leftmost first.
A candidate (symbol offset in the chunk, merged piece) is skipped for good if
a keyed hash of it falls below the dropout rate; the two symbols can still
merge with their other neighbours. The key is made of the seed, the document's
id, the chunk's ordinal in it and the chunk's text, so every occurrence draws
for itself and runs agree. Kept in a cache is what no draw can change: a
chunk's segmentation without a skip, and the merges that lead to it. Skipping
any other candidate changes nothing, as none is ever taken; so an occurrence
that skips none of these merges has that segmentation, and only the others run
the agenda.

Nothing is normalised, and characters without a piece become byte pieces, the
space symbol's own character among them, so every segmentation decodes to
exactly the text.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 7
CACHE_CHUNKS = 400_000         # chunks that a Python worker keeps before it starts anew
GROUP_CHARS = 1 << 20          # text that a Python worker holds cut up at a time
SLOT_BITS = 20
DRAWN, AGENDAS = 1 << 15, 1 << 13      # occurrences that draw, and that run their agendas, at a time
LONG_CHUNK = 48                # symbols; longer chunks have an agenda of their own

SPACE_PIECE = "▁"         # fixed value: the model's space symbol
_M64 = (1 << 64) - 1
_NONE = np.int64(1 << 62)


def load_vocabulary(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id; kind 0 normal, 1 byte, 2 control or unknown."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i),
             1 if m.is_byte(i) else 2 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else 0)
            for i in range(m.get_piece_size())]


def _mix(x):
    """splitmix64, for numpy arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix_int(x: int) -> int:
    """``_mix`` of one number."""
    x &= _M64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M64
    return x ^ (x >> 31)


def _spread(starts, lengths):
    """Places of the values of ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Cache:
    """By chunk what no draw can change: symbols, the pieces their pairs would make, ids and merges without a skip."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.values = {"sym": np.zeros(0, np.uint16), "first": np.zeros(0, np.int32), "ids": np.zeros(0, np.uint16),
                       "merges": np.zeros(0, np.uint32)}
        self.lengths = {k: np.zeros(0, np.int64) for k in self.values}
        self.starts = self.lengths.copy()

    def add(self, names: list[bytes], **made) -> None:
        """``made`` has flat values and their numbers by chunk."""
        self.index.update(zip(names, range(len(self.index), len(self.index) + len(names)), strict=True))
        for k, (values, lengths) in made.items():
            self.values[k] = np.concatenate([self.values[k], values.astype(self.values[k].dtype)])
            self.lengths[k] = np.concatenate([self.lengths[k], lengths])
            self.starts[k] = np.cumsum(self.lengths[k]) - self.lengths[k]

    def take(self, kind: str, at):
        lengths = self.lengths[kind][at]
        return self.values[kind][_spread(self.starts[kind][at], lengths)], lengths


class Codec:
    def __init__(self, vocabulary, dropout: float = DROPOUT, seed: int = SEED, cache_chunks: int = CACHE_CHUNKS):
        self.size, self.cache_chunks = len(vocabulary), cache_chunks
        self.caches = Cache()
        self.seed = np.uint64(int.from_bytes(hashlib.blake2b(repr(seed).encode(), digest_size=8).digest(), "big"))
        self.limit = np.uint64(min(_M64, int(dropout * 2.0 ** 64)))
        self.byte_id = np.zeros(256, np.int64)
        self.char_id = np.full(0x110000, -1, np.int32)
        self.piece_bytes = [b""] * self.size
        own: dict[str, int] = {}
        for i, (piece, _, kind) in enumerate(vocabulary):
            if kind == 1:
                value = int(piece[3:5], 16)
                self.byte_id[value], self.piece_bytes[i] = i, bytes([value])
            elif kind == 0:
                own[piece] = i
                self.piece_bytes[i] = piece.replace(SPACE_PIECE, " ").encode()
                if len(piece) == 1:
                    self.char_id[ord(piece)] = i
        self.char_id[ord(" ")], self.char_id[ord(SPACE_PIECE)] = self.char_id[ord(SPACE_PIECE)], -1
        rank = {s: r for r, s in enumerate(sorted({-s for _, s, _ in vocabulary}))}
        pairs = {own[p[:k]] * self.size + own[p[k:]]: i for p, i in own.items() for k in range(1, len(p))
                 if p[:k] in own and p[k:] in own}
        self.pairs = pairs
        self.rank = np.array([rank[-s] for _, s, _ in vocabulary], np.int64)
        order = sorted(pairs)
        self.pair_key, self.pair_id = np.array(order, np.int64), np.array([pairs[k] for k in order], np.int64)
        # A slot by hash names a pair of its own; pairs of a crowded slot are looked up in the sorted array.
        slots = self._slot(self.pair_key)
        self.pair_at = np.zeros(1 << SLOT_BITS, np.int32)
        self.pair_at[slots] = np.arange(len(order))
        self.crowded = np.bincount(slots, minlength=1 << SLOT_BITS) > 1

    # --- one chunk occurrence -> ids

    def keys(self, sums, places):
        """Keys of occurrences, from the crc32 of the chunk and the occurrence's place; arrays of uint64."""
        return _mix((places + sums * np.uint64(0x9E3779B97F4A7C15)) ^ self.seed)

    def key(self, chunk: str, place: int):
        return self.keys(np.uint64(zlib.crc32(chunk.encode())), np.uint64(place))

    def dropped(self, keys, starts, merged):
        """Whether the candidates are skipped; arrays of uint64."""
        return _mix(_mix(keys + starts * np.uint64(0xD1342543DE82EF95)) ^ merged * np.uint64(0xC2B2AE3D27D4EB4F)) < self.limit

    def symbols(self, chunk: str) -> list[int]:
        out: list[int] = []
        for c in chunk:
            i = self.char_id[ord(c)]
            out.extend([int(i)] if i >= 0 else [int(self.byte_id[b]) for b in c.encode()])
        return out

    def encode_long(self, chunk: str, key) -> np.ndarray:
        """The agenda with a heap; what ``encode_many`` does for many short chunks at once."""
        sym = self.symbols(chunk)
        n, key, limit = len(sym), int(key), int(self.limit)
        nxt, prv, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        agenda: list = []

        def offer(left: int):
            right = nxt[left]
            merged = self.pairs.get(sym[left] * self.size + sym[right]) if right < n else None
            if merged is not None and _mix_int(_mix_int(key + left * 0xD1342543DE82EF95) ^ (merged * 0xC2B2AE3D27D4EB4F & _M64)) >= limit:
                heapq.heappush(agenda, (int(self.rank[merged]), left, right, version[left], version[right], merged))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, left, right, a, b, merged = heapq.heappop(agenda)
            if version[left] != a or version[right] != b:
                continue
            sym[left] = merged
            version[left] += 1
            version[right] = -1
            nxt[left] = nxt[right]
            if nxt[right] < n:
                prv[nxt[right]] = left
                offer(left)
            if prv[left] >= 0:
                offer(prv[left])
        return np.array([sym[i] for i in range(n) if version[i] >= 0], np.uint16)

    @staticmethod
    def _slot(pairs):
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _candidates(self, sym, word, start, keys, at):
        """Rank and merged piece of the pairs (at, at + 1); _NONE if there is none or it is skipped."""
        left, right = sym[at], sym[at + 1]
        pair = left * self.size + right
        slot = self._slot(pair)
        found = self.pair_at[slot]
        again = np.flatnonzero(self.crowded[slot])
        found[again] = np.minimum(np.searchsorted(self.pair_key, pair[again]), len(self.pair_key) - 1)
        merged = self.pair_id[found]
        is_one = (self.pair_key[found] == pair) & (word[at] == word[at + 1])
        if keys is not None:
            drawn = np.flatnonzero(is_one)
            places = at[drawn]
            is_one[drawn] = ~self.dropped(keys[word[places]], start[places].astype(np.uint64), merged[drawn].astype(np.uint64))
        return np.where(is_one, (self.rank[merged] << 32), _NONE), merged

    def encode_many(self, chunks: list[str], places: list[int]) -> list[bytes]:
        """Ids of every chunk at its place, as the bytes of a uint16 array."""
        with np.errstate(over="ignore"):
            keys = self.keys(np.array([zlib.crc32(c.encode()) for c in chunks], np.uint64), np.array(places, np.uint64))
            sym, lengths = self._symbols(chunks)
            ids, counts = self._agendas(sym, lengths, self._pairs(sym, lengths), keys)[0]
        return [x.tobytes() for x in np.split(ids.astype(np.uint16), np.cumsum(counts)[:-1])]

    def _symbols(self, chunks: list[str]):
        """The symbols of all chunks in a row, and how many each has."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(c) for c in chunks], np.int64)
        sym = self.char_id[points].astype(np.int64)
        if (unknown := np.flatnonzero(sym < 0)).size:
            as_bytes = [chr(points[i]).encode() for i in unknown]
            times = np.ones(len(sym), np.int64)
            times[unknown] = [len(b) for b in as_bytes]
            ends = np.cumsum(times)
            sym, lengths = np.repeat(sym, times), np.add.reduceat(times, np.cumsum(lengths) - lengths)
            for i, b in zip(unknown, as_bytes, strict=True):
                sym[ends[i] - len(b):ends[i]] = self.byte_id[list(b)]
        return sym, lengths

    def _pairs(self, sym, lengths):
        """The piece that every symbol would make with the next one of its chunk, or -1."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        made = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            rank, merged = self._candidates(sym, word, None, None, np.arange(len(sym) - 1))
            made[:-1] = np.where(rank < _NONE, merged, -1)
        return made

    def _agendas(self, sym, lengths, first, keys):
        """Ids of chunks and the merges made, offset << 16 | piece; both flat, with their numbers by chunk.

        All chunks take one merge per round together. ``first`` is what ``_pairs`` gives. Without ``keys`` nothing is skipped.
        """
        n = len(lengths)
        word = np.repeat(np.arange(n), lengths)
        start = np.arange(len(sym)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        sym, merged = sym.astype(np.int64), first.astype(np.int64)
        rank = np.where(merged >= 0, self.rank[merged] << 32, _NONE)
        if keys is not None:
            drawn = np.flatnonzero(merged >= 0)
            rank[drawn[self.dropped(keys[word[drawn]], start[drawn].astype(np.uint64), merged[drawn].astype(np.uint64))]] = _NONE
        done_words, done_syms, merge_words, merges = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(sym):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            counts = np.diff(np.append(heads, len(sym)))
            best = np.minimum.reduceat(rank | np.arange(len(sym)), heads)
            going = best < _NONE
            if not going.all():       # chunks without a candidate are ready
                rest = np.repeat(going, counts)
                done_words.append(word[~rest])
                done_syms.append(sym[~rest])
                moved = np.cumsum(rest) - 1
                at = moved[best[going] & 0xFFFFFFFF]
                sym, word, start, rank, merged = (x[rest] for x in (sym, word, start, rank, merged))
                if not len(sym):
                    break
            else:
                at = best & 0xFFFFFFFF
            sym[at] = merged[at]
            if keys is None:
                merge_words.append(word[at])
                merges.append(start[at] << 16 | merged[at])
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            sym, word, start, rank, merged = (x[keep] for x in (sym, word, start, rank, merged))
            rank[at] = _NONE
            touched = np.concatenate([at, at[at > 0] - 1])
            touched = touched[touched < len(sym) - 1]
            if touched.size:
                rank[touched], merged[touched] = self._candidates(sym, word, start, keys, touched)
        out = []
        for words, values in ((done_words, done_syms), (merge_words, merges)):
            word = np.concatenate(words)
            out.append((np.concatenate(values)[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)))
        return out

    # --- texts

    def _cut(self, text: str):
        """Parts of at most about GROUP_CHARS, cut before a run of spaces; with whether it is the last one."""
        text, begin = " " + text, 0
        while len(text) - begin > GROUP_CHARS:
            at = text.rfind(" ", begin + 1, begin + GROUP_CHARS)
            while at > begin + 1 and text[at - 1] == " ":
                at -= 1
            if at <= begin + 1:
                break
            yield text[begin:at], False
            begin = at
        yield text[begin:], True

    def _look_up(self, names: list[bytes], cache: Cache):
        """Where the cache has every chunk; what is missing is made now. -1 for long chunks."""
        if len(cache.index) > self.cache_chunks:
            cache.clear()
        get = cache.index.get
        at = np.array([get(name, -1) for name in names], np.int64)
        strings = [(i, names[i].decode()) for i in np.flatnonzero(at < 0).tolist()]
        missing = [i for i, c in strings if len(c) <= LONG_CHUNK]
        if missing:
            sym, lengths = self._symbols([c for _, c in strings if len(c) <= LONG_CHUNK])
            first = self._pairs(sym, lengths)
            ids, merges = self._agendas(sym, lengths, first, None)
            at[missing] = np.arange(len(cache.index), len(cache.index) + len(missing))
            cache.add([names[i] for i in missing], sym=(sym, lengths), first=(first, lengths), ids=ids, merges=merges)
        return at

    def _skipping(self, at, keys, cache: Cache):
        """Which occurrences skip a merge that their chunk makes when nothing is skipped."""
        hit = np.zeros(len(at), bool)
        for a in range(0, len(at) if self.limit else 0, DRAWN):
            merges, times = cache.take("merges", at[a:a + DRAWN])
            merges = merges.astype(np.uint64)
            skip = self.dropped(np.repeat(keys[a:a + DRAWN], times), merges >> np.uint64(16), merges & np.uint64(0xFFFF))
            hit[a + np.searchsorted(np.cumsum(times), np.flatnonzero(skip), "right")] = True
        return hit

    def _encode_group(self, parts: list[bytes], bases: list[int], ordinals: list[int], cache: Cache):
        """The ids of every part, and how many chunks each has. A part's first chunk has its given ordinal."""
        text = b"".join(parts)
        raw = np.frombuffer(text, np.uint8)
        begins = np.cumsum([0] + [len(x) for x in parts[:-1]])
        space, line = raw == 32, raw == 10
        head = line.copy()
        head[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
        head[begins] = True
        heads = np.flatnonzero(head)
        cuts = np.append(heads, len(raw)).astype(np.int32)
        # Arrow's dictionary finds the distinct chunks without a Python string for each occurrence.
        coded = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(cuts), pa.py_buffer(text)]).dictionary_encode()
        firsts = np.searchsorted(heads, begins)
        counts = np.diff(np.append(firsts, len(heads)))
        names = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy().astype(np.int64)
        at = self._look_up(names, cache)[codes]
        sums = np.array([zlib.crc32(x) for x in names], np.uint64)
        with np.errstate(over="ignore"):
            places = (np.arange(len(heads)) - np.repeat(firsts - np.array(ordinals), counts)).astype(np.uint64)
            places = _mix(np.repeat(np.array(bases, np.uint64), counts) + places * np.uint64(0x9FB21C651E98DF25))
            keys = self.keys(sums[codes], places)
            usual = np.flatnonzero(at >= 0)
            skips = self._skipping(at[usual], keys[usual], cache)
            # Where a value begins in a row of all the made ones, and how long it is; the cache's come first.
            made, size = [cache.values["ids"]], len(cache.values["ids"])
            begin, times = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
            plain, rest = usual[~skips], usual[skips]
            begin[plain], times[plain] = cache.starts["ids"][at[plain]], cache.lengths["ids"][at[plain]]
            for a in range(0, len(rest), AGENDAS):
                part = rest[a:a + AGENDAS]
                ids, lengths = self._agendas(*cache.take("sym", at[part]), cache.take("first", at[part])[0], keys[part])[0]
                begin[part], times[part] = size + np.cumsum(lengths) - lengths, lengths
                made.append(ids.astype(np.uint16))
                size += len(ids)
        for i in np.flatnonzero(at < 0).tolist():
            made.append(self.encode_long(names[codes[i]].decode(), keys[i]))
            begin[i], times[i] = size, len(made[-1])
            size += len(made[-1])
        ids = np.concatenate(made)[_spread(begin, times)]
        return np.split(ids, (np.cumsum(times) - times)[firsts[1:]]), counts.tolist()

    def encode_texts(self, owners: list, texts: list[str], cache: Cache):
        """One uint16 array of ids per text; the empty text has none."""
        out: list = [[] for _ in texts]
        group: list = []
        size = 0

        def flush():
            made, counts = self._encode_group([p for _, p, _, _ in group], [b for _, _, b, _ in group],
                                              [o for _, _, _, o in group], cache)
            for (i, *_), ids in zip(group, made, strict=True):
                out[i].append(ids)
            group.clear()
            return counts[-1]

        for i, (owner, text) in enumerate(zip(owners, texts, strict=True)):
            base, ordinal = int.from_bytes(hashlib.blake2b(repr(owner).encode(), digest_size=8).digest(), "big"), 0
            for part, last in self._cut(text) if text else ():
                group.append((i, part.encode(), base, ordinal))
                size += len(part)
                if size > GROUP_CHARS or not last:      # the next part's ordinals follow on this one's
                    ordinal += flush()
                    size = 0
        if group:
            flush()
        return [np.concatenate(x) if x else np.zeros(0, np.uint16) for x in out]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.piece_bytes.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids)).decode()
        return raw[1:]


_CODECS: dict = {}


def _codec(shared, *options) -> Codec:
    key = (shared.id if hasattr(shared, "id") else id(shared), *options)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value, *options)
    return _CODECS[key]


def encode(docs: DataFrame, id_column: str = "doc_id", text: str = "text", model: str = MODEL,
           dropout: float = DROPOUT, seed: int = SEED, check: bool = True) -> DataFrame:
    """``id_column``, n_tokens, ids, text_sha256 for every document.

    ``text_sha256`` is the digest of the text decoded from ``ids`` (null if
    ``check`` is off). Null and empty texts have no ids. Rows that repeat an id
    and a text get the same ids. Other columns are not read. The model is read
    on the driver and reaches the executors as a broadcast of fixed size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(model))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        codec = _codec(shared, dropout, seed)
        cache = codec.caches            # lives as long as the Python worker, over its tasks
        for batch in batches:
            sizes = np.cumsum([0] + [len(x) if x else 0 for x in batch.column(1).to_pylist()]) // GROUP_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                owners = batch.column(0).slice(a, b - a)
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                ids = codec.encode_texts(owners.to_pylist(), texts, cache)
                offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                digests = [hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids] if check else [None] * len(ids)
                yield pa.RecordBatch.from_arrays(
                    [owners, pa.array(np.diff(offsets).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))),
                     pa.array(digests, pa.string())], names=[id_column, "n_tokens", "ids", "text_sha256"])

    return docs.select(id_column, text).mapInArrow(
        run, f"`{id_column}` {kind}, n_tokens bigint, ids array<int>, text_sha256 string")


def decode(tokens: DataFrame, id_column: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``id_column`` and the text of its ids; null ids give a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_vocabulary(model))
    kind = tokens.schema[id_column].dataType.simpleString()

    def run(batches):
        codec = _codec(shared, 0.0, 0)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return tokens.select(id_column, ids).mapInArrow(run, f"`{id_column}` {kind}, text string")
