"""Mixing sources to target weights.

The words of a source lie on one line, document after document, cut into
blocks of a fixed length. Every output shard has a fixed number of slots and
draws how many of them each source fills (a multinomial, slot by slot from
keyed uniforms through an alias table). Running sums over the shards number a
source's slots; slot j takes block perm(j mod n) of its source, where perm is
a keyed affine permutation of the block numbers, another one in each round.
Blocks and slots meet in a join by (source, block).

Draws beyond a source's target are void and what a source still lacks is dealt
to closing shards, so that each source gets its target to within a block.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, prefix_sums, small_frame, stash, text_of

WEIGHTS = (5, 2, 1)        # fixed values: weights in source order, repeating
MAX_ROUNDS = 3             # a source is used at most so often
BLOCK_WORDS = 32
SHARD_SLOTS = 1024
ROWS_PER_CHUNK = 4096
SEED = 20_11


def source_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: int = MAX_ROUNDS) -> list[dict]:
    """Words to take from each source.

    Sources in code point order, null last, share the total by weight. A
    target stops at ``most`` times its source's size; the excess is shared by
    weight among the others, until none is above.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    rows = [{"src": i, "source": s, "source_size": n, "weight": weights[i % len(weights)], "target": 0.0}
            for i, (s, n) in enumerate(ordered)]
    left, free = float(sum(r["source_size"] for r in rows)), list(rows)
    while free:
        share = left / sum(r["weight"] for r in free)
        full = [r for r in free if r["weight"] * share > most * r["source_size"]]
        for r in full or free:
            r["target"] = float(most * r["source_size"]) if full else r["weight"] * share
        if not full:
            break
        left -= sum(r["target"] for r in full)
        free = [r for r in free if r not in full]
    return rows


def _keyed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big")


def affine(n: int, *key) -> tuple[int, int]:
    """(a, c) of the permutation x -> (a x + c) mod n; a * n stays below 2^62."""
    a = 1 + _keyed("a", *key) % max(1, min(n, (1 << 62) // max(n, 1)))
    while math.gcd(a, n) != 1:
        a += 1
    return a, _keyed("c", *key) % n


def alias_table(weights: list[float]) -> tuple[list[float], list[int]]:
    """Walker's table: column i keeps its own index with probability[i], else gives alias[i]."""
    n, total = len(weights), sum(weights)
    scaled = [w * n / total for w in weights]
    probability, alias = [1.0] * n, list(range(n))
    low, high = [i for i in range(n) if scaled[i] < 1], [i for i in range(n) if scaled[i] >= 1]
    while low and high:
        i, j = low.pop(), high.pop()
        probability[i], alias[i] = scaled[i], j
        scaled[j] -= 1 - scaled[i]
        (low if scaled[j] < 1 else high).append(j)
    return probability, alias


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def sized(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size in words, and ``copy``: a hash of the text, which orders rows that repeat an id."""
    body = text_of(text)
    return docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"),
                       F.regexp_count(body, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(body).alias("copy"))


class Mix:
    """``rows``: every document with its place; ``sources``: one row per source; ``slots``: shard, src, block."""

    def __init__(self, sizes: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS,
                 shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        spark = sizes.sparkSession
        self.block_words = block_words
        sizes = stash(sizes, "sizes")
        # One row per source, bounded by the number of weights that a user sets.
        per_source = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
        rows = {r["source"]: r["rows"] for r in per_source}
        self.sources = source_targets([(r["source"], r["n"]) for r in per_source], weights)
        for s in self.sources:
            s["blocks"] = -(-s["source_size"] // block_words)
            s["draws"] = min(MAX_ROUNDS * s["blocks"],
                             round(s["target"] * s["blocks"] / s["source_size"])) if s["blocks"] else 0
            s["chunks"] = 1 + rows[s["source"]] // ROWS_PER_CHUNK
            for e in range(MAX_ROUNDS):
                s[f"a{e}"], s[f"c{e}"] = affine(max(1, s["blocks"]), seed, s["source"], e)
        maps = ", ".join(f"a{e}: bigint, c{e}: bigint" for e in range(MAX_ROUNDS))
        self.table = small_frame(spark, self.sources, "src: bigint, source: string, source_size: bigint, target: double,"
                                 f" blocks: bigint, draws: bigint, chunks: bigint, {maps}")
        named = F.broadcast(self.table.select("src", F.col("source").alias("__source"), "source_size", "target", "chunks"))
        placed = (sizes.join(named, F.col("source").eqNullSafe(F.col("__source")))
                  .withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks"))))
        self.rows = stash(prefix_sums(placed, ["src"], "chunk", ["doc_id", "size", "copy"], "size",
                                      "start").drop("__source", "chunks", "chunk"), "places")
        self.slots = self._slots(spark, shard_slots, seed)

    def _slots(self, spark, shard_slots: int, seed: int) -> DataFrame:
        drawn_from = [s for s in self.sources if s["draws"]]
        total = sum(s["draws"] for s in drawn_from)
        if not total:
            return spark.range(0).selectExpr("id AS shard", "id AS src", "id AS block", "0L AS round")
        shards = -(-total // shard_slots)
        probability, alias = alias_table([s["draws"] for s in drawn_from])
        numbers = F.array(*[F.lit(s["src"]).cast("bigint") for s in drawn_from])
        n = len(drawn_from)
        column = F.floor(_uniform(F.lit(seed), F.col("id"), F.lit(1)) * n).cast("int")
        own = _uniform(F.lit(seed), F.col("id"), F.lit(2)) < F.get(F.array(*[F.lit(p) for p in probability]), column)
        other = F.get(F.array(*[F.lit(i) for i in alias]), column)
        counts = (spark.range(shards * shard_slots)
                  .select(F.expr(f"id div {shard_slots}").alias("shard"),
                          F.get(numbers, F.when(own, column).otherwise(other)).alias("src"))
                  .groupBy("shard", "src").agg(F.count("*").alias("n")))
        counts = stash(counts.withColumn("chunk", F.expr(f"shard div {ROWS_PER_CHUNK}")), "counts")
        table = F.broadcast(self.table)
        first = (prefix_sums(counts, ["src"], "chunk", ["shard"], "n", "first").join(table, "src")
                 .select("shard", "src", F.explode(F.expr("sequence(first, first + n - 1)")).alias("j"), "blocks", "draws",
                         *[f"{x}{e}" for e in range(MAX_ROUNDS) for x in "ac"])
                 .where("j < draws"))
        drawn = counts.groupBy("src").agg(F.sum("n").alias("n"))
        closing = (table.join(F.broadcast(drawn), "src", "left").withColumn("n", F.coalesce("n", F.lit(0)))
                   .where("n < draws").withColumn("j0", F.explode(F.expr(f"sequence(n, draws - 1, {shard_slots})")))
                   .select((F.lit(shards) + F.expr(f"j0 div {shard_slots}")).alias("shard"), "src",
                           F.explode(F.expr(f"sequence(j0, least(j0 + {shard_slots}, draws) - 1)")).alias("j"),
                           "blocks", "draws", *[f"{x}{e}" for e in range(MAX_ROUNDS) for x in "ac"]))
        turn = F.expr("j div blocks")
        block = F.lit(None).cast("bigint")
        for e in range(MAX_ROUNDS):
            block = F.when(turn == e, F.expr(f"(a{e} * (j % blocks) + c{e}) % blocks")).otherwise(block)
        return first.unionByName(closing).select("shard", "src", block.alias("block"), turn.alias("round"))

    def pieces(self) -> DataFrame:
        """(src, block) of every document with words: how the document's words lie in the block."""
        b = self.block_words
        return (self.rows.where("size > 0")
                .withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
                .withColumn("from_word", F.expr(f"greatest(start, block * {b}) - start"))
                .withColumn("n_words", F.expr(f"least(start + size, (block + 1) * {b}) - start") - F.col("from_word")))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: one row per document."""
        draws = self.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
        words = (self.pieces().select("src", "block", "start", "n_words").join(draws, ["src", "block"])
                 .groupBy("src", "start").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken")))
        # Documents without words share a start with another one; they take nothing.
        some = self.rows.where("size > 0").join(words, ["src", "start"], "left")
        none = self.rows.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
        columns = ["doc_id", "size", "source_size", "target"]
        return (some.select(*columns, F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
                .unionByName(none.select(*columns, "taken")))


def mix_report(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
               **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``.

    Null and blank texts have size 0 and are not taken. A null source is a
    source of its own, after the others. Rows that repeat an id are mixed each.
    A source without words gets target 0; an empty table an empty result.
    Other columns are not read.
    """
    return Mix(sized(docs, id_column, text, source), **options).taken()


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed corpus: one row per drawn piece of a document, with the columns of ``docs``.

    A piece is the part of a document that lies in a drawn block, white space
    after its words included, so that the pieces of a document join to its
    text. A document that lies in one block comes whole. ``n_chars``, if there
    is one, follows the piece.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (id_column, source)]
    keyed = docs.select(*[F.col(c) for c in docs.columns], name[0].alias("__id"), name[1].alias("__source"),
                        F.xxhash64(text_of(text)).alias("__copy"))
    plan = Mix(sized(docs, id_column, text, source), **options)
    own = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(k) for c, k in (("doc_id", "__id"), ("source", "__source"))]
    drawn = plan.pieces().join(plan.slots, ["src", "block"]).select(
        *own, F.col("copy").alias("__copy"), F.col("size").alias("__size"), F.col("from_word").alias("__from"),
        F.col("n_words").alias("__words"))
    # Rows alike in id, source and text have pieces each; one of them stands for all.
    if not plan.rows.groupBy("doc_id", "source", "copy").count().where("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(["__id", "__source", "__copy"])
    joined = keyed.join(drawn, ["__id", "__source", "__copy"])
    tokens = F.regexp_extract_all(F.col(text), F.lit(r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
                                                     r"|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    piece = F.array_join(F.slice(tokens, (F.col("__from") + 1).cast("int"), F.col("__words").cast("int")), "")
    cut = joined.withColumn(text, F.when(F.col("__words") == F.col("__size"), F.col(text)).otherwise(piece))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
