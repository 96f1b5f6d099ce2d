"""URL filters: a Bloom filter cascade, judged without joins.

Level 0 holds the listed keys. Over the corpus's complete key universe, the
unlisted keys that level 0 wrongly accepts are known; level 1 holds those.
Level 2 holds the listed keys that level 1 accepts, and so on until a level
accepts nothing wrong. A key of the universe is listed exactly if the first
level that rejects it is an odd one (or no level rejects it and the last is an
even one). Each level is a bit array built by an aggregation and read back in
an expression, so a page is judged by a few bit tests and no join.

A filter part never exceeds ``max_bits``: keys are dealt over as many parts as
that needs, by hash, and each part has its own cascade.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stash

# The contract's path rules, as (host and path, verdict).
PATH_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
              ("com/fr/", "allow"), ("com/de/", "block"))
# Host labels on the block list.
LISTED_LABELS = ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x")

MAX_BITS = 1 << 26        # of one filter part: 8 MB
BITS_PER_KEY = 8
HASHES = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def path_rule(host: Column, path: Column, rules=PATH_RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Of equally long rules the one first in code point order wins.
    """
    choice = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        row = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        choice = F.when(fits, row) if choice is None else choice.when(fits, row)
    return choice


@dataclass
class Level:
    bits: DataFrame      # one row, one column: array<bigint>, bit b in word b div 64
    size: int            # number of bits, a multiple of 64
    seed: int
    keys: int


def bit_positions(key: Column, size: int, seed: int, hashes: int = HASHES) -> list[Column]:
    """The bits of a key, by double hashing."""
    a = F.pmod(F.xxhash64(key, F.lit(2 * seed)), F.lit(size))
    b = F.pmod(F.xxhash64(key, F.lit(2 * seed + 1)), F.lit(size))
    return [F.pmod(a + F.lit(i) * b, F.lit(size)) for i in range(hashes)]


def bit_array(keys: DataFrame, key: str, size: int, seed: int, hashes: int = HASHES) -> DataFrame:
    """One row holding the filter of ``keys`` as an array of size / 64 longs."""
    spark = keys.sparkSession
    bit = F.explode(F.array(*bit_positions(F.col(key), size, seed, hashes))).alias("bit")
    word = F.expr("bit div 64").alias("word")
    ones = (keys.select(bit).select(word, F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask"))
            .groupBy("word").agg(F.bit_or("mask").alias("mask")))
    zeros = spark.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    dense = ones.unionByName(zeros).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return (dense.agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("words"))
            .select(F.transform("words", lambda x: x["mask"]).alias("bits")))


def hits(level: Level, key: Column) -> Column:
    """Whether the filter accepts the key."""
    bits = level.bits.scalar()
    found = None
    for position in bit_positions(key, level.size, level.seed):
        word = F.get(bits, F.floor(position / F.lit(64)).cast("int"))
        one = F.call_function("getbit", word, (position % 64).cast("int")) == 1
        found = one if found is None else found & one
    return found


class Cascade:
    """Exact membership of the universe's keys in the listed ones."""

    def __init__(self, parts: list[list[Level]]):
        self.parts = parts

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame, key: str = "key",
              bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> Cascade:
        """``universe`` and ``listed`` have a column ``key``; null keys are left out.

        Every key that will be judged has to be in the universe; listed keys
        that are not are ignored. An empty table makes an empty cascade. The
        parts follow from the listed keys or, if these are more, the unlisted
        ones that level 0 is expected to accept; they are doubled while any
        level would exceed ``max_bits`` (64 at least).
        """
        names = universe.select(key).where(F.col(key).isNotNull()).distinct()
        marks = listed.select(key).where(F.col(key).isNotNull()).distinct().withColumn("listed", F.lit(True))
        marked = stash(names.join(marks, key, "left")
                       .select(key, F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
        n_listed, n_all = marked.agg(F.count_if("listed"), F.count("*")).first()
        accepted = (n_all - n_listed) * (1 - math.exp(-HASHES / bits_per_key)) ** HASHES if n_listed else 0
        parts = max(1, math.ceil(max(n_listed, accepted) * bits_per_key / max_bits))
        while (made := cls._build_parts(marked, key, parts, bits_per_key, max_bits)) is None:
            parts *= 2
        return cls(made)

    @staticmethod
    def _build_parts(marked: DataFrame, key: str, parts: int, bits_per_key: int, max_bits: int) -> list[list[Level]] | None:
        """The levels of every part; None if one would exceed ``max_bits``."""
        marked = marked.withColumn("part", F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts)))
        made = []
        for part in range(parts):
            own = marked.where(F.col("part") == part)
            inside, outside = own.where("listed"), own.where("not listed")
            levels: list[Level] = []
            while n := inside.count():
                size = max(64, 64 * math.ceil(n * bits_per_key / 64))
                if size > max(64, max_bits):
                    return None
                bits = stash(bit_array(inside, key, size, len(levels)), "level")
                level = Level(bits, size, len(levels), n)
                levels.append(level)
                # The next level's table is written, so that its plan does not grow with the levels.
                inside, outside = stash(outside.where(hits(level, F.col(key))), "accepted"), inside
            made.append(levels)
        return made

    def listed(self, key: Column) -> Column:
        """True if the key (of the universe) is listed; null is not."""
        parts = F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(len(self.parts)))
        result = None
        for part, levels in enumerate(self.parts):
            answer = F.lit(len(levels) % 2 == 1)
            for i in range(len(levels) - 1, -1, -1):
                answer = F.when(~hits(levels[i], key), F.lit(i % 2 == 1)).otherwise(answer)
            result = F.when(parts == part, answer) if result is None else result.when(parts == part, answer)
        return F.when(key.isNull(), F.lit(False)).otherwise(result)


def judge_urls(pages: DataFrame, listed_labels=LISTED_LABELS, rules=PATH_RULES, url: str = "url",
               id_column: str = "page_id", blocked: DataFrame | None = None) -> DataFrame:
    """``id_column``, host, path, rule, verdict for every row of ``pages``.

    The block list is ``blocked``, a frame whose first column holds hosts (A-Z
    in any case, repeats and nulls allowed, hosts without a page ignored); without
    one it holds the hosts that have one of ``listed_labels`` as a label. A path rule decides first; else a listed host is blocked and any
    other allowed. Null URLs and URLs without ``://`` have an empty host and
    path, fit no rule, and are allowed. Repeated rows are judged each; other
    columns of ``pages`` are not carried, so their names cannot clash.
    """
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    universe = parsed.select(F.col("host").alias("key")).distinct()
    if blocked is None:
        listed = universe.where(F.arrays_overlap(F.split("key", r"\."), F.array(*[F.lit(x) for x in listed_labels])))
    else:
        hosts = blocked.select(F.translate(F.col(blocked.columns[0]), UPPER, LOWER).alias("key"))
        listed = universe.join(hosts, "key", "left_semi")
    cascade = Cascade.build(universe, listed)
    ruled = parsed.withColumn("__rule", path_rule(F.col("host"), F.col("path"), rules))
    method = F.when(cascade.listed(F.col("host")), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select(id_column, "host", "path", F.col("__rule.rule").alias("rule"),
                        F.coalesce(F.col("__rule.verdict"), method).alias("verdict"))


def oracle(rules=PATH_RULES, listed_labels=LISTED_LABELS) -> str:
    """The same verdicts by plain conditions, for DuckDB."""
    fits, verdicts = [], []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule_host, slash, rest = rule.partition("/")
        test = (f"((host = '{rule_host}' OR ends_with(host, '.{rule_host}')) "
                f"AND starts_with(path, '{slash}{rest}'))")
        fits.append(f"WHEN {test} THEN '{rule}'")
        verdicts.append(f"WHEN rule = '{rule}' THEN '{verdict}'")
    labels = ", ".join(f"'{x}'" for x in listed_labels)
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '{pattern}', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '{pattern}', 2), '') AS path
  FROM pages),
ruled AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM parsed)
SELECT page_id, host, path, rule,
       CASE {' '.join(verdicts)}
            WHEN list_has_any(string_split(host, '.'), [{labels}]) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
