"""Quality rules as a short-circuit cascade.

Each rule is a measure of the text and a limit. On a sample the cascade times
each rule's measure and counts what it rejects, then asks the rules in the
order of rejections per second. A CASE expression stops at the first rule that
rejects, so costly measures run only for texts that the cheap ones let pass.
The order changes the cost and which rule is named, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, stash, text_of

SYMBOLS = r"[#*$%&|<>]"        # fixed value
WINDOW = 8                      # words, for repeated passages
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_SYMBOLS_PER_100_WORDS = 50
MAX_DUP_LINES_PERCENT = 50
MIN_WORD_CHARS, MAX_WORD_CHARS = 2, 20      # mean
SAMPLE_ROWS = 1000              # bound of the sample that orders the rules; verdicts do not depend on it


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.regexp_replace(text, SPACE + "+", "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def n_repeat_words(text: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the text, the first occurrence included.

    Windows are compared by a 64-bit hash. Most texts repeat no window: a
    distinct count settles those, and only the others are sorted.
    """
    tokens = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    starts = lambda w: F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    windows = lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = lambda s: F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1))
        at = let(ordered, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))
        return let(at, lambda a: F.aggregate(
            F.transform(a, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(a, j + 1) - i, F.lit(WINDOW)))),
            F.lit(0).cast("bigint"), lambda total, n: total + n))

    def of(w: Column) -> Column:
        return (F.when(F.size(w) <= WINDOW, F.lit(0).cast("bigint"))
                .otherwise(let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h),
                                                            F.lit(0).cast("bigint")).otherwise(covered(h)))))
    return let(tokens, of)


MEASURES = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
            "n_repeat_words": n_repeat_words}


@dataclass
class Rule:
    """``rejects`` gets a function from measure names to columns."""
    name: str
    rejects: object
    base: bool = False


def n_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n")).cast("bigint")


RULES = (
    Rule("too_few_words", lambda m: m("n_words") < MIN_WORDS, base=True),
    Rule("repeats_itself", lambda m: 100 * m("n_repeat_words") > MAX_REPEAT_PERCENT * m("n_words"), base=True),
    Rule("symbols", lambda m: 100 * m("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > MAX_DUP_LINES_PERCENT * m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < MIN_WORD_CHARS * m("n_words"))
         | (m("word_chars") > MAX_WORD_CHARS * m("n_words"))),
)


def order_rules(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample of at most ``sample_rows`` rows."""
    # take() reads as few files as it needs; a limit inside a plan would gather rows from every partition.
    taken = docs.select(text_of(text).alias("__text")).take(sample_rows)
    sample = stash(docs.sparkSession.createDataFrame([(r[0],) for r in taken], "__text string"), "sample")
    measure = lambda name: {**MEASURES, "n_lines": n_lines}[name](F.col("__text"))
    sample.select(F.sum(F.length("__text"))).collect()       # the files are cached before the timing
    found = []
    for i, rule in enumerate(rules):
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(rule.rejects(measure))).first()[0]
        found.append((-(rejected / max(time.perf_counter() - began, 1e-6)), i, rule))
    return [rule for _, _, rule in sorted(found, key=lambda x: x[:2])]


def cascade(docs: DataFrame, rules=RULES, text: str = "text", measured: dict[str, Column] | None = None,
            out: str = "rejected_by") -> DataFrame:
    """``docs`` with a column ``out``: the first rule that rejects the text, or null.

    ``measured`` has columns for measures that are at hand already. Null texts
    count as empty and are rejected as too short. Empty tables give empty
    results; any other columns pass through, and ``out`` replaces one of its name.
    """
    measured = measured or {}
    own = {"n_lines": n_lines, **MEASURES}
    measure = lambda name: measured[name] if name in measured else own[name](text_of(text))
    verdict = None
    for rule in order_rules(docs, rules, text):
        test, name = F.coalesce(rule.rejects(measure), F.lit(False)), F.lit(rule.name)
        verdict = F.when(test, name) if verdict is None else verdict.when(test, name)
    return docs.withColumn(out, verdict)


def judge(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures and verdict of every document: id, the measures, base_failed, kept, rejected_by."""
    body = docs.select(F.col(id_column), text_of(text).alias("__text"))
    measures = body.select(id_column, "__text", *[f(F.col("__text")).alias(name) for name, f in MEASURES.items()])
    at_hand = {name: F.col(name) for name in MEASURES}
    judged = cascade(measures, text="__text", measured=at_hand)
    base_failed = None
    for rule in RULES:
        if rule.base:
            test = rule.rejects(at_hand.__getitem__)
            base_failed = test if base_failed is None else base_failed | test
    return judged.select(id_column, *MEASURES, base_failed.alias("base_failed"),
                         F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects."""
    return cascade(docs, text=text, out="__rejected_by").where("__rejected_by IS NULL").drop("__rejected_by")


def oracle() -> str:
    leads = " || ' ' || ".join(["word"] + [f"lead(word, {i}) OVER o" for i in range(1, WINDOW)])
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w FROM t),
tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
win AS (SELECT doc_id, i, {leads} AS g FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win
                               WHERE g IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM dup)
        GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.w) AS n_words,
             length(regexp_replace(text, '{SPACE}+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols,
             len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))
               - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}'))))
               AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= {MAX_SYMBOLS_PER_100_WORDS} * n_words
         AND 100 * n_dup_lines <= {MAX_DUP_LINES_PERCENT} * n_lines
         AND word_chars >= {MIN_WORD_CHARS} * n_words AND word_chars <= {MAX_WORD_CHARS} * n_words AS kept
FROM b"""
