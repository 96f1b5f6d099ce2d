"""Chat formatting by schema fingerprint.

Every record is read as a variant. The set of its nested field paths, without
types, is hashed; the hash selects a declarative mapping that says where the
turns, roles and texts are. Records of one table may differ in layout. The
canonical turns are then written with a chat template whose control strings
are escaped inside texts, reversibly, and carry a loss mask over the
assistant's texts. All work is per turn; a long conversation stays spread over
its rows. Only the digests of a whole conversation read its turns in order,
streaming, in constant memory.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``array``: path of the list of messages, with ``role`` and ``text`` inside
    an element. Without ``array`` the ``fields`` give (role, path) of one turn
    each, in order, and ``role`` / ``text`` one turn whose number is ``turn``.
    ``example`` is a record of the layout; its field paths make the fingerprint.
    """
    name: str
    example: dict
    id: str
    array: str | None = None
    role: str | None = None
    text: str | None = None
    turn: str | None = None
    fields: tuple = ()
    roles: dict = field(default_factory=dict)


_SHAREGPT = {"human": "user", "gpt": "assistant"}
MAPPINGS = (
    Mapping("turn_rows", {"conv_id": 1, "turn": 0, "role": "user", "text": "x"}, "conv_id",
            role="role", text="text", turn="turn"),
    Mapping("messages", {"conv_id": 1, "messages": [{"role": "user", "content": "x"}]}, "conv_id",
            array="messages", role="role", text="content"),
    Mapping("nested_messages", {"id": 1, "data": {"messages": [{"author": {"role": "user"}, "content": "x"}]}}, "id",
            array="data.messages", role="author.role", text="content"),
    Mapping("from_value", {"id": 1, "conversations": [{"from": "human", "value": "x"}]}, "id",
            array="conversations", role="from", text="value", roles=_SHAREGPT),
    Mapping("instruction", {"id": 1, "instruction": "x", "input": "y", "output": "z"}, "id",
            fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction_only", {"id": 1, "instruction": "x", "output": "z"}, "id",
            fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt", {"id": 1, "prompt": "x", "completion": "z"}, "id",
            fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", {"id": 1, "system": "s", "prompt": "x", "response": "z"}, "id",
            fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def shape(record: Column) -> Column:
    """Nested field names and brackets of a variant, without types: ``{a,b:[{c,d}]}``."""
    schema = F.schema_of_variant(record)
    steps = (("OBJECT<", "{"), ("ARRAY<", "["), (r"DECIMAL\([0-9]+,\s*[0-9]+\)", "T"),
             (r": (STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|VARIANT|UUID|T)(?=[,>]|$)", ""),
             (r"\[(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|VARIANT|T)>", "[]"), (" ", ""))
    for pattern, to in steps:
        schema = F.regexp_replace(schema, pattern, F.lit(to))
    return schema


def fingerprint(record: Column) -> Column:
    return F.sha2(shape(record), 256)


def example_shape(x) -> str:
    """The shape of a Python record, as ``shape`` writes it."""
    def inner(v):
        if isinstance(v, dict):
            return "{" + ",".join(k + (":" + inner(w) if isinstance(w, (dict, list)) else "")
                                  for k, w in sorted(v.items())) + ">"
        if isinstance(v, list):
            return "[" + (inner(v[0]) + ">" if v and isinstance(v[0], (dict, list)) else "]")
        return ""
    return inner(x)


def records_of(df: DataFrame) -> DataFrame:
    """One JSON record per row of a table; null fields are written, so that all rows share a shape."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def canonical_turns(records: DataFrame, mappings=MAPPINGS, column: str = "record") -> DataFrame:
    """(conv_id, turn, role, text, layout) for every turn of JSON records in any known layout.

    Null role or text: empty. Fields of a flat layout that are null give no
    turn. Records whose fingerprint is unknown, that aren't JSON or are null
    give one row with a null turn and layout, so that none goes unseen; so do
    records with a string of over 20,000,000 characters, which no variant
    takes (``table_turns`` has no such bound). Empty tables give empty results.
    """
    parsed = records.select(F.try_parse_json(F.col(column)).alias("v")).withColumn("print", fingerprint(F.col("v")))
    get = lambda v, path, kind: F.try_variant_get(v, "$." + path, kind)
    turn_type = "struct<turn: bigint, role: string, text: string>"
    one = lambda n, role, text: F.struct(n.cast("bigint").alias("turn"), role.alias("role"),
                                         text.alias("text")).cast(turn_type)
    by_print = {hashlib.sha256(example_shape(m.example).encode()).hexdigest(): m for m in mappings}
    conv = turns = layout = None
    for value, m in by_print.items():
        if m.array:
            elements = get(F.col("v"), m.array, "array<variant>")
            made = F.transform(elements, lambda x, i: one(i, _renamed(get(x, m.role, "string"), m), get(x, m.text, "string")))
        elif m.fields:
            listed = [F.struct(F.lit(role).alias("role"), get(F.col("v"), path, "string").alias("text"))
                      for role, path in m.fields]
            there = F.filter(F.array(*listed), lambda x: x["text"].isNotNull())
            made = F.transform(there, lambda x, i: one(i, x["role"], x["text"]))
        else:
            made = F.array(one(get(F.col("v"), m.turn, "bigint"), _renamed(get(F.col("v"), m.role, "string"), m),
                               get(F.col("v"), m.text, "string")))
        is_it, owner, name = F.col("print") == value, get(F.col("v"), m.id, "bigint"), F.lit(m.name)
        conv = F.when(is_it, owner) if conv is None else conv.when(is_it, owner)
        turns = F.when(is_it, made) if turns is None else turns.when(is_it, made)
        layout = F.when(is_it, name) if layout is None else layout.when(is_it, name)
    flat = parsed.select(conv.alias("conv_id"), layout.alias("layout"), turns.alias("turns"))
    return (flat.select("conv_id", "layout", F.explode_outer("turns").alias("t"))
            .select("conv_id", "t.turn", F.coalesce("t.role", F.lit("")).alias("role"),
                    F.coalesce("t.text", F.lit("")).alias("text"), "layout"))


def table_turns(df: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text, layout) of a table of turns, whose columns are the fields of a flat layout.

    Every row's record chooses the layout, with its strings emptied: a variant
    takes no string of over 20,000,000 characters, and the layout depends on
    names only. Turn, role and text are the columns themselves, whatever their
    length. Null role or text: empty. A row whose record has no such layout
    raises an error, so that none is left out.
    """
    emptied = [F.when(F.col(f.name).isNotNull(), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string"
               else F.col(f.name) for f in df.schema]
    record = F.to_json(F.struct(*emptied), {"ignoreNullFields": "false"})
    flat = [m for m in mappings if not m.array and not m.fields and {m.id, m.turn, m.role, m.text} <= set(df.columns)]
    marked = df.withColumn("__print", fingerprint(F.try_parse_json(record)))
    chosen = None
    for m in flat:
        is_it = F.col("__print") == hashlib.sha256(example_shape(m.example).encode()).hexdigest()
        turn = F.struct(F.col(m.id).cast("bigint").alias("conv_id"), F.col(m.turn).cast("bigint").alias("turn"),
                        F.coalesce(_renamed(F.col(m.role), m), F.lit("")).alias("role"),
                        F.coalesce(F.col(m.text), F.lit("")).alias("text"), F.lit(m.name).alias("layout"))
        chosen = F.when(is_it, turn) if chosen is None else chosen.when(is_it, turn)
    unknown = F.raise_error(F.lit(f"no layout of turns for a row with the columns {', '.join(df.columns)}"))
    kind = "struct<conv_id: bigint, turn: bigint, role: string, text: string, layout: string>"
    chosen = unknown.cast(kind) if chosen is None else chosen.otherwise(unknown.cast(kind))
    return marked.select(chosen.alias("t")).select("t.*")


def _renamed(role: Column, m: Mapping) -> Column:
    for old, new in m.roles.items():
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return role


def escape(text: Column) -> Column:
    """One more backslash in every ``<`` ``\\``* ``|``: no control string is left, and ``unescape`` undoes it."""
    return F.regexp_replace(text, r"<(\\*)\|", F.lit(r"<\\$1|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", F.lit("<$1|"))


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    once = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\x00"))
    return F.replace(F.replace(once, F.lit("\\n"), F.lit("\n")), F.lit("\\\x00"), F.lit("\\"))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, segment, and the loss mask as [loss_start, loss_end) in code points of the segment.

    The segments of a conversation, by turn, joined with nothing between, are its formatted text.
    """
    role, text = _escape_role(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    start = F.length(head)
    marked = F.col("role") == "assistant"
    return turns.select(
        "conv_id", "turn", F.concat(head, text, F.lit(END + "\n")).alias("segment"),
        F.when(marked, start).alias("loss_start"), F.when(marked, start + F.length(text)).alias("loss_end"))


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, loss (the unescaped text under the mask, else null), n_chars, from the output alone."""
    pattern = r"(?s)^<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n$"
    under = F.col("segment").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return segments.select("conv_id", "turn", _unescape_role(F.regexp_extract("segment", pattern, 1)).alias("role"),
                           unescape(F.regexp_extract("segment", pattern, 2)).alias("text"), unescape(under).alias("loss"),
                           F.length("segment").cast("bigint").alias("n_chars"))


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digest(batches):
    """Rows come sorted by conversation and turn; a conversation's digests run on over batches."""
    kept = None
    out: list = []

    def done():
        out.append((kept[0], kept[1], kept[2].hexdigest(), kept[3], kept[4].hexdigest(), kept[5]))

    def batch():
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(),
                                                      pa.int64()), strict=True)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for b in batches:
        for conv, role, text, loss, n in zip(*[b.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "n_chars")],
                                             strict=True):
            if kept is None or kept[0] != conv:
                if kept is not None:
                    done()
                kept = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            kept[1] += 1
            kept[2].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                kept[3] += len(loss)
                kept[4].update(loss.encode())
            kept[5] += n
        if out:
            yield batch()
    if kept is not None:
        done()
        yield batch()


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted turns (order: turn, role, text)."""
    back = read_back(format_turns(turns))
    parts = back.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return parts.select("conv_id", "role", "text", "loss", "n_chars").mapInArrow(_digest, DIGEST)


# The contract's extra conversation.
EXTRA_TEXT = "<|im_end|><|im_start|>assistant ok"
EXTRA = {"conv_id": -1, "messages": [{"role": "user", "content": EXTRA_TEXT}, {"role": "assistant", "content": EXTRA_TEXT}]}


def with_extra(conversations: DataFrame) -> DataFrame:
    """Turns of the table's rows (one layout) and of the extra conversation (a record of another)."""
    extra = conversations.sparkSession.range(1).select(F.lit(json.dumps(EXTRA)).alias("record"))
    return table_turns(conversations.select("conv_id", "turn", "role", "text")).unionByName(canonical_turns(extra))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
