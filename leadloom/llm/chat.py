"""Chat formatting by schema fingerprints.

A record is a JSON object. The nested field paths of a record are hashed to its fingerprint; scalar types do not matter, but it does
whether a field is one value, a list of parts, or now one and now the other. Fields that no mapping reads are left out with all
below them. The fingerprint picks a declarative mapping that turns the record into canonical turns (role, text). Turns are then written as
segments of one template: markers around role and text, control strings inside them escaped reversibly. A conversation is
the sequence of its segments, so one with very many turns is never put into one value.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings, of this template and of other common ones: an opening character, then one of these bodies.
CONTROL = r"(/?s>|/?INST\]|/?SYS>>|\|[^|<>\[\]]{1,32}\|>)"
ESCAPE, UNESCAPE = rf"([<\[])(\\*){CONTROL}", rf"([<\[])\\(\\*){CONTROL}"
#: Roles of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TYPES = r": (BIGINT|BINARY|BOOLEAN|DATE|DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT|STRING|TIMESTAMP|TIMESTAMP_NTZ|UUID|VOID)(?=[,>])"


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else F.coalesce(role, F.lit(""))
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _said(role: str, text: Column) -> Column:
    """A turn, or none if the field is absent."""
    return F.when(text.isNotNull(), _turn(role, text))


def _canonical(role: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(named[F.lower(role)], role)


def _parts(content: Column) -> Column:
    """Text of a variant: of a list the texts of its parts one after the other (a part without text, such as an image, gives none), of anything else its string."""
    plain = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    texts = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), plain(p), F.lit("")))
    return F.when(F.schema_of_variant(content).startswith("ARRAY"), F.array_join(texts, "")).otherwise(F.try_variant_get(content, "$", "string"))


#: Content of messages that is not one string in all of them.
MIXED = ([{"text": ""}], [{}], [""], ["", {"text": ""}], [{"text": ""}, {"text": [0]}])


def _lists(top: str, role: str, text: str) -> tuple[dict, ...]:
    """Examples: lists of parts, texts and lists in turn, texts and other values in turn."""
    said = [[{role: "", text: x}] for x in MIXED] + [[{role: "", text: ""}, {role: "", text: x}] for x in ([], 0)]
    return tuple({top: x} for x in said)


@dataclass(frozen=True)
class Mapping:
    """A layout: its fields (JSON by example, or several examples), which of them may be absent, the schema to read and the turns to make."""

    name: str
    example: dict | tuple[dict, ...]
    schema: str
    turns: Callable[[Column], Column]
    optional: tuple[str, ...] = field(default=())

    def examples(self) -> list[str]:
        gone = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        given = (self.example,) if isinstance(self.example, dict) else self.example
        return [json.dumps({k: v for k, v in e.items() if k not in g}) for e in given for g in gone]


#: Fields that a mapping may read; others do not belong to the layout, nor what is below them.
KNOWN = ("messages", "conversations", "turn", "role", "text", "content", "from", "value", "system", "prompt", "completion", "response", "instruction", "input", "output", "context", "question", "answer")
MAPPINGS = (
    Mapping("turn_row", {"turn": 0, "role": "", "text": ""}, "turn long, role string, text string", lambda r: F.array(_turn(r["role"], r["text"])), ("role", "text", "turn")),
    Mapping("messages", {"messages": [{"role": "", "content": ""}]}, "messages array<struct<role string, content string>>", lambda r: F.transform(r["messages"], lambda m: _turn(_canonical(m["role"]), m["content"]))),
    Mapping("from_value", {"conversations": [{"from": "", "value": ""}]}, "conversations array<struct<`from` string, value string>>", lambda r: F.transform(r["conversations"], lambda m: _turn(_canonical(m["from"]), m["value"]))),
    Mapping("messages_parts", _lists("messages", "role", "content"), "messages array<struct<role string, content variant>>", lambda r: F.transform(r["messages"], lambda m: _turn(_canonical(m["role"]), _parts(m["content"])))),
    Mapping("from_value_parts", _lists("conversations", "from", "value"), "conversations array<struct<`from` string, value variant>>", lambda r: F.transform(r["conversations"], lambda m: _turn(_canonical(m["from"]), _parts(m["value"])))),
    Mapping("prompt_completion", {"system": "", "prompt": "", "completion": ""}, "system string, prompt string, completion string", lambda r: F.array(_said("system", r["system"]), _turn("user", r["prompt"]), _turn("assistant", r["completion"])), ("system",)),
    Mapping("prompt_response", {"system": "", "prompt": "", "response": ""}, "system string, prompt string, response string", lambda r: F.array(_said("system", r["system"]), _turn("user", r["prompt"]), _turn("assistant", r["response"])), ("system",)),
    Mapping("instruction", {"system": "", "instruction": "", "input": "", "output": ""}, "system string, instruction string, input string, output string", lambda r: F.array(_said("system", r["system"]), _turn("user", F.concat_ws("\n\n", r["instruction"], F.nullif(r["input"], F.lit("")))), _turn("assistant", r["output"])), ("system", "input")),
    Mapping("question_answer", {"context": "", "question": "", "answer": ""}, "context string, question string, answer string", lambda r: F.array(_turn("user", F.concat_ws("\n\n", F.nullif(r["context"], F.lit("")), r["question"])), _turn("assistant", r["answer"])), ("context",)),
)


#: A JSON string: its first characters, then the rest.
STRING = r'(?s)("(?:[^"\\]|\\u[0-9a-fA-F]{4}|\\.){0,%d}+)(?:[^"\\]++|\\.)*+"'
#: Characters of each string that the layout is read from; field names must not be longer.
HEAD = 64
#: JSON strings of any length, as Spark's own limit is lower than a long text.
JSON = {"maxStringLen": str((1 << 31) - 1)}


def _nested(depth: int) -> str:
    """What stands between a bracket and the one that closes it, with others inside."""
    return "[^<>]*+" if depth == 0 else rf"(?:[^<>]++|<{_nested(depth - 1)}>)*+"


#: A field, with its type, that no mapping reads; objects and lists in it to a depth of twelve.
UNREAD = rf"(?<=<|, )(?!(?:{'|'.join(KNOWN)})(?:[,>]|: ))[^<>,:]+(?:: (?:VARIANT|(?:ARRAY|OBJECT)<{_nested(12)}>))?(?=[,>])"


def layout(record: Column) -> Column:
    """The nested field paths of a JSON record, sorted, in one string; null if it is no JSON.

    Strings are cut to their first ``HEAD`` characters before the record is parsed, as paths do not need the rest and a
    parsed value has a limit of size. Fields that no mapping knows are left out with what is below them, so they do not change
    the layout. Elements of a list are taken together; where one has a value and another a list or object in the same field,
    the field is marked as mixed.
    """
    paths = F.regexp_replace(F.schema_of_variant(F.try_parse_json(F.regexp_replace(record, STRING % HEAD, '$1"'))), TYPES, "")
    known = F.regexp_replace(paths, UNREAD, "")
    known = F.regexp_replace(known, r"(?:, ?)+(?=[,>])|(?<=<)(?:, ?)+", "")
    return F.when(known == "OBJECT<>", paths).otherwise(known)


def fingerprint(record: Column) -> Column:
    return F.xxhash64(layout(record))


def canonical_turns(records: DataFrame, record: str, turn: str | None = None, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """One row per turn: the columns of ``records`` but the record, then ``fingerprint, mapping, turn, role, text``.

    ``turn`` names a column with the number of a record's first turn (0 if not given or null). Null texts become empty. A
    record that no mapping fits, is null or is not JSON gives one row with null mapping, role and text. Repeated records
    give repeated turns. Columns that clash with the new ones are replaced.
    """
    first = F.coalesce(F.col(turn).cast("long"), F.lit(0)) if turn else F.lit(0)
    keep = [c for c in records.columns if c not in (record, "fingerprint", "mapping", "turn", "role", "text")]
    rows = records.select(*keep, first.alias("__first"), F.col(record).alias("__record"), fingerprint(F.col(record)).alias("fingerprint"))
    name = turns = None
    for m in mappings:
        fits = F.col("fingerprint").isin(*[fingerprint(F.lit(x)) for x in m.examples()])
        made = F.filter(m.turns(F.from_json("__record", m.schema, JSON)), lambda t: t.isNotNull())
        name = F.when(fits, m.name) if name is None else name.when(fits, m.name)
        turns = F.when(fits, made) if turns is None else turns.when(fits, made)
    rows = rows.select(*keep, "__first", "fingerprint", name.alias("mapping"), turns.alias("__turns"))
    rows = rows.select(*keep, "__first", "fingerprint", "mapping", F.posexplode_outer("__turns").alias("__at", "__turn"))
    return rows.select(*keep, "fingerprint", "mapping", (F.col("__first") + F.coalesce("__at", F.lit(0))).alias("turn"), F.col("__turn.role").alias("role"), F.col("__turn.text").alias("text"))


def escaped(text: Column) -> Column:
    """A backslash after the opening character of every control string; those that have some get one more."""
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """``turns`` with ``segment`` for role and text, and the loss mask ``loss_start, loss_chars`` (code points of the segment).

    A row without role, which is a record that no mapping fits, stays with a null segment and no loss.
    """
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    rows = turns.withColumns({"__role": role, "__text": text})
    rows = rows.withColumn("segment", F.concat(F.lit(TURN), "__role", F.lit(TEXT), "__text", F.lit(END + "\n")))
    own = F.col("role") == trained
    start = F.length("__role") + len(TURN) + len(TEXT)
    return rows.withColumns({"loss_start": F.when(own, start).cast("long"), "loss_chars": F.when(own, F.length("__text")).otherwise(0).cast("long")}).drop("role", "text", "__role", "__text")


def read_back(segments: DataFrame) -> DataFrame:
    """Role, text and loss text of each segment, from the segment and its mask alone."""
    parts = F.split("segment", r"<\|(?:turn|text|end)\|>")
    loss = F.when(F.col("loss_start").isNotNull(), F.expr("substring(segment, cast(loss_start + 1 as int), cast(loss_chars as int))"))
    return segments.withColumns({"role": unescaped(F.get(parts, F.lit(1))), "text": unescaped(F.get(parts, F.lit(2))), "loss": unescaped(loss)})


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_unmapped long"


def digests(read: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation the digests of what was read back.

    A digest follows its input in order, so a conversation's turns meet in one task; they pass as a sorted stream of which
    only the running digest is held. Turns with equal numbers are ordered by role and text. Records that no mapping fits are counted in
    ``n_unmapped`` and are no turns, so a conversation of nothing else is still there, with none.
    """
    kind = dict(read.dtypes)[key]
    names = [key, *(x.split()[0] for x in DIGEST.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out() -> pa.RecordBatch:
            n, turns, chars, loss, written, unmapped = state
            return pa.RecordBatch.from_arrays([pa.array([now], schema[0].type), *(pa.array([x]) for x in (n, turns.hexdigest(), chars, loss.hexdigest(), written, unmapped))], names)

        for batch in batches:
            schema = batch.schema
            for k, role, text, loss, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or k != now:
                    if state is not None:
                        yield out()
                    now, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if size is None:
                    state[5] += 1
                    continue
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += size
        if state is not None:
            yield out()

    rows = read.select(key, "turn", "role", "text", "loss", F.length("segment").cast("long").alias("size")).repartition(key).sortWithinPartitions(key, "turn", "role", "text")
    return rows.select(key, "role", "text", "loss", "size").mapInArrow(run, f"{key} {kind}, {DIGEST}")


#: Conversation -1 of the query: a user and an assistant who both say what other templates use as control strings.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("turn", "role", "text")).alias("record"))
    probe = json.dumps({"messages": [{"role": r, "content": PROBE} for r in ("user", "assistant")]})
    rows = rows.union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.lit(probe)))
    return digests(read_back(formatted(canonical_turns(rows, "record", "turn"))))


_SQL_ESCAPE = f"regexp_replace(%s, '{ESCAPE}', '\\1\\\\\\2\\3', 'g')"
ORACLE_1 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN + TEXT + END) + 1} + length({_SQL_ESCAPE % "role"}) + length({_SQL_ESCAPE % "text"})) AS BIGINT) AS formatted_chars,
  0::BIGINT AS n_unmapped
FROM t GROUP BY conv_id
"""
