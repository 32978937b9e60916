r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
text lies under the loss mask. Turns that follow the last assistant turn, or a conversation
without one, give one more row of kind `tail` with an empty mask, so that nothing is lost.

A turn is written as <|turn|>ROLE newline TEXT <|end|> newline. Texts are escaped reversibly: a
backslash is doubled, and the first character of any control string is followed by backslash and
dot, so that no control string of the template, or of another one, survives inside a text.

Scale: rows are dealt by conv_id and streamed in order through tasks; a task holds one
conversation's prefix and a few MB of output. Turns without a conv_id are dealt by their content,
so they don't meet in one task. The output grows with the square of a conversation's
length, as the method asks; memory doesn't."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this template and of other common ones (fixed values).
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\([\\.n])")
_READ = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
#: Characters of output that a task gathers before it passes them on.
FLUSH = 4_000_000


def escape(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _STARTS.sub(r"\1\\.", text) if any(c in text for c in CONTROL) else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", ".": "", "n": "\n"}[m[1]], text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, and what stands after it."""
    return f"{TURN}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text), f"{END}\n"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of an example."""
    return [(unescape(r), unescape(t)) for r, t in _READ.findall(formatted)]


def _expand(batches, schema: pa.Schema):
    conv: object = object()  # equals no conv_id
    rows: list[tuple] = []
    size, prefix, number, pending = 0, "", 0, False

    def flush():
        nonlocal rows, size
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        rows, size = [], 0
        return out

    for batch in batches:
        for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv or c is None:
                if pending:
                    rows.append((conv, number, "tail", prefix, len(prefix), len(prefix)))
                    size += len(prefix)
                conv, prefix, number, pending = c, "", 0, False
            if size > FLUSH or len(rows) >= 10_000:
                yield flush()
            before, body, after = render(role or "", text or "")
            start = len(prefix) + len(before)
            prefix += before + body + after
            pending = True
            if role == "assistant":
                rows.append((conv, number, "reply", prefix, start, start + len(body)))
                size += len(prefix)
                number, pending = number + 1, False
    if pending:
        rows.append((conv, number, "tail", prefix, len(prefix), len(prefix)))
    if rows:
        yield flush()


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, example, kind, text, loss_start, loss_end of turns (conv_id, turn, role, text).

    Examples are numbered from 0 within a conversation; the mask is [loss_start, loss_end) in
    code points of text. Turns are ordered by turn (null first), ties by role and text; rows that
    repeat are turns of their own. A null role or text is empty. A row without a conv_id belongs to
    no other, so each is a conversation of one turn. Very long texts are taken whole, an empty table
    gives an empty result. Other columns are not read. The rows of a conversation follow each other
    in order."""
    conv = turns.schema["conv_id"].dataType
    out = StructType([StructField("conv_id", conv), StructField("example", LongType()), StructField("kind", StringType()), StructField("text", StringType()), StructField("loss_start", LongType()), StructField("loss_end", LongType())])
    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _expand(batches, to_arrow_schema(out))

    return ordered.select("conv_id", "role", "text").mapInArrow(run, out)


DIGEST = (("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()))


def _digest(batches, conv_type: pa.DataType):
    schema = pa.schema([("conv_id", conv_type), *DIGEST])
    none = object()
    conv, last, loss, loss_chars, chars = none, "", hashlib.sha256(), 0, 0
    done: list[tuple] = []

    def end():
        turns = read_turns(last)
        h = hashlib.sha256()
        for role, text in turns:
            h.update(f"{role}\n{text}\n".encode())
        done.append((conv, len(turns), h.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for batch in batches:
        for c, text, start, stop in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv or c is None:
                if conv is not none:
                    end()
                conv, loss, loss_chars, chars = c, hashlib.sha256(), 0, 0
            last = text
            chars += len(text)
            target = unescape(text[start:stop])
            loss.update(target.encode())
            loss_chars += len(target)
        if len(done) > 5000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)
            done = []
    if conv is not none:
        end()
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)


def digest(examples: DataFrame) -> DataFrame:
    """For each conversation of expand()'s output, in its order: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, all read back from the formatted texts. Each example
    without a conv_id is a conversation."""
    conv = examples.schema["conv_id"].dataType
    out = StructType([StructField("conv_id", conv), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        yield from _digest(batches, to_arrow_type(conv))

    return examples.select("conv_id", "text", "loss_start", "loss_end").mapInArrow(run, out)


def probe(spark, like: DataFrame) -> DataFrame:
    """Conversation -1: two turns that hold control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return rows.select(*[F.col(c).cast(like.schema[c].dataType) for c in rows.columns])


ORACLE = r"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
grown AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
    + 2 * list_sum(list_transform(['<|', '|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
                                  lambda x: (length(text) - length(replace(text, x, ''))) // length(x)))
    + length(role) + 17 AS n FROM t),
run AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id, lone ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         turn = max(turn) OVER (PARTITION BY conv_id, lone) AS is_last FROM grown)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR is_last THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM run GROUP BY conv_id, lone
"""
