"""Chat formatting with a grammar that is checked by reading it back.

A turn is rendered as `### role: text</turn>` and a line break. A backslash makes the next character
plain. A deterministic parser reads every rendered turn again; if what it recovers differs from the
source (a control string or a backslash in the content), the content is escaped and the turn is
rendered again, until both are identical. Turns are self-delimiting, so a conversation is the
concatenation of its turns. Rendering and checking work row by row; the digests of a conversation
are folded over its turns in order from a sorted stream, which holds one turn at a time.

Cases: a null text or role is empty; turns with equal or null numbers are ordered nulls first, then
by role and text; repeated rows are separate turns; a null conv_id is a conversation of its own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import bounded, table

#: The control strings of the template.
OPEN, AFTER_ROLE, CLOSE, ESCAPE = "### ", ": ", "</turn>", "\\"

_special = re.compile(r"\\|###|: |</turn>", re.S)


class Broken(ValueError):
    """The text does not follow the grammar."""


def _field(text: str, at: int, stop: str) -> tuple[str, int]:
    """What stands before the first plain `stop`, unescaped, and where it goes on."""
    out = []
    while True:
        m = _special.search(text, at)
        if m is None:
            raise Broken(f"no {stop!r}")
        out.append(text[at : m.start()])
        if m[0] == ESCAPE:
            if m.end() == len(text):
                raise Broken("an escape at the end")
            out.append(text[m.end()])
            at = m.end() + 1
        elif m[0] == stop:
            return "".join(out), m.end()
        elif m[0] in ("###", CLOSE):
            raise Broken(f"a plain {m[0]!r} inside a field")
        else:
            out.append(m[0])
            at = m.end()


def parse_turns(text: str):
    """Yields (role, text, start, end): start and end bound the turn's escaped text in `text`."""
    at = 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise Broken(f"no turn at {at}")
        role, begin = _field(text, at + len(OPEN), AFTER_ROLE)
        said, end = _field(text, begin, CLOSE)
        if text[end : end + 1] != "\n":
            raise Broken(f"no line break at {end}")
        yield role, said, begin, end - len(CLOSE)
        at = end + 1


def _plain(text: str, level: int) -> str:
    """Level 0: as it is. Level 1: conflicting strings escaped. Level 2: every character that starts one."""
    if level == 1:
        text = text.replace("\\", "\\\\").replace("###", r"\#\#\#").replace(CLOSE, "\\" + CLOSE)
    elif level == 2:
        text = re.sub(r"([\\#<:])", r"\\\1", text)
    return text


def render_turn(role: str, text: str) -> str:
    for level in (0, 1, 2):
        piece = f"{OPEN}{_plain(role, level)}{AFTER_ROLE}{_plain(text, level)}{CLOSE}\n"
        try:
            if [x[:2] for x in parse_turns(piece)] == [(role, text)]:
                return piece
        except Broken:
            pass
    raise Broken("a turn cannot be rendered")


def _render(batches):
    for batch in batches:
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        pieces = [render_turn(r or "", t or "") for r, t in zip(roles, texts)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(pieces, pa.string()), batch.column("place"), pa.array([r or "" for r in roles], pa.string())], ["conv_id", "piece", "place", "role"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, place and role (they and the text order the turns), piece (its part of the formatted text)."""
    rows = bounded(conversations).select("conv_id", "role", "text", F.col("turn").alias("place"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_render, f"conv_id {kind['conv_id']}, piece string, place {kind['place']}, role string")


def _fold(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    done: list[tuple] = []
    state, key = None, None

    def close():
        if state is not None:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist()):
            if state is None or conv != key:
                close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse_turns(piece):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    state[2] += len(text)
                    state[3].update(text.encode())
            state[4] += len(piece)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in done], schema=_fold_schema(batch.schema.field("conv_id").type))
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in done], schema=_fold_schema(batch.schema.field("conv_id").type))


def _fold_schema(kind) -> pa.Schema:
    return pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted turns alone: counts and digests of its turns and of the text under the loss mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    # Of turns with one number the text decides as it reads without escapes and without what ends a turn.
    plain = F.regexp_replace("piece", r"(?s)\\(.)", "$1")
    said = F.substring(plain, F.lit(1), F.length(plain) - len(CLOSE) - 1)
    ordered = formatted.repartition("conv_id").withColumn("said", said).sortWithinPartitions("conv_id", "place", "role", "said").drop("said")
    return ordered.mapInArrow(_fold, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(rows.unionByName(more)))


QUERIES = {"op4_chat_format": op4_chat_format}

ORACLE_SQL = {
    "op4_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '\</turn>') AS safe FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(role) + length(safe))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
}
