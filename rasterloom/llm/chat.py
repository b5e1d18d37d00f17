"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, and only
its text is trainable. A conversation that doesn't end with an assistant turn has one more example
without a target, so that the output holds all its turns.

A turn is written ``### role: text</turn>`` and a newline. In roles and texts a backslash goes
before every backslash, ``#`` and ``<`` (in roles before ``:`` too), so the marks of the template
stand nowhere else, and taking the backslashes out again gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import table

TARGET = "assistant"
IN_TEXT, IN_ROLE = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]")
UNDO = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.DOTALL)


def escaped(text: str, marks: re.Pattern = IN_TEXT) -> str:
    return marks.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return UNDO.sub(r"\1", text)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted example; raises ValueError where the template is broken."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def examples_of(turns: list[tuple[str | None, str | None]]) -> Iterator[tuple[str, int, int, bool]]:
    """(text, start and end of the trainable part in code points, whether it is the last) of each example."""
    prefix = ""
    targets = [i for i, (role, _) in enumerate(turns) if role == TARGET]
    last = len(turns) - 1
    for i, (role, text) in enumerate(turns):
        prefix += f"### {escaped(role or '', IN_ROLE)}: "
        start = len(prefix)
        prefix += escaped(text or "")
        end = len(prefix)
        prefix += "</turn>\n"
        if role == TARGET:
            yield prefix, start, end, i == last
        elif i == last and (not targets or targets[-1] < last):
            yield prefix, end, end, True


def chat_examples(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv, example (from 0), text, loss_start, loss_end, last.

    Turns are in the order of ``turn``; ties are ordered by role and text, nulls first, and repeated
    rows are turns of their own. Null roles and texts are empty. Ids are integers; rows without one
    are one conversation. An empty table gives no rows; other columns are ignored.
    """
    col = lambda c: F.col(f"`{c}`")
    one = F.struct(col(turn).alias("turn"), col(role).alias("role"), col(text).alias("text"))
    convs = chats.groupBy(col(conv).alias("conv")).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["role"], x["text"])).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                conv_id, turns = batch.column(0)[i].as_py(), [tuple(t.values()) for t in batch.column(1)[i].as_py()]
                some: list[tuple] = []
                size = 0
                for n, e in enumerate(examples_of(turns)):
                    some.append((conv_id, n, *e))
                    size += len(e[0])
                    if size > 1 << 20:  # long conversations leave in parts
                        yield batch_of(some)
                        some, size = [], 0
                if some:
                    yield batch_of(some)

    return convs.mapInArrow(run, "conv long, example int, text string, loss_start long, loss_end long, last boolean").withColumnRenamed("conv", conv)


KINDS = [("conv", pa.int64()), ("example", pa.int32()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("last", pa.bool_())]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(KINDS)], names=[n for n, _ in KINDS])


def read_back(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per example, from its text and mask alone: conv, example, n_turns and turns_sha256 (of the last one), loss, chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, loss = [], [], []
            for r in batch.to_pylist():
                loss.append(unescaped(r["text"][r["loss_start"] : r["loss_end"]]))
                turns = read_turns(r["text"]) if r["last"] else None
                n.append(None if turns is None else len(turns))
                sha.append(None if turns is None else hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(loss, pa.string()), pa.array([len(t) for t in batch.column(2).to_pylist()], pa.int64())],
                names=["conv", "example", "n_turns", "turns_sha256", "loss", "chars"],
            )

    rows = examples.select(F.col(f"`{conv}`").alias("conv"), "example", "text", "loss_start", "loss_end", "last")
    return rows.mapInArrow(run, "conv long, example int, n_turns long, turns_sha256 string, loss string, chars long").withColumnRenamed("conv", conv)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = read_back(chat_examples(chats))
    all_ = back.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return all_.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, 14 + length(role) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS chars,
         max(turn) OVER (PARTITION BY conv_id) = turn AS at_end
  FROM c
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR at_end)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
