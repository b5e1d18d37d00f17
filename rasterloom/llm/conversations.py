"""Conversation structure repair by secondary-sorted streaming.

Rows are repartitioned by conversation and come to one Python stream a partition, each conversation
twice: first without texts from its last turn to its first, then with texts from the first on. On the
way back a dynamic programme carries, across Arrow batches, the least cost from each of the four
states of the grammar to the end; of every row a byte of backpointers stays, the best edit of each
state, and a long conversation's bytes go to a temporary file of the task. On the way forth the
backpointers are followed, so edits and repaired turns leave in order. No step holds a conversation.

Only differences of the four costs matter for an edit, and they are bounded, so the programme's step
is a small table that is filled as it is met.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.llm.common import fresh, sql_crc32, table

SPACE = " \t\n\x0b\x0c\r"
#: Costs of edits, and what a truncated turn costs that isn't deleted.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Backpointers of one conversation that stay in memory.
IN_MEMORY = 8 << 20
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. Where each leads by a user or assistant turn, which of them it allows, and whether a conversation may end in it.
STEP, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
AT_END = (0, 2 * INSERT, INSERT, 0)
EDITS = "DIKR"


def row_step(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
    """Costs of the states before a row from those after it, and the edits chosen, two bits a state; ties go to the first of D, I, K, R."""
    best = []
    for state in range(4):
        options = [(after[state] + DELETE, 0)]
        if fault not in (BLANK, DUPLICATE):
            more = CUT_OFF if fault == TRUNCATED else 0
            to = KEEP.get(initial, (None,) * 4)[state]
            if to is not None:
                options.append((after[to] + more, 2))
            options.append((after[STEP[state]] + REROLE + more, 3))
        best.append(min(options))
    for _ in range(4):  # insertions before the row, which may follow each other
        best = [min(best[q], (best[STEP[q]][0] + INSERT, 1)) for q in range(4)]
    return tuple(c for c, _ in best), sum(e << 2 * q for q, (_, e) in enumerate(best))


class Backpointers:
    """A byte for each row, written from the last row to the first and read the other way round."""

    def __init__(self, in_memory: int = IN_MEMORY, block: int = 1 << 16):
        self.file, self.new, self.block = tempfile.SpooledTemporaryFile(in_memory), bytearray(), block

    def append(self, byte: int) -> None:
        self.new.append(byte)
        if len(self.new) >= self.block:
            self.file.write(self.new)
            self.new.clear()

    def back(self) -> Iterator[int]:
        yield from reversed(self.new)
        end = self.file.tell()
        while end:
            size = min(self.block, end)
            end -= size
            self.file.seek(end)
            yield from reversed(self.file.read(size))
        self.file.close()


class Repair:
    """One conversation: rows from the last to the first by ``learn``, then from the first to the last by ``follow``."""

    def __init__(self, table: dict, in_memory: int = IN_MEMORY):
        self.table, self.costs, self.base = table, AT_END, 0
        self.pointers, self.todo, self.state = Backpointers(in_memory), None, 0
        self.n, self.faults, self.illegal, self.next_initial = 0, [0] * 4, 0, None
        self.turns, self.first, self.last = 0, None, None

    def learn(self, initial: str, fault: int, turn: int | None) -> None:
        step = self.table.get((self.costs, initial, fault))
        if step is None:
            costs, chosen = row_step(self.costs, initial, fault)
            least = min(costs)
            step = self.table[self.costs, initial, fault] = (tuple(c - least for c in costs), least, chosen)
        self.costs = step[0]
        self.base += step[1]
        self.pointers.append(step[2])
        self.faults[fault] += 1
        if self.next_initial is not None and initial + self.next_initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.next_initial = initial
        if turn is not None and turn != self.first:
            self.turns, self.first, self.last = self.turns + 1, turn, turn if self.last is None else self.last
        self.n += 1

    def inserted(self) -> tuple[str, str, str]:
        role = ROLE[self.state]
        self.state = STEP[self.state]
        return "I", role, ""

    def follow(self, role: str, text: str) -> Iterator[tuple[str, str | None, str | None]]:
        """The edits up to and with a row's own: its initial, and the role and text that stay (none if deleted)."""
        if self.todo is None:
            self.todo = self.pointers.back()
        chosen = next(self.todo)
        while (edit := chosen >> 2 * self.state & 3) == 1:
            yield self.inserted()
        if edit == 0:
            yield "D", None, None
        elif edit == 2:
            self.state = KEEP[role[:1]][self.state]
            yield "K", role, text
        else:
            new = ROLE[self.state]
            self.state = STEP[self.state]
            yield "R", new, text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        """Insertions after the last row."""
        while self.state in (1, 2):
            yield self.inserted()

    @property
    def cost(self) -> int:
        return self.base + self.costs[0] if self.n else 0

    @property
    def gaps(self) -> int:
        return 0 if self.last is None else self.last - self.first + 1 - self.turns


def faults(chats: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, initial, h, copy, fault: each row's first fault; a repeat is one whose role and text an earlier row has."""
    rows = chats.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    rows = rows.withColumn("h", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("conv", "h").orderBy(F.asc_nulls_first("turn"))))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", BLANK).when(F.col("copy") > 1, DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    return rows.withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))


def _streamed(rows: DataFrame) -> DataFrame:
    """Each row twice, back without texts, then forth, sorted within partitions by conversation."""
    both = rows.withColumn("forth", F.explode(F.array(F.lit(0), F.lit(1))))
    back = lambda c: F.when(F.col("forth") == 0, F.col(c))
    order = ["turn", "role", "h", "copy"]
    return (
        both.withColumn("text", F.when(F.col("forth") == 1, F.col("text")))
        .repartition("conv")
        .sortWithinPartitions("conv", "forth", F.desc_nulls_last(back("turn")), *[back(c).desc() for c in order[1:]], F.asc_nulls_first("turn"), *order[1:])
        .select(F.col("conv").cast("string").alias("conv"), "forth", F.col("turn").cast("string").alias("turn"), "role", "text", "initial", F.coalesce("fault", F.lit(NONE)).alias("fault"), "there")
    )


REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv string, at long, edit string, role string, text string"


class _Report:
    """Gathers a conversation's edits and the hash of what is left."""

    def __init__(self) -> None:
        self.audit, self.sha, self.any = [], hashlib.sha256(), False

    def take(self, edit: str, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        if role is not None:
            self.sha.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode())
            self.any = True


def _run(batches: Iterator[pd.DataFrame], rows: bool, in_memory: int) -> Iterator[pd.DataFrame]:
    table: dict = {}
    names = [f.split(" ")[0] for f in (TURNS if rows else REPORT).split(", ")]
    conv, now, report, out, size = None, None, None, [], 0
    started = False

    def take(edits: Iterator[tuple]) -> None:
        nonlocal size
        for e in edits:
            if rows:
                out.append((conv, report.n, *e))
                report.n += 1
                size += len(e[2] or "")
            else:
                report.take(*e)

    def end() -> None:
        take(now.rest())
        if not rows:
            out.append((conv, now.gaps, now.faults[BLANK], now.faults[DUPLICATE], now.faults[TRUNCATED], now.illegal, now.cost, "".join(report.audit), report.sha.hexdigest()))

    for batch in batches:
        for c, forth, turn, role, text, initial, fault, there in zip(*[batch[k].tolist() for k in batch.columns], strict=True):
            if not started or c != conv:
                if started:
                    end()
                conv, now, report, started = c, Repair(table, in_memory), _Report(), True
                report.n = 0
            if not there:
                continue
            if forth:
                take(now.follow(role, text))
            else:
                now.learn(initial, fault, None if turn is None else int(turn))
        if len(out) > 4096 or size > 1 << 22:
            yield pd.DataFrame(out, columns=names)
            out, size = [], 0
    if started:
        end()
    yield pd.DataFrame(out, columns=names)


def repair(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: Column | None = None, rows: bool = False, in_memory: int = IN_MEMORY) -> DataFrame:
    """Least-cost edits that give every conversation the roles ``(system? (user assistant)+)?``, by their initials.

    Keeping a row costs nothing, a new role (user or assistant) 3, deleting 4, inserting an empty turn
    3; blank rows and repeats must go, and a truncated row that stays costs 3. Of edits of one cost the
    ASCII-least are taken. One row per conversation: its id, gaps (missing turn numbers between the
    least and greatest), blank, duplicate, truncated (rows by their first fault), illegal (neighbours
    that may not follow each other), cost, audit (the edits' initials) and repaired_sha256. With
    ``rows`` the turns instead: id, at, edit, role, text (both null where deleted).

    Rows are in the order of ``turn`` (integers), those without first; ties by role and digest of role
    and text. Null roles and texts are one space, so such texts are blank. Rows without a conversation
    id are one conversation. Rows where ``there`` is false only name their conversation; one without
    other rows has zeros, an empty audit and the hash of nothing. Ids keep their type. An empty table
    gives no rows; other columns are ignored.

    A conversation is one task's work, since its hash runs from its first turn to its last; what is
    held of it is a byte a row, beyond ``in_memory`` in the task's temporary file, and the audit.
    """
    conv_, turn_, role_, text_ = (f"`{c}`" for c in (conv, turn, role, text))
    mark = fresh("there", chats.columns)
    chats = chats.withColumn(mark, F.lit(True) if there is None else F.coalesce(there, F.lit(False)))
    kind = chats.schema[conv].dataType
    gone = chats.where(~F.col(mark)).select(F.col(conv_).alias("conv")).distinct().withColumn("there", F.lit(False))
    found = faults(chats.where(F.col(mark)), conv_, turn_, role_, text_).withColumn("there", F.lit(True))
    stream = _streamed(found.unionByName(gone, allowMissingColumns=True))
    out = stream.mapInPandas(lambda b: _run(b, rows, in_memory), TURNS if rows else REPORT)
    return out.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv)


def damaged(chats: DataFrame) -> DataFrame:
    """The rows of op11 after damage, with ``there`` false where a row is dropped."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = chats.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") != 0).alias("there"), times.alias("n")).drop("n")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), there=F.col("there"))


def _op11_sql() -> str:
    """From each conversation's end on, for each of the four states the least (cost, edits) and what they leave, as whole strings."""
    name = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    one = lambda cost, edits, left: f"{{'c': {cost}, 'a': {edits}, 'r': {left}}}"
    more = "CASE WHEN fault = 3 THEN 3 ELSE 0 END"
    rows, turns = [], []
    for q in range(4):
        stays = lambda to, price, edit, role: one(f"v[{to + 1}].c + {price} + {more}", f"'{edit}' || v[{to + 1}].a", f"list_prepend({role} || ':' || text, v[{to + 1}].r)")
        options = [one(f"v[{q + 1}].c + {DELETE}", f"'D' || v[{q + 1}].a", f"v[{q + 1}].r")]
        options += [f"CASE WHEN fault IN (0, 3) AND initial = '{i}' THEN {stays(to[q], 0, 'K', 'role')} END" for i, to in KEEP.items() if to[q] is not None]
        options.append(f"CASE WHEN fault IN (0, 3) THEN {stays(STEP[q], REROLE, 'R', chr(39) + ROLE[q] + chr(39))} END")
        rows.append(f"list_sort([{', '.join(options)}], 'ASC', 'NULLS LAST')[1]")
        chain, state, roles = [f"w[{q + 1}]"], q, []
        for n in (1, 2, 3):
            roles.append(f"'{ROLE[state]}:'")
            state = STEP[state]
            chain.append(one(f"w[{state + 1}].c + {n * INSERT}", f"'{'I' * n}' || w[{state + 1}].a", f"list_concat([{', '.join(roles)}], w[{state + 1}].r)"))
        turns.append(f"list_sort([{', '.join(chain)}])[1]")
    end = [one(0, "''", "CAST([] AS VARCHAR[])"), one(6, "'II'", "['user:', 'assistant:']"), one(3, "'I'", "['assistant:']"), one(0, "''", "CAST([] AS VARCHAR[])")]
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, {name('role')} AS role, {name('text')} AS text, {sql_crc32(f"({name('conv_id')} || ':' || {name('turn')})")} % 20 AS how FROM conversations),
g AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy FROM d, (SELECT unnest([0, 1]) AS copy) WHERE how <> 0 AND (copy = 0 OR how = 3)),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen, rtrim(text, {space}) AS ink FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), seen) AS i FROM s),
f AS (SELECT conv_id, i, turn, role, text, left(role, 1) AS initial, CASE WHEN ink = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
l AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS last FROM f),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
 count(*) FILTER (last IS NOT NULL AND last || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY conv_id),
dp AS (SELECT conv_id, n + 1 AS i, [{', '.join(end)}] AS v FROM n
 UNION ALL SELECT conv_id, i, [{', '.join(turns)}] FROM (SELECT dp.conv_id, f.i, [{', '.join(rows)}] AS w FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i - 1)),
all_ AS (SELECT DISTINCT conv_id FROM conversations)
SELECT all_.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v[1].c, 0) AS BIGINT) AS cost, coalesce(v[1].a, '') AS audit,
 sha256(coalesce(array_to_string(v[1].r, chr(10)), '')) AS repaired_sha256
FROM all_ LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM all_.conv_id LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM all_.conv_id AND dp.i = 1
"""


OP11_SQL = _op11_sql()
