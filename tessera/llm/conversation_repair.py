"""Operator 13, conversation structure repair: cheapest edits that make turns alternate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, bounded_batches, materialize, ship

#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. What an inserted or reroled turn becomes, and the state it leads to.
NEXT_ROLE, NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: What keeping a turn with this initial leads to, by state.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Cost to go at the end of a conversation: insertions that complete a pair.
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = ("su", "ua", "au")
#: Live turns and characters of text at which a chunk is closed.
CHUNK_TURNS, CHUNK_CHARS = 512, 1 << 20
NEVER = 1 << 60

RESULT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
#: A run of turns of one conversation: its place, what its counts need at either end, its live turns and the deletions before each and after the last.
CHUNK = {"at_turn": "long", "at_role": "string", "at_mark": "binary", "rows": "long", "low": "long", "high": "long", "turns": "long", "blank": "long", "duplicate": "long", "truncated": "long",
         "illegal": "long", "first": "string", "last": "string", "classes": "string", "dead": "array<long>", "roles": "array<string>", "texts": "array<string>"}


def _relaxed(base: list[int]) -> tuple[int, ...]:
    """Cost to go with insertions allowed; two lead from any state through all that may follow."""
    one = [min(base[q], INSERT + base[NEXT[q]]) for q in range(4)]
    return tuple(min(one[q], INSERT + one[NEXT[q]]) for q in range(4))


def _options(kind: str, q: int, after: tuple[int, ...]) -> Iterator[tuple[str, int, int]]:
    """(edit, cost to go, next state) of the edits that consume a live turn, ASCII-least first. Upper-case kinds are truncated."""
    stays = CUT_OFF if kind.isupper() else 0
    yield "D", DELETE + after[q], q
    kept = KEPT[q].get(kind.lower())
    if kept is not None:
        yield "K", stays + after[kept], kept
    yield "R", stays + REROLE + after[NEXT[q]], NEXT[q]


@lru_cache(256)
def costs_to_go(classes: str, end: tuple[int, ...]) -> tuple[tuple[int, ...], ...]:
    """The backward pass: cost to go by turn and state, with ``end`` behind the last turn."""
    out = [end]
    for kind in reversed(classes):
        out.append(_relaxed([min(c for _, c, _ in _options(kind, q, out[-1])) for q in range(4)]))
    return tuple(reversed(out))


@lru_cache(8192)
def walk(classes: str, end: tuple[int, ...], state: int) -> tuple[tuple[str, ...], int]:
    """The forward pass: for each live turn its edits (insertions before it, then its own), the ASCII-least of those that cost no more; and the last state."""
    table, out = costs_to_go(classes, end), []
    for kind, here, after in zip(classes, table, table[1:]):
        edits = ""
        while True:
            tight = [(e, s) for e, c, s in _options(kind, state, after) if c == here[state]]
            if INSERT + here[NEXT[state]] == here[state]:
                tight.append(("I", NEXT[state]))
            edit, state = min(tight)
            edits += edit
            if edit != "I":
                break
        out.append(edits)
    return tuple(out), state


class Chunk:
    """Gathers sorted turns of one conversation until they are enough."""

    def __init__(self, conv_id, turn, role, mark):
        self.conv_id, self.chars = conv_id, 0
        self.row = {"at_turn": turn, "at_role": role, "at_mark": mark, "rows": 0, "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0,
                    "illegal": 0, "first": None, "last": None, "classes": "", "dead": [0], "roles": [], "texts": []}

    def add(self, turn, role: str, count: int, blank: bool, live: tuple[str, bool] | None) -> None:
        """``count`` equal rows at one place; ``live`` is the text and whether it is truncated where the first of them is neither blank nor seen before."""
        if not count:
            return
        r, initial = self.row, role[:1]
        r["illegal"] += (r["last"] is not None and r["last"] + initial not in LEGAL) + count - 1
        r["first"], r["last"] = initial if r["first"] is None else r["first"], initial
        r["rows"] += count
        if turn is not None:
            r["turns"] += turn != r["high"]
            r["low"], r["high"] = turn if r["low"] is None else r["low"], turn
        if blank:
            r["blank"] += count
            r["dead"][-1] += count
            return
        r["duplicate"] += count - (live is not None)
        if live is None:
            r["dead"][-1] += count
            return
        text, truncated = live
        kind = initial if initial and initial in "sua" else "o"
        r["truncated"] += truncated
        r["classes"] += kind.upper() if truncated else kind
        r["roles"].append(role)
        r["texts"].append(text)
        r["dead"].append(count - 1)
        self.chars += len(text) + len(role)

    def full(self, turns: int) -> bool:
        return len(self.row["texts"]) >= turns or self.chars >= CHUNK_CHARS


class Conversation:
    """Joins the chunks of one conversation in order, each with the cost to go behind it; memory is that of a chunk and the audit."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.audit, self.lines, self.sha = conv_id, 0, [], 0, hashlib.sha256()
        self.low = self.high = self.last = None
        self.sums = dict.fromkeys(("rows", "turns", "blank", "duplicate", "truncated", "illegal", "cost"), 0)

    def _line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def _edit(self, edits: str) -> None:
        self.audit.append(edits)
        self.sums["cost"] += INSERT * edits.count("I") + DELETE * edits.count("D") + REROLE * edits.count("R")

    def add(self, c: dict, end: tuple[int, ...]) -> None:
        for k in ("rows", "turns", "blank", "duplicate", "truncated", "illegal"):
            self.sums[k] += c[k]
        if c["rows"]:
            self.sums["illegal"] += self.last is not None and self.last + c["first"] not in LEGAL
            self.last = c["last"]
        if c["low"] is not None:
            self.sums["turns"] -= self.high == c["low"]
            self.low, self.high = c["low"] if self.low is None else self.low, c["high"]
        self._edit("D" * c["dead"][0])
        state, (edits, self.state) = self.state, walk(c["classes"], end, self.state)
        for kind, edit, role, text, dead in zip(c["classes"], edits, c["roles"], c["texts"], c["dead"][1:], strict=True):
            self._edit(edit + "D" * dead)
            for e in edit:
                if e == "K":
                    self._line(role, text)
                    state = KEPT[state][kind.lower()]
                elif e != "D":
                    self._line(NEXT_ROLE[state], "" if e == "I" else text)
                    state = NEXT[state]
            self.sums["cost"] += CUT_OFF * (kind.isupper() and edit[-1] != "D")

    def result(self) -> dict:
        while END[self.state]:
            self._edit("I")
            self._line(NEXT_ROLE[self.state], "")
            self.state = NEXT[self.state]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
        return {"conv_id": self.conv_id, "gaps": gaps, **{k: self.sums[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")}, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def damaged(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n): the rows as damaged, ``n`` of each; dropped rows stay with n = 0, so that no conversation is lost."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    code = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    rows = convs.select(conv.alias("conv_id"), turn.cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), code.alias("code"))
    kept = F.col("code") != 0
    return rows.select(
        "conv_id",
        F.when(kept, F.col("turn")).alias("turn"),
        F.when(~kept, "").when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") <= 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(~kept, 0).when(F.col("code") == 3, 2).otherwise(1).alias("n"),
    )


def _bare(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def placed_turns(rows: DataFrame) -> DataFrame:
    """Turns sorted by conversation and place over range partitions: a count of equal rows, then, if it is live, the turn itself.

    Live turns are those neither blank nor seen before. One aggregate by role
    and text finds them with their first turn; another counts the rows of each
    place (conversation, turn, role, digest of the text). Both combine on the
    map side, so that equal rows, however many, are one. Sorting by range cuts a
    long conversation over as many partitions as it fills.
    """
    mark = F.unhex(F.md5(F.col("text").cast("binary")))
    no_turn = F.max(F.col("turn").isNull())
    live = rows.where((F.col("n") > 0) & (_bare(F.col("text")) != "")).groupBy("conv_id", "role", "text").agg(F.when(~no_turn, F.min("turn")).alias("turn"))
    cut_off = ~F.substring(_bare(F.col("text")), -1, 1).isin(".", "!", "?")
    live = live.select("conv_id", "turn", "role", mark.alias("mark"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), cut_off.alias("flag"), "text")
    counts = rows.select("conv_id", "turn", "role", mark.alias("mark"), (_bare(F.col("text")) == "").alias("flag"), "n").groupBy("conv_id", "turn", "role", "mark", "flag").agg(F.sum("n").alias("n"))
    counts = counts.select("conv_id", "turn", "role", "mark", F.lit(0).alias("kind"), "n", "flag", F.lit(None).cast("string").alias("text"))
    place = ["conv_id", "turn", "role", "mark"]
    return counts.unionByName(live).repartitionByRange(*place).sortWithinPartitions(*place, "kind")


def _chunks(batches: Iterable[pa.RecordBatch], chunk_turns: int) -> Iterator[tuple[Chunk, bool]]:
    """Chunks of sorted turns, each with whether it begins a conversation of this partition."""
    chunk, pending, begins = None, None, True
    for batch in batches:
        for conv, turn, role, mark, kind, n, flag, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "mark", "kind", "n", "flag", "text"))):
            if kind:
                chunk.add(*pending, (text, flag))
                pending = None
                continue
            if pending:
                chunk.add(*pending, None)
            pending = (turn, role, n, flag)
            if chunk is None or chunk.conv_id != conv or chunk.full(chunk_turns):
                if chunk is not None:
                    yield chunk, begins
                begins = chunk is None or chunk.conv_id != conv
                chunk = Chunk(conv, turn, role, mark)
    if chunk is not None:
        if pending:
            chunk.add(*pending, None)
        yield chunk, begins


def _batches(rows: Iterable[dict], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    some = []
    for r in rows:
        some.append(r)
        if len(some) == most:
            yield pa.RecordBatch.from_pylist(some, schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def repair_conversations(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Damage conversations by a checksum of their keys, count the faults and repair their structure at the least cost.

    For every conversation: gaps, blank, duplicate, truncated, illegal, cost,
    audit (the cheapest edits, of equals the ASCII-least) and the digest of the
    repaired turns. The method is a dynamic program over turns and the four
    states of the grammar: costs to go backward, then a walk forward that takes
    the least edit among those that cost no more.

    Turns are sorted over range partitions and cut into chunks of at most
    ``chunk_turns`` live turns. A conversation that lies within one chunk and one partition is
    repaired where it lies. Others are joined from their chunks: costs to go
    are passed backward over the chunks' classes alone, then the chunks are
    walked in order. Blank and duplicate turns must go whatever the state, so
    they are runs of deletions between live turns. SHA-256 is sequential: the
    texts of one such conversation pass through one task as a stream of chunks,
    of which one is held at a time.

    Rows of equal turn are ordered by role, then by the text's digest; turns
    are whole numbers, null ones first. Null roles and texts are one space, as
    are nulls within the damage's key; rows of null id are one conversation.
    Repeated rows count each. Conversations that lose all rows have zeros, an
    empty audit and the digest of nothing; an empty table stays empty. Other
    columns are left out.
    """
    spark = convs.sparkSession
    ship(spark)
    turns = placed_turns(damaged(convs, conv_col, turn_col, role_col, text_col))
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    fields = {"conv_id": conv_type, **{k: t for k, t in RESULT.items() if k not in CHUNK}, "gaps": "long", **CHUNK}
    ddl = lambda f: ", ".join(f"`{k}` {t}" for k, t in f.items())
    ends = {"conv_id": conv_type, **{k: CHUNK[k] for k in ("at_turn", "at_role", "at_mark")}, "end": "array<long>"}

    def arrow(f: dict) -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        return to_arrow_schema(_parse_datatype_string(ddl(f)))

    whole, exits, results = arrow(fields), arrow(ends), arrow({"conv_id": conv_type, **RESULT})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, place = [], 0  # the chunk before, whether it began its conversation, and that one's place in the partition
            for chunk, begins in _chunks(batches, chunk_turns):
                if held:
                    yield close(*held, inner=place > 1 and begins)
                place += begins
                held = [chunk, begins]
            if held:
                yield close(*held, inner=False)

        def close(chunk: Chunk, begun: bool, inner: bool) -> dict:
            if not (begun and inner):
                return {"conv_id": chunk.conv_id, **chunk.row}
            conversation = Conversation(chunk.conv_id)
            conversation.add(chunk.row, END)
            return conversation.result()

        yield from _batches(rows(), whole)

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            conv, end, started = None, END, False
            for batch in batches:
                for r in batch.to_pylist():
                    if not started or r["conv_id"] != conv:
                        conv, end, started = r["conv_id"], END, True
                    yield {**{k: r[k] for k in ends if k != "end"}, "end": end}
                    end = costs_to_go(r["classes"], end)[0]

        yield from _batches(rows(), exits)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            conversation = end = None
            for batch in batches:
                for i in range(batch.num_rows):
                    r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                    if r["end"] is not None:
                        end = tuple(r["end"])
                        continue
                    if conversation is None or r["conv_id"] != conversation.conv_id:
                        if conversation is not None:
                            yield conversation.result()
                        conversation = Conversation(r["conv_id"])
                    conversation.add(r, end)
            if conversation is not None:
                yield conversation.result()

        yield from _batches(rows(), results)

    with bounded_batches(spark):
        pieces = materialize(turns.mapInArrow(cut, ddl(fields)), "conversations")
        chunks = pieces.where("rows IS NOT NULL")
        place = ["at_turn", "at_role", "at_mark"]
        last_first = [F.col("conv_id"), *[F.col(c).desc() for c in place]]
        tail = chunks.select("conv_id", *place, "classes").repartition("conv_id").sortWithinPartitions(*last_first).mapInArrow(backward, ddl(ends))
        both = tail.unionByName(chunks.select("conv_id", *CHUNK), allowMissingColumns=True)
        joined = both.repartition("conv_id").sortWithinPartitions("conv_id", *place, F.col("end").isNull()).mapInArrow(forward, ddl({"conv_id": conv_type, **RESULT}))
        joined = materialize(joined, "joined-conversations")
    return pieces.where("rows IS NULL").select("conv_id", *RESULT).unionByName(joined)


def op13_conversation_repair(spark, sf_dir):
    """Faults and repairs of all conversations."""
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
