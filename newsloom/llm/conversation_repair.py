"""Conversation structure repair by a Viterbi search whose survivors coalesce.

The rows of a conversation are read in order. Every state of the role grammar ``(s?(ua)+)?`` keeps one
survivor: the cheapest edits that lead to it, ties going to the ASCII-least string of edit initials. The
survivors' edits form a tree of back pointers with reference counts. Branches nobody refers to are
released, and what all survivors share is emitted at the root, so only undecided edits are held, one byte
each. Texts are never held: a survivor carries the running digest of its repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import broadcast_if_small, materialize

BLANKS = " \t\n\v\f\r"
SENTENCE_ENDS = ".!?"
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
LEGAL_PAIRS = {"su", "ua", "au"}

# States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
AFTER_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# The one state that a user or assistant row leads to.
AFTER_CHANGE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
# A survivor of the first state cannot win if it costs more than one of the second by over this much:
# what the first can still do, the second can do for so much more (deleting a system row).
DOMINATED = ((START, ASSISTANT, 2), (SYSTEM, ASSISTANT, 0))


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if min(self.rerole, self.truncated) < 0 or self.insert <= 0 or self.delete < 0:
            raise ValueError("costs must not be negative and an insertion must cost something")


class _Branch:
    """Edits after a fork; ``refs`` counts the branches and survivors that hang on it."""

    __slots__ = ("edits", "parent", "refs")

    def __init__(self, parent: _Branch | None, edits: bytes = b""):
        self.parent, self.edits, self.refs = parent, bytearray(edits), 0
        if parent is not None:
            parent.refs += 1

    def release(self) -> None:
        node: _Branch | None = self
        while node is not None and node.refs == 0 and node.parent is not None:
            node.parent.refs -= 1
            node = node.parent

    def join_above(self) -> None:
        """Take in the edits of the branch above if nothing else hangs on it; the root's edits are emitted."""
        above = self.parent
        if above is not None and above.refs == 1:
            above.edits += self.edits
            self.edits, self.parent = above.edits, above.parent

    def path(self) -> list[_Branch]:
        nodes, node = [], self
        while node is not None:
            nodes.append(node)
            node = node.parent
        return nodes[::-1]


class _Survivor:
    __slots__ = ("branch", "cost", "digest")

    def __init__(self, cost: int, branch: _Branch, digest):
        self.cost, self.branch, self.digest = cost, branch, digest


def _suffix_order(branch: _Branch, edit: str, other: _Branch, other_edit: str) -> bool:
    """Whether ``branch + edit`` is less than ``other + other_edit`` as a string of initials.

    Only the suffixes after the last shared branch can differ. Equal edits from one fork would have met
    in one state, so those suffixes differ in their first initial, which orders them completely.
    """
    mine, theirs = branch.path(), other.path()
    i = 0
    while i < len(mine) and i < len(theirs) and mine[i] is theirs[i]:
        i += 1
    first = chr(mine[i].edits[0]) if i < len(mine) else edit
    second = chr(theirs[i].edits[0]) if i < len(theirs) else other_edit
    return first < second


class Repair:
    """Cheapest repair of one conversation, fed row by row."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        root = _Branch(None)
        root.refs += 1
        self.survivors = {START: _Survivor(0, root, hashlib.sha256())}
        self._insert()

    def _extend(self, state: int, by: _Survivor, cost: int, edit: str, line: tuple[str, str] | None) -> _Survivor:
        digest = by.digest
        if line is not None:
            digest = digest.copy()
            digest.update(f"{chr(10) * (state != START)}{line[0]}:{line[1]}".encode(errors="replace"))
        return _Survivor(cost, _Branch(by.branch, edit.encode()), digest)

    def _replace(self, survivors: dict[int, _Survivor]) -> None:
        """Hold the new survivors, let go of the old, emit what all share."""
        old, self.survivors = self.survivors, survivors
        for s in survivors.values():
            s.branch.refs += 1
        for s in old.values():
            s.branch.refs -= 1
            s.branch.release()
        for s in survivors.values():
            for branch in s.branch.path()[1:]:
                branch.join_above()

    def _insert(self) -> None:
        """Insertions at this place, the cheapest survivors first."""
        done: set[int] = set()
        while todo := [p for p in self.survivors if p not in done]:
            state = min(todo, key=lambda p: self.survivors[p].cost)
            done.add(state)
            by, after = self.survivors[state], AFTER_CHANGE[state]
            cost = by.cost + self.costs.insert
            held = self.survivors.get(after)
            if held is not None and (held.cost < cost or held.cost == cost and not _suffix_order(by.branch, "I", held.branch, "")):
                continue
            new = self._extend(state, by, cost, "I", (ROLE_OF[after], ""))
            new.branch.refs += 1
            self.survivors[after] = new
            if held is not None:
                held.branch.refs -= 1
                held.branch.release()

    def feed(self, role: str, text: str, fault: str | None) -> None:
        best: dict[int, tuple[int, int, str, tuple[str, str] | None]] = {}
        for state, s in self.survivors.items():
            options = [(s.cost + self.costs.delete, state, "D", None)]
            if fault not in (BLANK, DUPLICATE):
                extra = self.costs.truncated if fault == TRUNCATED else 0
                after = AFTER_KEEP.get((state, role[:1]))
                if after is not None:
                    options.append((s.cost + extra, after, "K", (role, text)))
                after = AFTER_CHANGE[state]
                options.append((s.cost + extra + self.costs.rerole, after, "R", (ROLE_OF[after], text)))
            for cost, after, edit, line in options:
                held = best.get(after)
                if (
                    held is None
                    or cost < held[0]
                    or cost == held[0] and _suffix_order(s.branch, edit, self.survivors[held[1]].branch, held[2])
                ):
                    best[after] = (cost, state, edit, line)
        for state, other, more in DOMINATED:
            if state in best and other in best and best[state][0] > best[other][0] + more:
                del best[state]
        self._replace(
            {after: self._extend(state, self.survivors[state], cost, edit, line) for after, (cost, state, edit, line) in best.items()}
        )
        self._insert()

    def undecided(self) -> int:
        """Edits held that are not emitted yet, over all branches."""
        nodes = {id(n): n for s in self.survivors.values() for n in s.branch.path()}
        return sum(len(n.edits) for n in nodes.values() if n.parent is not None)

    def end(self) -> tuple[int, str, str]:
        """Cost, edit initials and SHA-256 of the repaired text."""
        best = None
        for state in ACCEPTING:
            s = self.survivors.get(state)
            if s is not None and (
                best is None or s.cost < best.cost or s.cost == best.cost and _suffix_order(s.branch, "", best.branch, "")
            ):
                best = s
        audit = b"".join(bytes(n.edits) for n in best.branch.path())
        return best.cost, audit.decode("ascii"), best.digest.hexdigest()


def fault_of(text: str, repeated: bool) -> str | None:
    """First fault of a row: blank, duplicate or truncated."""
    shown = text.rstrip(BLANKS)
    if not shown:
        return BLANK
    if repeated:
        return DUPLICATE
    return None if shown[-1] in SENTENCE_ENDS else TRUNCATED


class _Report:
    """Counts and repair of the conversation that is being read."""

    def __init__(self, conv_id: int | None, costs: Costs):
        self.conv_id, self.repair = conv_id, Repair(costs)
        self.counts = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.last = None

    def feed(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        # equal rows of one turn stand side by side
        repeated = repeated or self.last == (turn, role, text)
        if self.last is not None and self.last[1][:1] + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.last = (turn, role, text)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        fault = fault_of(text, repeated)
        if fault:
            self.counts[fault] += 1
        self.repair.feed(role, text, fault)

    def row(self) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        cost, audit, digest = self.repair.end()
        return (self.conv_id, min(gaps, 2**63 - 1), *self.counts.values(), self.illegal, cost, audit, digest)


REPORT_SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class _Output:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, schema: str):
        self.names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
        self.types = [pa.int64() if k == "long" else pa.string() for k in kinds]
        self.rows, self.size = [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += 64 + size

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.types)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types, strict=True)], list(self.names))

    def full(self, limit: int = 1 << 20) -> bool:
        return self.size > limit


def _rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _turn_order(turn: Column) -> Column:
    return F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0).cast("long")).alias("turn"))


def with_repeats(rows: DataFrame) -> DataFrame:
    """``repeated``: role and text occur under an earlier turn of the conversation.

    Only texts found under several turns are joined back, by digest, so a long conversation is spread
    over its texts. Copies under one turn are told apart by the reader, which sees them side by side.
    """
    keyed = rows.withColumn("_text", F.sha2(F.col("text"), 256)).withColumn("_at", _turn_order(F.col("turn")))
    groups = (
        keyed.where("exists").groupBy("conv_id", "role", "_text").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    )
    distant = groups.where("_first != _last").select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_text").alias("_same"), F.col("_first.known").alias("_known"), F.col("_first.turn").alias("_turn")
    )
    distant, _ = broadcast_if_small(materialize(distant, "repeats"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_text") == F.col("_same"))
    repeated = F.col("_same").isNotNull() & (F.col("_at") > F.struct("_known", "_turn"))
    return keyed.join(distant, same, "left").select(*rows.columns, repeated.alias("repeated"))


def _rows(conversations: DataFrame, present: str | None) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
        (F.col(present) if present else F.lit(True)).alias("exists"),
    )


def _in_reading_order(rows: DataFrame) -> DataFrame:
    """Conversation by conversation within each partition, rows that are none first."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "exists", F.asc_nulls_first("turn"), "role", "text")


def repair_report(conversations: DataFrame, present: str | None = None, costs: Costs = Costs()) -> DataFrame:
    """One row per ``conv_id`` (NULL is a conversation too): faults, illegal neighbours, the cheapest repair.

    ``present`` may name a column that is false for rows that only name their conversation; one without other
    rows has zeros, no edits and the digest of the empty text. NULL roles and texts are one space. Rows go by
    turn, NULL first, then role and text; repeated rows are duplicates. A role without characters cannot be
    kept. Other columns are ignored; an empty table gives no rows. The digest takes a conversation's rows
    one after the other, so they are streamed through one task, sorted by Spark, and never held.
    """

    def run(batches):
        done, current = _Output(REPORT_SCHEMA), None
        for conv_id, exists, turn, role, text, repeated in _rows_of(batches):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    row = current.row()
                    done.add(row, len(row[-2]))
                current = _Report(conv_id, costs)
                if done.full():
                    yield done.batch()
            if exists:
                current.feed(turn, role, text, repeated)
        if current is not None:
            done.add(current.row(), 0)
        yield done.batch()

    rows = with_repeats(_rows(conversations, present))
    return _in_reading_order(rows).select("conv_id", "exists", "turn", "role", "text", "repeated").mapInArrow(run, REPORT_SCHEMA)


ROWS_SCHEMA = "conv_id long, position long, edit string, turn long, role string, text string"


def repaired_rows(conversations: DataFrame, report: DataFrame, present: str | None = None) -> DataFrame:
    """The repaired conversations: ``conv_id, position, edit, turn, role, text`` of every row that stays.

    ``report`` is the result of ``repair_report`` on the same rows; its edits are read ahead of the rows they
    belong to. ``position`` counts from 0; inserted rows have no turn. Cases are those of ``repair_report``.
    """
    edits = report.select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(False).alias("exists")
    )
    rows = edits.unionByName(_rows(conversations, present).where("exists"))

    def run(batches):
        done, audit, at, state, position = _Output(ROWS_SCHEMA), "", 0, START, 0
        for conv_id, exists, turn, role, text in _rows_of(batches):
            if not exists:
                audit, at, state, position = text, 0, START, 0
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = AFTER_KEEP[state, role[:1]] if edit == "K" else AFTER_CHANGE[state]
                    done.add((conv_id, position, edit, turn, role if edit == "K" else ROLE_OF[state], text), len(text))
                    position += 1
            while audit[at : at + 1] == "I":
                state = AFTER_CHANGE[state]
                done.add((conv_id, position, "I", None, ROLE_OF[state], ""), 0)
                at, position = at + 1, position + 1
            if done.full():
                yield done.batch()
        yield done.batch()

    return _in_reading_order(rows).select("conv_id", "exists", "turn", "role", "text").mapInArrow(run, ROWS_SCHEMA)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by ``crc32('conv_id:turn') % 20``, NULLs as one space; ``exists`` false where dropped.

    0 drops the row, 1 empties its text, 2 removes sentence ends, 3 repeats the row, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), space), F.coalesce(F.col("role"), space)
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, SENTENCE_ENDS, "")).otherwise(text).alias("text"),
        (kind != 0).alias("exists"),
        F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_copies"),
    )
    return rows.withColumn("_copy", F.explode("_copies")).drop("_copies", "_copy")
