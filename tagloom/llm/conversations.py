"""Repair of conversations by iterative-deepening A*.

A turn may be kept, given another role, or deleted, and empty turns may be inserted, until the roles read
``(s?(ua)+)?``.  The search goes depth first through the turns, trying edits in ASCII order (Delete,
Insert, Keep, Rerole) and cutting off where the cost so far and a lower bound of the rest exceed the
current bound; then the bound rises to the least cost that was cut off.  So the first accepting path has the
least cost, and of these the ASCII-least edits.

A state is the number of turns behind and the last role written.  A table holds a lower bound of the cost
from every state.  It starts with the deletions that faults require, one for each truncated turn, and two
for every other of a run of adjacent roles that do not fit.  A state that failed is raised to the cheapest of
its continuations, which stays true when the bound rises, so no state fails twice with the same budget.

Conversations are streamed: turns are sorted by conversation and order, and a task holds one byte per turn
for the search, never the texts.  Repaired texts are streamed in a second pass, behind their edits.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tagloom.sources.staging import stage

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
# Roles of a state, the first for none written yet, and of a turn, the last for any other.
START, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 0
#: The role that follows each state.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
EDITS = "DIKR"
#: Marks of a turn besides its role.
CUT_OFF, MUST_GO = 4, 8
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"


def _fits(state: int, role: int) -> bool:
    return role == NEXT[state] or (state == START and role == SYSTEM)


def lower_bounds(codes: bytes) -> list[array]:
    """By state, a lower bound of the cost from each turn on.

    A pair of adjacent roles that does not fit needs an edit.  An edit of cost 2 or more mends two pairs at
    most, those around one turn, so every other pair of a run counts 2.  A deletion costs 3; the 1 of a
    truncated turn counted besides leaves it 2.
    """
    n = len(codes)
    low = [array("q", bytes(8 * (n + 1))) for _ in range(4)]
    # From the next turn that may stay: what the pairs from there on cost, if the pair before it does not
    # fit and has paid for the next one, and if it has not.
    paid, unpaid, following, fixed = 0, 0, None, 0
    for i in range(n, -1, -1):
        if i < n:
            code = codes[i]
            if code & MUST_GO:
                fixed += DELETE
            else:
                role = code & 3
                if following is None:
                    good = role == ASSISTANT
                else:
                    good = _fits(role, following) if role != OTHER else False
                paid, unpaid = (unpaid, unpaid) if good else (unpaid, INSERT + paid)
                following = role
                fixed += TRUNCATED if code & CUT_OFF else 0
        for state in range(4):
            if following is None:
                good = state in (START, ASSISTANT)
            else:
                good = _fits(state, following)
            low[state][i] = fixed + (unpaid if good else INSERT + paid)
    return low


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """The least cost and the ASCII-least edits for turns ``role + CUT_OFF + MUST_GO``, one byte each."""
    n = len(codes)
    low = lower_bounds(codes)

    def edit(i: int, state: int, which: int) -> tuple[int, int, int] | None:
        """Cost and following state of an edit, if it is allowed."""
        if which == 1:
            return INSERT, i, NEXT[state]
        if i == n:
            return None
        if which == 0:
            return DELETE, i + 1, state
        code = codes[i]
        if code & MUST_GO:
            return None
        role, extra = code & 3, TRUNCATED if code & CUT_OFF else 0
        if which == 2:
            return (KEEP + extra, i + 1, role) if _fits(state, role) and role else None
        return None if role == NEXT[state] else (REROLE + extra, i + 1, NEXT[state])

    bound = low[START][0]
    while True:
        path, states = bytearray(), bytearray([START])
        i, left, which = 0, bound, 0
        while True:
            state = states[-1]
            if i == n and state in (START, ASSISTANT):
                return bound - left, "".join(EDITS[e] for e in path)
            step = None
            while which < 4:
                step = edit(i, state, which)
                if step is not None and step[0] + low[step[2]][step[1]] <= left:
                    break
                step, which = None, which + 1
            if step is not None:
                path.append(which)
                states.append(step[2])
                left -= step[0]
                i, which = step[1], 0
                continue
            # Failed: no continuation is cheaper than the cheapest by its own bound.
            rest = (edit(i, state, e) for e in range(4))
            low[state][i] = max(low[state][i], min(s[0] + low[s[2]][s[1]] for s in rest if s))
            if not path:
                break
            states.pop()
            which = path.pop()
            before = i if which == 1 else i - 1
            left += edit(before, states[-1], which)[0]
            i, which = before, which + 1
        bound = low[START][0]


def _space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` after the damage that the id and turn of each row decide.

    CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row, which comes back as ``gone``, 1 empties its text, 2
    removes its sentence ends, 3 repeats it, 4 makes it the user's.  Nulls of id and turn count as a space
    there; a null role or text becomes one.
    """
    kind = F.crc32(F.concat(_space("conv_id"), F.lit(":"), _space("turn")).cast("binary")) % 20
    text = (
        F.when(F.col("_kind") == 1, F.lit(""))
        .when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", ""))
        .otherwise(F.col("_text"))
    )
    times = F.when(F.col("_kind") == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id", "turn", _space("role").alias("_role"), _space("text").alias("_text"), kind.alias("_kind")
    ).select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("_role")).alias("role"),
        text.alias("text"),
        (F.col("_kind") == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_time"),
    ).drop("_time")


#: The order of a conversation's turns; equal ones are the same in all that matters.
ORDER = ("turn", "role", "digest")


def _turns(turns: DataFrame) -> DataFrame:
    """``turns`` with the ``digest`` of the text; where ``gone`` is missing no row is."""
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _space("role").alias("role"),
        _space("text").alias("text"),
        gone.alias("gone"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def coded(turns: DataFrame) -> DataFrame:
    """Turns as codes for the search, sorted by conversation and order within their partitions.

    ``again`` tells a role and text that the conversation had before; it is found by the digest, so that
    texts are not shuffled.  Marked turns follow those that are equal to them.
    """
    known = _turns(turns)
    initial = F.substring("role", 1, 1)
    trimmed = F.rtrim("text", F.lit(SPACE))
    known = known.select(
        "conv_id",
        "turn",
        "role",
        "digest",
        "gone",
        initial.alias("initial"),
        (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    before = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(
        F.asc_nulls_first("turn")
    )
    known = known.withColumn("again", ~F.col("gone") & (F.row_number().over(before) > 1))
    return known.repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), "gone", F.asc_nulls_first("turn"), "role", "digest", "again"
    )


class Tally:
    """What the plan of one conversation needs: counts and one byte per turn."""

    ROLES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn, initial, blank, again, open_):
        code = self.ROLES.get(initial, OTHER)
        if blank:
            self.blank += 1
            code |= MUST_GO
        elif again:
            self.duplicate += 1
            code |= MUST_GO
        elif open_:
            self.truncated += 1
            code |= CUT_OFF
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        self.codes.append(code)

    def plan(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, audit = cheapest_edits(bytes(self.codes))
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def plans(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation.

    ``turns`` has ``conv_id, turn, role, text`` and may have ``gone``, for rows that only say that there is
    a conversation.  Turns are taken by number, nulls first, equal ones by role and text digest.  A turn's
    first fault counts: blank, duplicate, truncated.  A null id is a conversation of its own.  Without
    turns, all is zero and the audit empty; no rows give an empty result.
    """
    schema = turns.sparkSession.createDataFrame([], PLAN).schema
    arrow = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, done = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "initial", "blank", "again", "open")]
            for conv_id, gone, *turn in zip(*columns):
                if tally is None or tally.conv_id != conv_id:
                    if tally is not None:
                        done.append(tally.plan())
                    tally = Tally(conv_id)
                if not gone:
                    tally.add(*turn)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
                done = []
        if tally is not None:
            done.append(tally.plan())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)

    return coded(turns).mapInArrow(search, schema)


REPAIRED = "conv_id long, position long, edit string, role string, text string"


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, position, edit, role, text``: the turns of each conversation after the edits of ``plans``.

    Deleted turns are left out.  Rows come sorted by conversation and position within their partitions, a
    conversation in one of them.  A conversation whose edits leave nothing has no row.
    """
    rows = _turns(turns).filter("NOT gone").select(
        "conv_id", F.lit(True).alias("is_turn"), *ORDER, "text", F.lit(None).cast("string").alias("audit")
    )
    heads = found.select(
        "conv_id",
        F.lit(False).alias("is_turn"),
        F.lit(None).cast("long").alias("turn"),
        F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("binary").alias("digest"),
        F.lit(None).cast("string").alias("text"),
        "audit",
    )
    ordered = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), "is_turn", F.asc_nulls_first("turn"), "role", "digest"
    )
    schema = turns.sparkSession.createDataFrame([], REPAIRED).schema
    arrow = to_arrow_schema(schema)

    class Writer:
        """Goes along the edits of one conversation as its turns come."""

        def __init__(self, conv_id, audit):
            self.conv_id, self.audit = conv_id, audit
            self.at, self.position, self.state = 0, 0, START

        def write(self, edit, role, text, out):
            out.append((self.conv_id, self.position, edit, role, text))
            self.position += 1
            self.state = Tally.ROLES.get(role[:1], OTHER)

        def inserted(self, out):
            while self.audit[self.at : self.at + 1] == "I":
                self.write("I", NAMES[NEXT[self.state]], "", out)
                self.at += 1

        def turn(self, role, text, out):
            self.inserted(out)
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.write("K", role, text, out)
            elif edit == "R":
                self.write("R", NAMES[NEXT[self.state]], text, out)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[tuple] = []
                columns = [part.column(c).to_pylist() for c in ("conv_id", "is_turn", "role", "text", "audit")]
                for conv_id, is_turn, role, text, audit in zip(*columns):
                    if is_turn:
                        writer.turn(role, text, out)
                    else:
                        if writer is not None:
                            writer.inserted(out)
                        writer = Writer(conv_id, audit)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        if writer is not None:
            out = []
            writer.inserted(out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return ordered.mapInArrow(apply, schema)


def digests(fixed: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the rows of ``repaired``: SHA-256 of ``role:text`` by lines."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(conv_id, running):
            return pa.RecordBatch.from_arrays(
                [pa.array([conv_id], pa.int64()), pa.array([running.hexdigest()])], ["conv_id", "repaired_sha256"]
            )

        running, current = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")]
            for conv_id, position, role, text in zip(*columns):
                if position == 0:
                    if running is not None:
                        yield answer(current, running)
                    running, current = hashlib.sha256(), conv_id
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
        if running is not None:
            yield answer(current, running)

    return fixed.mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """``plans`` and ``repaired_sha256`` of every conversation after ``damaged``.

    Repeated rows are turns of their own, of which the second is a duplicate.  A conversation without turns,
    or without any that stays, has the hash of the empty string.
    """
    turns = damaged(conversations.select("conv_id", "turn", "role", "text"))
    found = stage(plans(turns), "plans")
    hashed = digests(repaired(turns, found)).withColumnRenamed("conv_id", "_id")
    return found.join(hashed, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        *found.columns, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
