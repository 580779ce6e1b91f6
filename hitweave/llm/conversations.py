"""Repair of conversation structure: the cheapest edits that give every conversation the turns of a dialogue.

Messages are dealt by conversation and sorted by turn; one pass over the sorted Arrow batches of a partition carries the
state of a dynamic program from message to message and from batch to batch. The program knows four situations (nothing
yet, after a system message, after the user, after the assistant); each has the least cost to get there, and which of the
situations' edit strings is smaller. A step depends on little, so each distinct step is computed once and has a number:
the back pointer of a message is one such number of two bytes. Messages and back pointers of a conversation are kept
until it ends; beyond ``KEPT_BYTES`` both go to a spool file, which has no name, belongs to the task and is gone with it.
At the end the pointers are walked back and the edits written in order.

A message is blank, a duplicate of an earlier one of its conversation (equal role and text), truncated, or sound. Equal
messages of one turn meet by the sort; those of different turns are found before by hash (128 bits), aggregated by
conversation and hash, so that a task keeps the hashes of one turn only.

Edits and costs: keep (K, 0), give the role user or assistant (R, 3), delete (D, 4), insert an empty message of user or
assistant (I, 3); 3 more for a truncated message that stays. Blank and duplicate messages must go. Roles count by
their first letter; the result is nothing, or an optional system message followed by pairs of user and assistant. Among
the cheapest edits the smallest string of letters wins.

Defined cases: null role and text are one space, so a null text is blank; turns are ordered with null first; messages of
one turn by role and text; null is a conversation of its own; repeated rows are duplicates; empty tables give empty
results. Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.llm.quality import fold

KEPT_BYTES = 16 << 20
ROWS = 2048
RENAME, DELETE, INSERT, CUT = 3, 4, 3, 3
#: a situation that costs more than the cheapest one by over this can be reached from that one later: insert, delete
LEAD = INSERT + DELETE
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
FAULTS = ("", "blank", "duplicate", "truncated")
ROLES = {"u": "user", "a": "assistant"}
#: situation -> role that may follow -> situation
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_WHITE = " \t\n\v\f\r"


def damage(conversations: DataFrame) -> DataFrame:
    """Messages with planted faults, by ``crc32("conv_id:turn") % 20``; nulls count as one space.

    0: the message is lost (``gone``, so that its conversation is still known), 1: the text is empty, 2: it has none of
    ``.!?``, 3: the message comes twice, 4: the role is user.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = fold(name, 20)
    text = F.coalesce("text", blank)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", blank))
    times = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    d = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), times.alias("_time"))
    return d.drop("_time")


def fault(text: str | Column = "text") -> Column:
    """Fault of a message by itself: ``BLANK``, ``TRUNCATED`` or ``SOUND``."""
    t = F.rtrim(F.col(text) if isinstance(text, str) else text, F.lit(_WHITE))
    return F.when(t == "", BLANK).when(F.right(t, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)


def _prepare(messages: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    d = messages.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.col("gone") if "gone" in messages.columns else F.lit(False)).alias("gone"),
    )
    code = F.when(F.col("gone"), SOUND).otherwise(fault())
    hash_ = F.concat(F.xxhash64(F.lit(1), "role", "text").cast("string"), F.lit(":"), F.xxhash64(F.lit(2), "role", "text").cast("string"))
    return d.select("conv_id", "turn", "role", F.when(~F.col("gone"), F.col("text")).alias("text"), "gone", code.alias("fault"), hash_.alias("hash"))


def _seen_before(d: DataFrame) -> DataFrame:
    """``conv_id, turn, hash`` of messages of which an earlier turn of the conversation has an equal one."""
    # null turns are first: -1 stands for them, beside 0 for others
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    m = d.where(~F.col("gone") & (F.col("fault") != BLANK)).select("conv_id", "hash", place.alias("place")).distinct()
    first = m.groupBy("conv_id", "hash").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("_conv"), F.col("hash").alias("_hash"), "first")
    same = (F.col("hash") == F.col("_hash")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    later = m.join(first, same).where(F.col("place") > F.col("first"))
    return later.select("conv_id", "place.turn", "hash")


State = tuple[tuple[int, int] | None, ...]
Step = tuple[State, int, tuple[tuple[int, int, str] | None, ...]]


def _with_inserts(state: State) -> dict[int, tuple[int, int, str, int]]:
    """Best way into each situation when messages may be inserted: cost, rank and inserts, where from."""
    best = {q: (v[0], v[1], "", q) for q, v in enumerate(state) if v}
    for _ in range(2):  # more inserts only come back
        for q, (cost, rank, inserted, came) in list(best.items()):
            for role, to in FOLLOWS[q].items():
                new = (cost + INSERT, rank, inserted + "I", came)
                if role in ROLES and (to not in best or new[:3] < best[to][:3]):
                    best[to] = new
    return best


def step(state: State, initial: str, code: int) -> Step:
    """The state after one message, by how much all costs were lowered, and where each situation came from.

    A state has for each situation the cost and the rank of its edit string among the situations', or None. Edit strings up
    to a message end with that message's letter, so none begins another and ranks order them whatever follows. A pointer is
    situation before, number of inserts, letter.
    """
    found: dict[int, tuple[int, tuple[int, str], tuple[int, int, str]]] = {}
    more = CUT if code == TRUNCATED else 0
    for q, (cost, rank, inserted, came) in _with_inserts(state).items():
        ways = [(DELETE, "D", q)]
        if code not in (BLANK, DUPLICATE):
            ways += [(RENAME + more, "R", to) for role, to in FOLLOWS[q].items() if role in ROLES]
            if initial in FOLLOWS[q]:
                ways.append((more, "K", FOLLOWS[q][initial]))
        for price, letter, to in ways:
            new = (cost + price, (rank, inserted + letter), (came, len(inserted), letter))
            if to not in found or new[:2] < found[to][:2]:
                found[to] = new
    low = min(f[0] for f in found.values())
    found = {q: f for q, f in found.items() if f[0] <= low + LEAD}
    ranks = {key: k for k, key in enumerate(sorted(f[1] for f in found.values()))}
    new_state = tuple((found[q][0] - low, ranks[found[q][1]]) if q in found else None for q in range(4))
    return new_state, low, tuple(found[q][2] if q in found else None for q in range(4))


START: State = ((0, 0), None, None, None)


class Steps:
    """Distinct steps and their numbers."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[State, str, int], int] = {}
        self.steps: list[Step] = []

    def take(self, state: State, initial: str, code: int) -> tuple[State, int]:
        key = (state, initial if initial in ("s", "u", "a") else "", code)
        k = self.numbers.get(key)
        if k is None:
            k = self.numbers[key] = len(self.steps)
            self.steps.append(step(*key))
        return self.steps[k][0], k

    def edits(self, state: State, pointers: Iterator[int]) -> bytearray:
        """Letters from the last to the first; ``pointers`` come from the last message to the first."""
        ends = {q: v for q, v in _with_inserts(state).items() if q in (NOTHING, ASSISTANT)}
        q = min(ends, key=lambda q: ends[q][:3])
        out = bytearray(b"I" * len(ends[q][2]))
        q = ends[q][3]
        for k in pointers:
            q, inserts, letter = self.steps[k][2][q]
            out += letter.encode() + b"I" * inserts
        return out


class Kept:
    """Messages and back pointers of one conversation, in memory or, if they are many, in a spool file of the task."""

    def __init__(self, most: int) -> None:
        self.most, self.rows, self.size, self.file, self.blocks = most, [], 0, None, []
        self.pointers = array("H")

    def add(self, row: tuple, pointer: int) -> None:
        self.rows.append(row)
        self.pointers.append(pointer)
        self.size += 200 + 2 * len(row[2])
        if self.size > self.most:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        start = self.file.tell()
        pickle.dump(self.rows, self.file)
        middle = self.file.tell()
        self.file.write(self.pointers.tobytes())
        self.blocks.append((start, middle, len(self.pointers)))
        self.rows, self.size, self.pointers = [], 0, array("H")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.pointers)
        for _, middle, n in reversed(self.blocks):
            self.file.seek(middle)
            block = array("H")
            block.frombytes(self.file.read(2 * n))
            yield from reversed(block)

    def forwards(self) -> Iterator[tuple]:
        for start, _, _ in self.blocks:
            self.file.seek(start)
            yield from pickle.load(self.file)
        yield from self.rows

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


EDITS = "conv string, seq long, edit string, turn string, was string, fault string, role string, text string"
_NAMES = ["conv", "seq", "edit", "turn", "was", "fault", "role", "text"]


def edit_stream(most: int = KEPT_BYTES):
    """Function for ``mapInPandas`` over messages that are dealt by conversation and sorted; rows of ``EDITS``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = Steps()
        out: list[tuple] = []
        size = 0
        conv, kept, state = None, None, START

        def finish() -> Iterator[tuple]:
            yield (conv, 0, None, None, None, None, None, None)  # also for those without any message
            letters = steps.edits(state, kept.backwards())
            letters.reverse()
            messages, seq, before = kept.forwards(), 0, NOTHING
            for letter in letters.decode():
                seq += 1
                if letter == "I":
                    role = "u" if "u" in FOLLOWS[before] else "a"
                    before = FOLLOWS[before][role]
                    yield (conv, seq, "I", None, None, "", ROLES[role], "")
                    continue
                turn, was, text, code = next(messages)
                if letter == "D":
                    yield (conv, seq, "D", turn, was, FAULTS[code], None, None)
                    continue
                role = was[:1] if letter == "K" else "u" if "u" in FOLLOWS[before] else "a"
                before = FOLLOWS[before][role]
                yield (conv, seq, letter, turn, was, FAULTS[code], was if letter == "K" else ROLES[role], text)
            kept.close()

        def frame() -> pd.DataFrame:
            return pd.DataFrame(out, columns=_NAMES)

        turn_now, marked, last = None, set(), None
        for f in frames:
            columns = [f[c].tolist() for c in ("conv", "turn", "mark", "role", "text", "gone", "fault", "hash")]
            for c, turn, mark, role, text, gone, code, hash_ in zip(*columns, strict=True):
                if kept is None or c != conv:
                    if kept is not None:
                        for row in finish():
                            out.append(row)
                            size += len(row[7] or "")
                            if len(out) >= ROWS or size > most:
                                yield frame()
                                out, size = [], 0
                    conv, kept, state, turn_now, marked, last = c, Kept(most), START, None, set(), None
                if turn != turn_now:
                    turn_now, marked, last = turn, set(), None
                if mark:
                    marked.add(hash_)
                elif not gone:
                    code = int(code)
                    if code != BLANK and (hash_ in marked or (role, text) == last):
                        code = DUPLICATE
                    last = (role, text)
                    state, k = steps.take(state, role[:1], code)
                    kept.add((turn, role, text, code), k)
        if kept is not None:
            for row in finish():
                out.append(row)
                size += len(row[7] or "")
                if len(out) >= ROWS or size > most:
                    yield frame()
                    out, size = [], 0
        yield frame()

    return run


def edits(messages: DataFrame, most: int = KEPT_BYTES) -> DataFrame:
    """All edits, rows of ``EDITS`` in the order of each conversation, which lies in one partition.

    ``messages`` has ``conv_id, turn, role, text`` and may have ``gone``. Row 0 of a conversation has no edit.
    """
    d = _prepare(messages)
    marks = _seen_before(d).select("conv_id", "turn", F.lit(True).alias("mark"), "hash")
    rows = d.withColumn("mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    # conversations and turns travel as text, so that pandas keeps nulls and large numbers
    rows = rows.select("*", F.col("conv_id").cast("string").alias("conv"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.desc("mark"), "role", "text"]
    rows = rows.repartition("conv").sortWithinPartitions(*order)
    rows = rows.select("conv", F.col("turn").cast("string").alias("turn"), "mark", "role", "text", "gone", "fault", "hash")
    return rows.mapInPandas(edit_stream(most), EDITS)


def repaired(messages: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, seq, edit, turn, was, fault, role, text`` of every message that stays or is new."""
    e = edits(messages).where("role is not null")
    kinds = dict(messages.dtypes)
    return e.select(F.col("conv").cast(kinds["conv_id"]).alias("conv_id"), "seq", "edit", F.col("turn").cast(kinds["turn"]).alias("turn"), "was", "fault", "role", "text")


DIGEST = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COSTS = {"K": 0, "R": RENAME, "D": DELETE, "I": INSERT}
_LEGAL = {"su", "ua", "au"}


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Figures of every conversation, from its edits as they stream by."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    conv, s = None, None

    def row() -> tuple:
        gaps = s["last"] - s["first"] + 1 - s["turns"] if s["turns"] else 0
        return (conv, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], s["audit"].decode(), s["sha"].hexdigest())

    for f in frames:
        out = []
        for c, edit, turn, was, fault_, role, text in zip(*[f[x].tolist() for x in ("conv", "edit", "turn", "was", "fault", "role", "text")], strict=True):
            if edit is None:
                if s is not None:
                    out.append(row())
                conv = c
                s = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns", "first", "last"), 0)
                s |= {"audit": bytearray(), "sha": hashlib.sha256(), "before": None, "some": False}
                continue
            s["audit"] += edit.encode()
            s["cost"] += _COSTS[edit]
            if edit != "I":
                if fault_:
                    s[fault_] += 1
                if fault_ == "truncated" and edit != "D":
                    s["cost"] += CUT
                if s["before"] is not None and s["before"] + was[:1] not in _LEGAL:
                    s["illegal"] += 1
                s["before"] = was[:1]
                if turn is not None:
                    t = int(turn)
                    if not s["turns"]:
                        s["first"] = t
                    if not s["turns"] or t != s["last"]:
                        s["turns"] += 1
                    s["last"] = t
            if edit != "D":
                s["sha"].update(("\n" * s["some"] + role + ":" + text).encode())
                s["some"] = True
        if out:
            yield pd.DataFrame(out, columns=names)
    if s is not None:
        yield pd.DataFrame([row()], columns=names)


def audit(messages: DataFrame, most: int = KEPT_BYTES) -> DataFrame:
    """One row for each conversation: ``conv_id``, its faults, the cost and the edits of its repair, and a hash of the result."""
    d = edits(messages, most).mapInPandas(_digest, DIGEST)
    kind = messages.schema["conv_id"].dataType
    return d.select(F.col("conv").cast(kind).alias("conv_id"), *[c for c in d.columns if c != "conv"])
