"""Conversation structure repair: the cheapest edits that make the roles ``(s?(ua)+)?``, in secondary-sorted streams.

One repartition by conversation; every later step sorts within partitions.  A first ``mapInPandas`` walks each
conversation from its last turn to its first and carries, across Arrow batches, the cheapest cost to the end from
each state (nothing yet, after system, after user, after assistant).  Its backpointers are compact: one small integer
a row, two bits for each state, written as a column.  The partition is sorted again, first turn to last, so the
backpointers of a conversation of any size spill with Spark's own sort, on the executor that works on it, and a lost
task starts again from its shuffle input.  A second ``mapInPandas`` follows them and emits the edits.  Memory holds
one state a conversation, never its rows.  Going backwards makes ties exact: in each state at most one edit of each
initial leads on, so the least initial among the cheapest edits gives the least audit text.

Defined results: a null role or text is one space; in the key that chooses the damage a null id or turn is one space
as well.  Null turns come first.  Rows of one turn come in order of role, then text; repeated rows stay adjacent.
Rows of a null conv_id are one conversation.  A role counts by its first character.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"

# States, by the role initial that was last given; edits, in the order of their initials.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, KEEP, REROLE = range(4)
INITIALS = "DIKR"
#: The state that a user or assistant row leads to from each state, and what it is called.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: Faults of a row: its first one counts.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Cheapest cost to the end after the last row: nothing, or whole pairs; else assistant, or user and assistant, are inserted.
AT_END = (0, 4, 2, 0)
LEGAL = {"su", "ua", "au"}


def damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, alive) of every row after the damage that its key chooses; a dropped row stays
    with ``alive`` false, so that its conversation is known."""
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("alive"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")


def step(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
    """The cheapest costs to the end before a row, from those after it, and the edit to choose in each state."""
    options: list[list[tuple[int, int]]] = []
    for state in range(4):
        here = [(COST[DELETE] + after[state], DELETE)]
        if fault not in (BLANK, DUPLICATE):
            extra = fault == TRUNCATED
            to = {"s": SYSTEM if state == NOTHING else None, "u": USER if NEXT[state] == USER else None,
                  "a": ASSISTANT if state == USER else None}.get(initial)
            if to is not None:
                here.append((COST[KEEP] + extra + after[to], KEEP))
            here.append((COST[REROLE] + extra + after[NEXT[state]], REROLE))
        options.append(here)
    # an inserted row leads on before this row; two in a row only ever help on the way from a state to the next
    least = [min(c for c, _ in o) for o in options]
    ua = {USER: min(least[USER], COST[INSERT] + least[ASSISTANT]), ASSISTANT: min(least[ASSISTANT], COST[INSERT] + least[USER])}
    best = [min([*options[s], (COST[INSERT] + ua[NEXT[s]], INSERT)]) for s in range(4)]
    return tuple(c for c, _ in best), sum(e << 2 * s for s, (_, e) in enumerate(best))


def _backwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows from the last turn to the first: adds ``fault`` and ``back``, the edits by state."""
    conv, costs = object(), AT_END
    known: dict[tuple, tuple] = {}                # costs relative to the least are few, so steps repeat
    for batch in batches:
        faults, backs = [], []
        for c, role, text, seen, alive in zip(*(batch[x].tolist() for x in ("conv", "role", "text", "seen", "alive"))):
            if c != conv:
                conv, costs = c, AT_END
            if not alive:
                faults.append(FINE)
                backs.append(0)
                continue
            end = text.rstrip(SPACES)
            fault = BLANK if not end else DUPLICATE if seen else FINE if end[-1] in ".!?" else TRUNCATED
            key = (costs, role[:1] if role[:1] in ("s", "u", "a") else "", fault)
            if key not in known:
                after, back = step(*key)
                known[key] = tuple(x - min(after) for x in after), back
            costs, back = known[key]
            faults.append(fault)
            backs.append(back)
        yield batch.assign(fault=faults, back=backs)


def _forwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows from the first turn to the last: one row for each edit, an inserted row before the row it precedes or
    after the last row.  A dropped row gives a row without an edit."""
    columns = ["conv", "edit", "role", "text", "fault", "turn", "role_before"]
    conv, state = None, NOTHING

    def inserted() -> tuple:
        return conv, "I", ROLE[state], "", FINE, None, None

    for batch in batches:
        out: list[tuple] = []
        for c, turn, role, text, fault, back, alive in zip(*(batch[x].tolist() for x in (
                "conv", "turn", "role", "text", "fault", "back", "alive"))):
            if c != conv:
                while state in (SYSTEM, USER):
                    state = NEXT[state]
                    out.append(inserted())
                conv, state = c, NOTHING
            if not alive:
                out.append((c, None, None, None, FINE, None, None))
                continue
            while (edit := back >> 2 * state & 3) == INSERT:
                state = NEXT[state]
                out.append(inserted())
            if edit != DELETE:
                state = SYSTEM if edit == KEEP and role[:1] == "s" else NEXT[state]
            out.append((c, INITIALS[edit], ROLE[state] if edit == REROLE else role, text, fault, turn, role))
        if out:
            yield pd.DataFrame(out, columns=columns)
    last: list[tuple] = []
    while state in (SYSTEM, USER):
        state = NEXT[state]
        last.append(inserted())
    if last:
        yield pd.DataFrame(last, columns=columns)


EDITS = "conv string, edit string, role string, text string, fault int, turn string, role_before string"


def repair(damaged: DataFrame) -> DataFrame:
    """The edits of each conversation, in order within their partition: ``edit`` (D, I, K or R; null for a dropped
    row), the role and text it leaves (a deleted row's own), and for a given row its fault, turn and role before."""
    # one exchange: windows and sorts below stay within the partitions by conversation
    rows = damaged.repartition("conv").withColumn(
        "seen", F.row_number().over(Window.partitionBy("conv", "role", "text", "alive").orderBy("turn")) > 1)
    order = ["conv", "turn", "role", "text", "seen"]
    backs = (rows.sortWithinPartitions(*[F.desc(c) for c in order])
             .select("conv", F.col("turn").cast("string").alias("turn"), "role", "text", "seen", "alive")
             .mapInPandas(_backwards, "conv string, turn string, role string, text string, seen boolean, alive boolean, fault int, back int"))
    return (backs.sortWithinPartitions("conv", F.col("turn").cast("long"), *order[2:])
            .select("conv", "turn", "role", "text", "alive", "fault", "back").mapInPandas(_forwards, EDITS))


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    now: dict | None = None

    def row(s: dict) -> tuple:
        n = s["faults"]
        gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["distinct"]
        return (s["conv"], gaps, n[BLANK], n[DUPLICATE], n[TRUNCATED], s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest())

    for batch in batches:
        out = []
        for conv, edit, role, text, fault, turn, before in zip(*(batch[c].tolist() for c in (
                "conv", "edit", "role", "text", "fault", "turn", "role_before"))):
            if now is None or now["conv"] != conv:
                if now is not None:
                    out.append(row(now))
                now = {"conv": conv, "low": None, "high": None, "distinct": 0, "faults": [0] * 4, "illegal": 0, "cost": 0,
                       "audit": [], "sha": hashlib.sha256(), "last": None, "some": False}
            if edit is None:
                continue
            now["audit"].append(edit)
            now["cost"] += COST[INITIALS.index(edit)] + (fault == TRUNCATED and edit != "D")
            if edit != "I":
                now["faults"][fault] += 1
                if turn is not None:
                    t = int(turn)
                    if now["high"] != t:
                        now["distinct"] += 1
                    now["low"] = t if now["low"] is None else now["low"]
                    now["high"] = t
                if now["last"] is not None and now["last"] + before[:1] not in LEGAL:
                    now["illegal"] += 1
                now["last"] = before[:1]
            if edit != "D":
                now["sha"].update((("\n" if now["some"] else "") + role + ":" + text).encode())
                now["some"] = True
        if out:
            yield pd.DataFrame(out, columns=columns)
    if now is not None:
        yield pd.DataFrame([row(now)], columns=columns)


def report(edits: DataFrame) -> DataFrame:
    """One row a conversation from the edits of ``repair``, which must still be in their order."""
    return edits.mapInPandas(_digest, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                      "cost long, audit string, repaired_sha256 string")
