"""Repair of conversation structure at least cost, by secondary-sorted streaming.

Rows are repartitioned by conversation and sorted by turn, last turn first.
One pass then carries the costs of finishing a conversation from each of four
states across Arrow batches.  Every row leaves one byte of backpointers (the
best edit from each state); long conversations spill them to a temporary file
of the task.  At a conversation's first turn the backpointers are read
forward, which gives the edits.  Only narrow columns take part in that; texts
are joined to the edits by row number.  A lost task reads its sorted shuffle
again; nothing outlives it.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import own_name, ship, stored

ship(__name__)

#: Costs of the edits; an undeleted row whose text is cut off costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letters in the order that decides ties; a backpointer holds the index of one, two bits for each state.
LETTERS = "DIKR"
#: States by what came last: nothing, a system turn, a user turn, an assistant turn.  START and ASSISTANT may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State that an inserted or rerolled turn leads to, and its role.
MADE = (USER, USER, ASSISTANT, USER)
MADE_ROLE = ("user", "user", "assistant", "user")
#: State that a kept turn leads to, by state and initial (s, u, a, another), -1 where it may not stand.
KEPT = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
INITIALS = "sua"
#: Pairs of neighbouring initials (by index) that are legal: su, ua, au.
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Faults as the stream sees them.
SOUND, MUST_GO, CUT_OFF = range(3)
#: Rows whose backpointers stay in memory, and rows of an output batch.
ROWS_HELD, ROWS_OUT = 1 << 20, 1 << 14
#: What a conversation costs from each state once its rows are over.
END = (0, 2 * INSERT, INSERT, 0)
WHITE = " \t\n\x0b\x0c\r"


def back_step(togo: tuple, initial: int, fault: int) -> tuple[tuple, int]:
    """Costs before a row from those after it, less the least of them, and the row's backpointers."""
    extra = TRUNCATED if fault == CUT_OFF else 0

    def taking(state):
        """(cost, letter) of the edits that take the row."""
        yield DELETE + togo[state], 0
        if fault != MUST_GO:
            if KEPT[state][initial] >= 0:
                yield KEEP + extra + togo[KEPT[state][initial]], 2
            yield REROLE + extra + togo[MADE[state]], 3

    best = [min(taking(s)) for s in range(4)]
    for _ in range(2):  # no more than two turns are ever inserted before a row
        best = [min(best[s], (INSERT + best[MADE[s]][0], 1)) for s in range(4)]
    back = sum(letter << 2 * s for s, (_, letter) in enumerate(best))
    low = min(cost for cost, _ in best)
    return tuple(cost - low for cost, _ in best), back


class Spool:
    """Row numbers, kinds and backpointers of one conversation, last row first; a long one goes to a file."""

    KIND = np.dtype([("rid", "<i8"), ("kind", "u1"), ("back", "u1")])

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.file, self.written, self.held = None, 0, 0

    def add(self, rid, kind, back) -> None:
        part = np.empty(len(rid), self.KIND)
        part["rid"], part["kind"], part["back"] = rid, kind, back
        self.parts.append(part)
        self.held += len(part)
        if self.held > ROWS_HELD:
            self.file = self.file or tempfile.TemporaryFile()  # has no name, is gone with the task
            for p in self.parts:
                self.file.write(p.tobytes())
            self.written, self.held, self.parts = self.written + self.held, 0, []

    def forward(self):
        """Parts of bounded size, first row first."""
        for p in reversed(self.parts):
            yield p[::-1]
        at = self.written
        while at:
            n = min(at, ROWS_HELD)
            at -= n
            self.file.seek(at * self.KIND.itemsize)
            yield np.frombuffer(self.file.read(n * self.KIND.itemsize), self.KIND)[::-1]
        if self.file:
            self.file.close()


def edits_of(spool: Spool):
    """(edit, cost, role or None, row number or -1, whether its pair with the row before is illegal), in order."""
    state, before = START, None
    for part in spool.forward():
        for rid, kind, back in part.tolist():
            initial, fault = divmod(kind, 3)
            extra = TRUNCATED if fault == CUT_OFF else 0
            illegal = int(before is not None and (before, initial) not in LEGAL)
            before = initial
            # The stored choice is the row's own; after an insert, the next state's is read from the same byte.
            while (letter := back >> 2 * state & 3) == 1:
                yield "I", INSERT, MADE_ROLE[state], -1, 0
                state = MADE[state]
            if letter == 0:
                yield "D", DELETE, None, rid, illegal
            elif letter == 2:
                yield "K", KEEP + extra, None, rid, illegal
                state = KEPT[state][initial]
            else:
                yield "R", REROLE + extra, MADE_ROLE[state], rid, illegal
                state = MADE[state]
    while state in (SYSTEM, USER):
        yield "I", INSERT, MADE_ROLE[state], -1, 0
        state = MADE[state]


def _stream(frames):
    """Edits of conversations whose rows come last turn first."""
    spool, togo, key, open_ = Spool(), END, None, False
    known: dict = {}  # costs of the states differ by little, so few steps are different
    out: list = []

    def frame():
        columns = list(zip(*out, strict=True))
        out.clear()
        return pd.DataFrame(dict(zip(("key", "step", "edit", "cost", "new_role", "rid", "illegal"), columns, strict=True)))

    def finish():
        for step, edit in enumerate(edits_of(spool)):
            out.append((key, step, *edit))
            if len(out) >= ROWS_OUT:
                yield frame()

    for f in frames:
        keys, rids, kinds = f["key"].to_numpy(object), f["rid"].to_numpy(), f["kind"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if not open_ or keys[x] != key:
                if open_:
                    yield from finish()
                spool, togo, key, open_ = Spool(), END, keys[x], True
            backs = np.empty(y - x, np.uint8)
            for i, kind in enumerate(kinds[x:y].tolist()):
                if (togo, kind) not in known:
                    known[togo, kind] = back_step(togo, *divmod(kind, 3))
                togo, backs[i] = known[togo, kind]
            spool.add(rids[x:y], kinds[x:y], backs)
    if open_:
        yield from finish()
    if out:
        yield frame()


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, edits) of conversations repaired at least cost.

    turns: (conv_id, turn, role, text, fault), one per row; fault is the row's
    first of blank (no character but white space), duplicate (role and text
    stood earlier in the conversation) and truncated (the last such character
    is none of .!?), else null.
    edits: (conv_id, step, edit, cost, illegal, role, text), in the order of
    step: K keeps a row, R gives it another role, D deletes it (role and text
    are then the old ones), I inserts a turn with an empty text.  Without the
    deleted rows, roles begin as `(s?(ua)+)?`; among cheapest edits the letters
    that come first in ASCII stand.  illegal is 1 where a row's and the
    preceding row's initials aren't su, ua or au.

    Null roles and texts count as one space.  Null conversations are one
    conversation; null turns come first; equal turns are ordered by role, then
    the text's SHA-256.  An empty role has no initial and is never kept.
    Repeated rows are duplicates; other columns take no part, whatever their
    names; empty input, empty results.  Identifiers must survive a cast to
    string and back.  A conversation of any length streams through one task in
    bounded memory.
    """
    space = F.lit(" ")
    src = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
                      F.coalesce(F.col(text_col).cast("string"), space).alias("text"))
    id_type = src.schema["conv_id"].dataType
    src = stored(src.withColumn("rid", F.monotonically_increasing_id()), "turns")
    digest = F.unhex(F.sha2("text", 256))
    first = src.groupBy("conv_id", "role", digest.alias("digest")).agg(F.min(F.struct("turn", "rid"))["rid"].alias("rid"))
    first = first.select("rid", F.lit(True).alias("is_first"))
    bare = _trimmed(F.col("text"))
    narrow = src.select("conv_id", "turn", "role", "rid", digest.alias("digest"), (bare == "").alias("blank"),
                        F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("ended"), "truncated"))
    narrow = stored(narrow.join(first, "rid", "left").select("conv_id", "turn", "role", "rid", "digest", fault.alias("fault")), "faults")
    initial = F.substring("role", 1, 1)
    class_ = F.when(initial == "", 3).otherwise(F.when(F.instr(F.lit(INITIALS), initial) > 0, F.instr(F.lit(INITIALS), initial) - 1).otherwise(3))
    kind = class_ * 3 + F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", CUT_OFF).otherwise(SOUND)
    told = (narrow.select(F.col("conv_id").cast("string").alias("key"), "turn", "role", "digest", "rid", kind.cast("int").alias("kind"))
            .repartition("key").sortWithinPartitions("key", F.desc_nulls_last("turn"), F.desc("role"), F.desc("digest"), F.desc("rid")))
    edits = stored(told.mapInPandas(_stream, "key string, step long, edit string, cost long, new_role string, rid long, illegal long"), "edits")
    edits = edits.withColumn("conv_id", F.col("key").cast(id_type))
    made = edits.where("rid < 0").select("conv_id", "step", "edit", "cost", "illegal", F.col("new_role").alias("role"), F.lit("").alias("text"))
    given = edits.where("rid >= 0").join(src.select("rid", "role", "text"), "rid").select(
        "conv_id", "step", "edit", "cost", "illegal", F.coalesce("new_role", "role").alias("role"), "text")
    turns = narrow.select("rid", "fault").join(src, "rid").select("conv_id", "turn", "role", "text", "fault")
    return turns, given.unionByName(made)


def _digest(frames):
    """Audit and digest of each conversation, whose edits come in order."""
    key, open_, audit, sha, lines = None, False, bytearray(), hashlib.sha256(), 0
    out: list = []

    def frame():
        got = pd.DataFrame(out, columns=["key", "audit", "repaired_sha256"])
        out.clear()
        return got

    for f in frames:
        for k, edit, role, text in zip(f["key"], f["edit"], f["role"], f["text"], strict=True):
            if not open_ or k != key:
                if open_:
                    out.append((key, audit.decode(), sha.hexdigest()))
                    if len(out) >= ROWS_OUT:
                        yield frame()
                key, open_, audit, sha, lines = k, True, bytearray(), hashlib.sha256(), 0
            audit += edit.encode()
            if edit != "D":
                sha.update((("\n" if lines else "") + role + ":" + text).encode())
                lines += 1
    if open_:
        out.append((key, audit.decode(), sha.hexdigest()))
        yield frame()


def repair_digests(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one per conversation with rows.

    gaps: last turn - first turn + 1 - different turns, nulls left out (0 if
    all are null).  audit: the letters of the edits; the digest is over the
    repaired `role:text` lines.  Other cases as in `repair`.
    """
    turns, edits = repair(rows, conv_col, turn_col, role_col, text_col)
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    faults = turns.groupBy("conv_id").agg(span.alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    totals = edits.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    told = edits.select(F.col("conv_id").cast("string").alias("key"), "step", "edit", "role", F.when(F.col("edit") != "D", F.col("text")).alias("text"))
    told = told.repartition("key").sortWithinPartitions("key", "step").select("key", "edit", "role", "text")
    read = told.mapInPandas(_digest, "key string, audit string, repaired_sha256 string")
    read = read.select(F.col("key").cast(turns.schema["conv_id"].dataType).alias("conv_id"), "audit", "repaired_sha256")
    return with_ids(with_ids(faults, totals), read)


def with_ids(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on conv_id, where null equals null."""
    other = own_name(left.columns + right.columns, "other_id")
    right = right.withColumnRenamed("conv_id", other)
    return left.join(right, F.col("conv_id").eqNullSafe(F.col(other)), how).drop(other)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by the checksum of `conv_id:turn`, nulls as one space.

    Of every 20 remainders one drops the row, one empties its text, one takes
    its .!? away, one repeats it and one makes it the user's.
    """
    space = F.lit(" ")
    said = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                       (F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                                         F.coalesce(F.col("turn").cast("string"), space))) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("hit") == 3, 2).otherwise(1)
    return said.where("hit <> 0").select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                                         F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")
