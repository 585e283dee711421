"""Reply trees to training conversations.

Iterative self-joins double the known stretch of every message's way to its
root, so a tree of depth d takes log2(d) joins.  Leaves rank by the score of
their branch; each chosen root-to-leaf path is formatted as one conversation, a
text in parts of bounded size with its loss mask.  No step gathers a tree or a
path in one row.

Template: `[INST] text [/INST]` for a user, `<s> text</s>` for an assistant,
`<<ROLE:name>> text <</ROLE>>` for any other role (name percent-encoded).
Inside texts a backslash is doubled and a control string gets a backslash
behind its first character, which `parse_turns` takes back.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import ship, stored

ship(__name__)

CONTROL = re.compile(r"\\|\[(?=/?INST\])|<(?=/?s>|<ROLE:|</ROLE>>)")
TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<s> (?P<assistant>.*?)</s>|<<ROLE:(?P<name>.*?)>> (?P<other>.*?) <</ROLE>>",
                  re.DOTALL)
#: What ends a turn, and the length of the longest of them.
END, LONGEST_END = re.compile(r"\[/INST\]|</s>|<</ROLE>>"), 10
#: Turns of a conversation that are put in order together, and code points of a part of its text.
CHUNK, PART_CHARS = 1024, 1 << 16


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A formatted turn, and where in it the text under the loss mask starts and ends (assistants only)."""
    body = escape(text or "")
    if role == "assistant":
        return f"<s> {body}</s>", 4, 4 + len(body)
    if role == "user":
        return f"[INST] {body} [/INST]", 0, 0
    return f"<<ROLE:{quote(role or '', safe='')}>> {body} <</ROLE>>", 0, 0


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a formatted text; anything between turns is an error."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        kind = next(k for k in ("user", "assistant", "other") if m[k] is not None)
        out.append((unquote(m["name"]) if kind == "other" else kind, unescape(m[kind])))
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def linear_replies(turns: DataFrame, tree_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(tree, id, parent, role, text, score) where each turn answers the one before it; score 0.

    Turns order by number (null first), then role and text.  Numbering works
    on chunks of turn numbers, so a long conversation is no single window.
    """
    rows = turns.select(F.col(tree_col).alias("tree"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    sizes = rows.groupBy("tree", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("tree").alias("t2"), F.col("chunk").alias("c2"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = F.row_number().over(Window.partitionBy("tree", "chunk").orderBy("turn", "role", "text")) - 1
    rows = rows.withColumn("inner", inner).join(
        sizes, F.col("tree").eqNullSafe(F.col("t2")) & F.col("chunk").eqNullSafe(F.col("c2")))
    rows = rows.withColumn("id", F.col("offset") + F.col("inner"))
    return rows.select("tree", "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), "role", "text",
                       F.lit(0.0).alias("score"))


def paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """Rows (tree, leaf, id, depth, branch_score): the messages of the chosen root-to-leaf paths.

    messages: (tree, id, parent, score), id unique in its tree, both longs or
    any type that joins.  A message without parent, or whose parent is not in
    its tree, is a root.  A branch scores the sum of its messages' scores (null:
    0); per tree the `per_tree` best leaves are chosen, of equal ones those
    with the smallest id.  Messages on a cycle reach no root and are on no
    path.  Null trees are one tree; messages without id are ignored.
    """
    # A struct with a null inside joins like any value.
    m = stored(messages.where("id IS NOT NULL").select(
        F.struct(F.col("tree").alias("is")).alias("tree"), "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "links")
    ids = m.select("tree", F.col("id").alias("parent"))
    # (tree, id, up, steps, total): `steps` messages from id on, scored `total`, lead to `up`; null beyond the root.
    here = m.join(ids.withColumn("real", F.lit(True)), ["tree", "parent"], "left").select(
        "tree", "id", F.when(F.col("real"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"))
    first = stored(here, "up-0")
    # Only messages that haven't met their root yet are joined again; one on a cycle never does.
    done, live, jumps = [first.where("up IS NULL")], first.where("up IS NOT NULL"), []
    for r in range(first.count().bit_length() + 1):
        if live.isEmpty():
            break
        jumps.append(live.select("tree", "id", "up"))
        every = reduce(DataFrame.unionByName, [*done, live])
        far = every.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"),
                           F.col("total").alias("total2"))
        here = stored(live.join(far, ["tree", "up"]).select(
            "tree", "id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"),
            (F.col("total") + F.col("total2")).alias("total")), f"up-{r + 1}")
        done.append(here.where("up IS NULL"))
        live = here.where("up IS NOT NULL")
    whole = reduce(DataFrame.unionByName, done).select("tree", "id", F.col("steps").alias("depth"), F.col("total").alias("branch_score"))
    parents = first.where("up IS NOT NULL").select("tree", F.col("up").alias("id")).distinct()
    best = Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), "id")
    leaves = (whole.join(parents, ["tree", "id"], "left_anti").withColumn("rn", F.row_number().over(best))
              .where(F.col("rn") <= per_tree))
    on = stored(leaves.select("tree", F.col("id").alias("leaf"), "id", "branch_score"), "leaves")
    for jump in reversed(jumps):  # after the jump of 2^k steps, all ancestors at multiples of 2^k are there
        further = on.join(jump, ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), "branch_score")
        on = stored(on.unionByName(further), "path")  # else the plan doubles with every jump
    on = on.join(whole.select("tree", "id", "depth"), ["tree", "id"])
    return on.select(F.col("tree.is").alias("tree"), "leaf", "id", (F.col("depth") - 1).alias("depth"), "branch_score")


def conversations(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """Rows (tree, leaf, depth, formatted, loss_start, loss_end): each chosen path's formatted turns.

    In order of depth the `formatted` texts of a (tree, leaf) are its
    conversation; loss_start and loss_end are code points inside the turn.
    messages: as for `paths`, with role and text; null texts and roles count
    as empty.  A message whose id occurs twice in its tree is an error of the
    table: both rows are formatted.
    """
    chosen = paths(messages, per_tree).withColumnRenamed("tree", "t2").withColumnRenamed("id", "i2")
    rows = messages.join(chosen, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("id") == F.col("i2")))
    rows = rows.select("tree", "leaf", "depth", "role", "text")

    def run(batches):
        for b in batches:
            made = [format_turn(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("tree"), b.column("leaf"), b.column("depth"),
                                   pa.array([x[0] for x in made], pa.string()),
                                   *[pa.array([x[k] for x in made], pa.int64()) for k in (1, 2)]],
                                  ["tree", "leaf", "depth", "formatted", "loss_start", "loss_end"])

    shape = rows.select("tree", "leaf", "depth", F.lit("").alias("formatted"), F.lit(0).cast("long").alias("loss_start"),
                        F.lit(0).cast("long").alias("loss_end")).schema
    return rows.mapInArrow(run, shape)


def conversation_texts(formatted: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (tree, leaf, part, text, loss_starts, loss_ends): each conversation as one text, its loss mask beside it.

    formatted: rows of `conversations`.  The parts of a (tree, leaf), joined in
    their order from 0, are the conversation's text; all but the last hold
    `part_chars` code points, wherever that cuts, so that a text of any length
    makes rows of bounded size.  The mask's spans are code points of the whole
    text, end exclusive, divided where parts are.  Nulls among trees and leaves
    are values like others; empty input, empty result.
    """
    keys = ["tree", "leaf"]
    spans = F.array(F.lit(0).cast("long"))
    shape = formatted.select(*keys, F.lit(0).cast("long").alias("part"), F.lit("").alias("text"), spans.alias("loss_starts"),
                             spans.alias("loss_ends")).schema
    names = shape.names

    def run(batches):
        key, part, at, held, marks = None, 0, 0, "", []

        def cut(whole):
            """The parts that `held` fills, or at the end of a conversation all of it."""
            nonlocal part, at, held, marks
            rows, used = [], 0
            while len(held) - used >= part_chars or whole and used < len(held):
                text = held[used:used + part_chars]
                end = at + len(text)
                inside = [(max(s, at), min(e, end)) for s, e in marks if s < end and e > at]
                rows.append((*key, part, text, [s for s, _ in inside], [e for _, e in inside]))
                marks = [m for m in marks if m[1] > end]
                part, at, used = part + 1, end, used + len(text)
            held = held[used:]
            return rows

        for b in batches:
            kinds = [*[b.schema.field(k).type for k in keys], pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            done = []
            for r in zip(*[b.column(c).to_pylist() for c in (*keys, "formatted", "loss_start", "loss_end")], strict=True):
                if r[:2] != key:
                    if key is not None:
                        done += cut(True)
                    key, part, at, held, marks = r[:2], 0, 0, "", []
                if r[4] > r[3]:
                    marks.append((at + len(held) + r[3], at + len(held) + r[4]))
                held += r[2]
                done += cut(False)
            if done:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if key is not None and held:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*cut(True), strict=True), kinds, strict=True)], names)

    return (formatted.select(*keys, "depth", "formatted", "loss_start", "loss_end").repartition(*keys)
            .sortWithinPartitions(*keys, "depth").mapInArrow(run, shape))


class TurnReader:
    """Reads turns back from the parts of a text, cut anywhere; holds one part and what it knows of one turn."""

    def __init__(self):
        self.held, self.seam = [], ""

    def feed(self, text: str) -> list[tuple[str, str]]:
        """The turns that end in this part.  Texts hold no end mark of a turn, as `escape` takes them apart."""
        seen = self.seam + text
        self.seam = seen[1 - LONGEST_END:]
        ends = [m.end() for m in END.finditer(seen)]
        self.held.append(text)
        if not ends:
            return []
        whole = "".join(self.held)
        cut = len(whole) - (len(seen) - ends[-1])
        self.held, self.seam = [whole[cut:]], whole[cut:][1 - LONGEST_END:]
        return parse_turns(whole[:cut])

    def close(self) -> None:
        if any(self.held):
            raise ValueError("the text ends within a turn")


class MaskReader:
    """Takes escapes back in pieces of a text, cut anywhere."""

    def __init__(self):
        self.open = ""

    def feed(self, text: str) -> str:
        text = self.open + text
        odd = (len(text) - len(text.rstrip("\\"))) % 2  # a backslash whose character comes with the next piece
        self.open = text[len(text) - odd:]
        return unescape(text[:len(text) - odd])


def digests(texts: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from texts and masks alone.

    texts: rows of `conversation_texts`.  A conversation's parts stream past in
    order; only hash states, one part and the turn it ends in are held.
    """
    keys = ["tree", "leaf"]
    shape = texts.select(*keys, F.lit(0).cast("long").alias("n_turns"), F.lit("").alias("turns_sha256"),
                         F.lit(0).cast("long").alias("loss_chars"), F.lit("").alias("loss_sha256"),
                         F.lit(0).cast("long").alias("formatted_chars")).schema
    names = shape.names

    def run(batches):
        key, n, chars, loss, turns, masked, reader, mask = None, 0, 0, 0, None, None, None, None

        def row():
            reader.close()
            return (*key, n, turns.hexdigest(), loss, masked.hexdigest(), chars)

        def batch(rows, kinds):
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        kinds = None
        for b in batches:
            kinds = [b.schema.field(k).type for k in keys] + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            for r in zip(*[b.column(c).to_pylist() for c in (*keys, "text", "loss_starts", "loss_ends")], strict=True):
                if r[:2] != key:
                    if key is not None:
                        done.append(row())
                    key, n, chars, loss, turns, masked = r[:2], 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                    reader, mask = TurnReader(), MaskReader()
                for role, text in reader.feed(r[2]):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for start, end in zip(r[3], r[4], strict=True):
                    under = mask.feed(r[2][start - chars:end - chars])
                    loss += len(under)
                    masked.update(under.encode())
                chars += len(r[2])
            if done:
                yield batch(done, kinds)
        if key is not None:
            yield batch([row()], kinds)

    return texts.repartition(*keys).sortWithinPartitions(*keys, "part").mapInArrow(run, shape)
