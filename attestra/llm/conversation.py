"""Conversation structure repair: the cheapest edits that give a conversation its order of roles, with an audit of them.

A conversation is its rows by turn, null turns first, rows of one turn by role and text. A row's first fault counts:
blank (only white space), duplicate (role and text occurred before in the conversation), truncated (the last visible
character is none of . ! ?). Repairing keeps a row at no cost (K), gives it the role user or assistant for 2 (R), deletes
it for 3 (D, a must for blank and duplicate rows) or inserts an empty row of user or assistant anywhere for 2 (I); a
truncated row that stays costs 1. The initials of the roles then read `(s?(ua)+)?`. Of the cheapest audits the least
in ASCII is taken; it determines the repaired rows.

The audits are found by dynamic programming over the rows, in order: of every state (nothing, system, user, assistant last)
the cheapest audit is kept as a node that is linked to its prefix, so that states share their prefixes and what no
state needs is freed. A node knows its ancestors 1, 2, 4, ... characters back and the rolling hash of its string. Ties are
decided at the end of the longest common prefix, which a descent through the ancestors with equal hashes finds.
Equal strings of a step are one node, so that a hash that is equal for two nodes is a collision; the descent is then
repeated by identity. All strings of a step end in the row's own edit, and none of them is a prefix of another,
therefore a prefix that loses can be forgotten.

Faults, positions and the join of edits with rows are Spark's; the tasks that decide see neither texts nor more than one
row at a time, and keep the linked nodes of one conversation (some 300 bytes a row), whose audit is one value anyway.

Null roles and texts are one space. Roles other than those of the initials s, u and a, empty ones too, cannot be kept. Null
conversation ids are one conversation. Repeated rows are duplicates. A conversation all of whose rows are gone has an empty
audit. An empty table gives an empty result. Columns besides conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

WHITE = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
PAIRS = ("su", "ua", "au")
#: Nothing yet, system only, user last, assistant last; the first and the last may end a conversation.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: From a state by so many inserted rows to another.
INSERTS = {NONE: ((NONE, 0), (USER, 1), (ASSISTANT, 2)), SYSTEM: ((SYSTEM, 0), (USER, 1), (ASSISTANT, 2)), USER: ((USER, 0), (ASSISTANT, 1)), ASSISTANT: ((ASSISTANT, 0), (USER, 1))}
#: Where a row of some initial leads to.
AFTER = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class Node:
    """A string as its last character and its prefix; up holds the ancestors 1, 2, 4, ... characters back."""

    __slots__ = ("char", "depth", "hash", "up")

    def __init__(self, parent: Node | None = None, char: str = "") -> None:
        self.char = char
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth, self.hash = parent.depth + 1, (parent.hash * _BASE + ord(char)) % _PRIME
        up, k = [parent], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)

    def ancestor(self, depth: int) -> Node:
        node, away = self, self.depth - depth
        while away:
            k = away.bit_length() - 1
            node, away = node.up[k], away - (1 << k)
        return node

    def string(self) -> str:
        chars, node = [], self
        while node.up:
            chars.append(node.char)
            node = node.up[0]
        return "".join(reversed(chars))


def _descend(a: Node, b: Node, same: Callable[[Node, Node], bool]) -> tuple[Node, Node]:
    """The first characters that differ, of two nodes of one depth that are not the same."""
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and not same(a.up[k], b.up[k]):
            a, b = a.up[k], b.up[k]
    return a, b


def less(a: Node, b: Node) -> bool:
    """Whether a's string comes before b's; both stem from one root, on which equal strings are one node."""
    if a is b:
        return False
    depth = min(a.depth, b.depth)
    x, y = a.ancestor(depth), b.ancestor(depth)
    if x is y:
        return a.depth < b.depth
    if x.hash != y.hash:
        x_at, y_at = _descend(x, y, lambda p, q: p.hash == q.hash)
        if x_at.up[0] is y_at.up[0]:
            return x_at.char < y_at.char
    # two strings of one hash somewhere on the way: only identity tells
    x_at, y_at = _descend(x, y, lambda p, q: p is q)
    return x_at.char < y_at.char


class Repair:
    """The cheapest audits of the rows so far, one for each state."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, Node]] = {NONE: (0, Node())}

    @staticmethod
    def _offer(best: dict, made: dict, state: int, cost: int, node: Node, text: str) -> None:
        if state in best and best[state][0] < cost:
            return
        for char in text:
            at = (id(node), char)
            node = made[at] if at in made else made.setdefault(at, Node(node, char))
        if state not in best or best[state][0] > cost or less(node, best[state][1]):
            best[state] = (cost, node)

    def add(self, initial: str, gone: bool, truncated: bool) -> None:
        """A row of this initial; gone: it must be deleted."""
        best, made = {}, {}
        stays = TRUNCATED if truncated else 0
        for start, (cost, node) in self.best.items():
            for state, n in INSERTS[start]:
                so_far, text = cost + n * INSERT, "I" * n
                self._offer(best, made, state, so_far + DELETE, node, text + "D")
                if gone:
                    continue
                if state in AFTER.get(initial, ()):
                    self._offer(best, made, AFTER[initial][state], so_far + stays, node, text + "K")
                for role in "ua":
                    if state in AFTER[role]:
                        self._offer(best, made, AFTER[role][state], so_far + stays + REROLE, node, text + "R")
        self.best = best

    def done(self) -> tuple[int, str]:
        """The cost and the audit of the whole conversation."""
        best, made = {}, {}
        for start, (cost, node) in self.best.items():
            for state, n in INSERTS[start]:
                if state in (NONE, ASSISTANT):
                    self._offer(best, made, 0, cost + n * INSERT, node, "I" * n)
        return best[0][0], best[0][1].string()


def edits_of(audit: str) -> Iterator[tuple[int | None, str, str | None]]:
    """(row, edit, role given to it) of each edit; rows count from 1, an inserted row has none."""
    left = len(audit) - audit.count("D")
    roles, row = ["user", "assistant"], 0
    turn = -(left % 2)  # an odd number of rows begins with the system's
    for edit in audit:
        row += edit != "I"
        yield row if edit != "I" else None, edit, roles[turn % 2] if edit in "IR" else None
        turn += edit != "D"


_EDITS = ("step", "pos", "edit", "role", "cost")


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of conversations whose rows come in order; step 0 is the whole conversation's row."""
    kind = None

    def told(conv_id, repair: Repair) -> Iterator[pa.RecordBatch]:
        cost, audit = repair.done()
        rows = [(0, None, None, None, cost)]
        for step, (pos, edit, role) in enumerate(edits_of(audit), 1):
            rows.append((step, pos, edit, role, None))
            if len(rows) == 8192:
                yield part(conv_id, rows)
                rows = []
        if rows:
            yield part(conv_id, rows)

    def part(conv_id, rows: list) -> pa.RecordBatch:
        step, pos, edit, role, cost = zip(*rows, strict=True)
        columns = [pa.array([conv_id] * len(rows), kind), pa.array(step, pa.int64()), pa.array(pos, pa.int64()), pa.array(edit, pa.string()), pa.array(role, pa.string()), pa.array(cost, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *_EDITS])

    def gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small conversations leave together."""
        held: list[pa.RecordBatch] = []
        for p in parts:
            held.append(p)
            if sum(b.num_rows for b in held) > 8192:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def all_told() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        now, repair = None, None
        for batch in batches:
            kind = batch.column("conv_id").type
            for conv_id, initial, gone, truncated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "gone", "truncated")), strict=True):
                if repair is None or conv_id != now:
                    if repair is not None:
                        yield from told(now, repair)
                    now, repair = conv_id, Repair()
                repair.add(initial, gone, truncated)
        if repair is not None:
            yield from told(now, repair)

    yield from gathered(all_told())


def faults(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, pos from 1, initial and the faults blank, duplicate, truncated and illegal (with the row before)."""
    read = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    seen = Window.partitionBy("conv_id", "role", "text").orderBy("pos")
    initial, shown = F.substring("role", 1, 1), F.rtrim(F.col("text"), F.lit(WHITE))
    placed = read.select(
        "*", F.row_number().over(order).cast("bigint").alias("pos"), initial.alias("initial"), F.lag(initial).over(order).alias("before"),
        (shown == "").alias("blank"), F.right(shown, F.lit(1)).isin(".", "!", "?").alias("ends"),
    )
    again = ~F.col("blank") & (F.row_number().over(seen) > 1)
    told = placed.select("*", again.alias("duplicate"))
    return told.select(
        "conv_id", "turn", "role", "text", "pos", "initial", "blank", "duplicate", (~F.col("blank") & ~F.col("duplicate") & ~F.col("ends")).alias("truncated"),
        (F.col("before").isNotNull() & ~F.concat("before", "initial").isin(*PAIRS)).alias("illegal"),
    )


def edits(told: DataFrame) -> DataFrame:
    """conv_id, step, pos, edit, role, cost from faults(): the edits in order; step 0 has a conversation's cost."""
    light = told.select("conv_id", "pos", "initial", (F.col("blank") | F.col("duplicate")).alias("gone"), "truncated")
    kind = told.schema["conv_id"].dataType.simpleString()
    rows = light.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return rows.mapInArrow(_audits, f"conv_id {kind}, step bigint, pos bigint, edit string, role string, cost bigint")


def repaired(told: DataFrame, decided: DataFrame) -> DataFrame:
    """conv_id, step, edit, turn, role, text: all edits with the rows that they leave; deleted rows have no role and text."""
    source = told.select(F.col("conv_id").alias("c"), F.col("pos").alias("p"), "turn", F.col("role").alias("old"), "text")
    met = decided.filter("step > 0").join(source, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left")
    stays = F.col("edit") != "D"
    return met.select(
        "conv_id", "step", "edit", F.when(stays, F.col("turn")).alias("turn"), F.when(stays, F.coalesce("role", "old")).alias("role"), F.when(stays, F.coalesce("text", F.lit(""))).alias("text")
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the digest of each conversation whose repaired rows come in order; texts go by one after another."""
    now, audit, digest, empty, kind, rows = None, None, None, True, None, []

    def told() -> pa.RecordBatch:
        conv_id, audits, digests = zip(*rows, strict=True)
        out = pa.RecordBatch.from_arrays([pa.array(conv_id, kind), pa.array(audits, pa.string()), pa.array(digests, pa.string())], names=["conv_id", "audit", "repaired_sha256"])
        rows.clear()
        return out

    for batch in batches:
        kind = batch.column("conv_id").type
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            for conv_id, edit, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")), strict=True):
                if audit is None or conv_id != now:
                    if audit is not None:
                        rows.append((now, "".join(audit), digest.hexdigest()))
                    now, audit, digest, empty = conv_id, [], hashlib.sha256(), True
                audit.append(edit)
                if role is not None:
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                    empty = False
            if len(rows) > 8192:
                yield told()
    if audit is not None:
        rows.append((now, "".join(audit), digest.hexdigest()))
    if rows:
        yield told()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by a hash of id and turn, of which a null is one space: dropped, emptied, without . ! ?, repeated, or of role user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind != 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        copies.alias("copy"),
    ).drop("copy")


def audit(conversations: DataFrame, named: DataFrame) -> DataFrame:
    """A row for each conv_id of named: gaps, faults, cost, audit and digest of what conversations (the same or fewer) need."""
    told = materialize(faults(conversations), "conversation-faults")
    decided = materialize(edits(told), "conversation-edits")
    left = repaired(told, decided).repartition("conv_id").sortWithinPartitions("conv_id", "step")
    kind = told.schema["conv_id"].dataType.simpleString()
    digests = left.select("conv_id", "edit", "role", "text").mapInArrow(_digests, f"conv_id {kind}, audit string, repaired_sha256 string")
    count = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
    counted = told.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).cast("bigint").alias("gaps"), *map(count, ("blank", "duplicate", "truncated", "illegal"))
    )
    costs = decided.filter("step = 0").select("conv_id", "cost")
    parts = named.select("conv_id").distinct()
    for part in (counted, costs, digests):  # each has a conversation once
        parts = parts.unionByName(part, allowMissingColumns=True)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    one = parts.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in (*names, "audit", "repaired_sha256")))
    nothing = hashlib.sha256(b"").hexdigest()
    return one.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
