"""Repair of conversation structure by a dynamic program whose audits are shared prefixes.

Rows are faulty when blank, repeated or cut off. The cheapest edits (keep, rerole, delete,
insert) that leave the roles ``system? (user assistant)+`` or nothing are found row by row:
for each of four states of that pattern the program holds the best audit, the initials of
its edits. Audits are nodes that share their prefixes. A node keeps its parent, one farther
ancestor of a binary lifting, and a rolling hash of its whole prefix, so the longest common
prefix of two audits of one cost is found in logarithmic steps, and the first edit after it
decides the tie. That the prefixes are equal and not only their hashes is verified.

A row reaches the program as one byte. Rows lie in one order over all tasks (``ordering``),
so a conversation of any size is cut into parts; only its bytes, as many as its audit has,
meet in one task, and its texts meet their edits again by part and place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.exchange import stored
from stratalake.llm.ordering import ordered

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"
#: States: nothing yet, after system, after user, after assistant; an audit may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = {"su", "ua", "au"}

WORD = "[^\\x20\\x09-\\x0D]"
MODULUS, BASE = (1 << 61) - 1, 0x1F3D5B79A8C6E421
#: Nodes held before the prefix that all live audits share is written out.
NODES = 1 << 18


class Audits:
    """Audits as linked nodes; node 0 is the empty one (or what all live ones begin with)."""

    def __init__(self, limit: int = NODES, modulus: int = MODULUS):
        self.limit, self.modulus = limit, modulus
        self.done: list[str] = []
        self._clear()

    def _clear(self) -> None:
        self.parent, self.jump, self.depth, self.hash, self.edit = [0], [0], [0], [0], [""]

    def add(self, parent: int, edit: str) -> int:
        far = self.jump[parent]
        even = self.depth[parent] - self.depth[far] == self.depth[far] - self.depth[self.jump[far]]
        self.parent.append(parent)
        self.jump.append(self.jump[far] if even else parent)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(edit)) % self.modulus)
        self.edit.append(edit)
        return len(self.parent) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.jump[node] if self.depth[self.jump[node]] >= depth else self.parent[node]
        return node

    def _same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth hold equal audits: edit by edit up to their common node."""
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.parent[a], self.parent[b]
        return True

    def _first_difference(self, a: int, b: int) -> tuple[int, int]:
        """The nodes of the first differing edits of two audits of one depth, by comparing all edits."""
        out = a, b
        while a != b:
            if self.edit[a] != self.edit[b]:
                out = a, b
            a, b = self.parent[a], self.parent[b]
        return out

    def less(self, a: int, b: int) -> bool:
        """Whether audit a comes before b in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y] and self._same(x, y):
            return self.depth[a] < self.depth[b]
        if self.hash[x] == self.hash[y]:
            x, y = self._first_difference(x, y)
            return self.edit[x] < self.edit[y]
        u, v = x, y
        while self.hash[self.parent[u]] != self.hash[self.parent[v]]:
            far = self.jump[u], self.jump[v]
            u, v = far if self.hash[far[0]] != self.hash[far[1]] else (self.parent[u], self.parent[v])
        if self.edit[u] == self.edit[v] or not self._same(self.parent[u], self.parent[v]):
            u, v = self._first_difference(x, y)
        return self.edit[u] < self.edit[v]

    def text(self, node: int, above: int = 0) -> str:
        """The edits from below ``above`` to the node."""
        out = []
        while node != above:
            out.append(self.edit[node])
            node = self.parent[node]
        return "".join(reversed(out))

    def trim(self, live: list[int]) -> list[int]:
        """Writes out what all live audits share once there are many nodes; the live nodes anew."""
        if len(self.parent) <= self.limit:
            return live
        depth = min(self.depth[n] for n in live)
        level = [self.ancestor(n, depth) for n in live]
        while len(set(level)) > 1:
            far = [self.jump[n] for n in level]
            level = far if len(set(far)) > 1 else [self.parent[n] for n in level]
        shared = level[0]
        tails = [self.text(n, shared) for n in live]
        self.done.append(self.text(shared))
        self._clear()
        nodes: dict[tuple[int, str], int] = {}
        out = []
        for tail in tails:
            node = 0
            for edit in tail:
                if (node, edit) not in nodes:
                    nodes[node, edit] = self.add(node, edit)
                node = nodes[node, edit]
            out.append(node)
        self.limit = max(self.limit, 2 * len(self.parent))
        return out

    def whole(self, node: int) -> str:
        return "".join(self.done) + self.text(node)


def symbol(fault: int, initial: str) -> str:
    """One character for a row: its fault and the class of its role's initial."""
    at = INITIALS.find(initial) if initial else -1
    return chr(65 + 4 * fault + (at if at >= 0 else 3))


def read_symbol(sign: str) -> tuple[int, str]:
    fault, at = divmod(ord(sign) - 65, 4)
    return fault, (INITIALS + "?")[at]


def cheapest(signs: str, limit: int = NODES, modulus: int = MODULUS) -> tuple[int, str]:
    """Least cost and, of the audits that have it, the one least in ASCII order."""
    audits = Audits(limit, modulus)
    best: dict[int, tuple[int, int]] = {START: (0, 0)}

    def offer(into: dict[int, tuple[int, int]], state: int, cost: int, parent: int, edit: str) -> None:
        held = into.get(state)
        if held is None or cost < held[0]:
            into[state] = cost, audits.add(parent, edit)
        elif cost == held[0]:
            node = audits.add(parent, edit)
            if audits.less(node, held[1]):
                into[state] = cost, node

    def insert() -> None:
        for state in (START, SYSTEM, ASSISTANT, USER):  # into user first, from there into assistant
            if state in best:
                offer(best, NEXT[state], best[state][0] + INSERT_COST, best[state][1], INSERT)

    for sign in signs:
        fault, initial = read_symbol(sign)
        insert()
        after: dict[int, tuple[int, int]] = {}
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        for state, (cost, node) in best.items():
            offer(after, state, cost + DELETE_COST, node, DELETE)
            if fault not in (BLANK, DUPLICATE):
                if (initial, state) in KEPT:
                    offer(after, KEPT[initial, state], cost + more, node, KEEP)
                offer(after, NEXT[state], cost + REROLE_COST + more, node, REROLE)
        live = audits.trim([n for _, n in after.values()])
        best = {s: (c, n) for (s, (c, _)), n in zip(after.items(), live, strict=True)}
    insert()
    ends = [best[s] for s in (START, ASSISTANT) if s in best]
    cost = min(c for c, _ in ends)
    nodes = [n for c, n in ends if c == cost]
    node = nodes[0] if len(nodes) == 1 or audits.less(nodes[0], nodes[1]) else nodes[1]
    return cost, audits.whole(node)


def script(signs: str, audit: str) -> list[str]:
    """The edits of each row: K, D, u and a (rerole), U and A (insert, before it; the last also after it)."""
    out, now, state, row = [], [], START, 0
    for edit in audit:
        if edit == INSERT:
            state = NEXT[state]
            now.append("UA"[state == ASSISTANT])
            continue
        if edit == REROLE:
            state = NEXT[state]
            now.append("ua"[state == ASSISTANT])
        else:
            now.append(edit)
            if edit == KEEP:
                state = KEPT[read_symbol(signs[row])[1], state]
        out.append("".join(now))
        now, row = [], row + 1
    if now and out:
        out[-1] += "".join(now)
    return out


SOLVED_SCHEMA = "conv_id {kind}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, " \
    "parts array<struct<part:int,at:bigint,edits:array<string>>>"
_PARTS = pa.list_(pa.struct([("part", pa.int32()), ("at", pa.int64()), ("edits", pa.list_(pa.string()))]))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for pieces in batch.column("pieces").to_pylist():
            signs = "".join(p["signs"] for p in pieces)
            read = [read_symbol(s) for s in signs]
            counts = [sum(f == fault for f, _ in read) for fault in (BLANK, DUPLICATE, TRUNCATED)]
            illegal = sum(a + b not in LEGAL for (_, a), (_, b) in zip(read, read[1:], strict=False))
            cost, audit = cheapest(signs)
            edits, parts = script(signs, audit), []
            for p in pieces:
                parts.append({"part": p["part"], "at": p["at"], "edits": edits[: len(p["signs"])]})
                edits = edits[len(p["signs"]):]
            rows.append((*counts, illegal, cost, audit, parts))
        if rows:
            *columns, parts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *map(pa.array, columns), pa.array(parts, _PARTS)],
                                             names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "parts"])


class Repaired(NamedTuple):
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    report: DataFrame
    #: conv_id, part, at, step (in this order), edit, role, text
    rows: DataFrame


def repair(conversations: DataFrame) -> Repaired:
    """Faults and cheapest edits of every conversation, and the rows that the edits leave.

    ``conversations``: conv_id, turn, role, text. A null role or text is one space. Rows go by
    turn (null first), then role, then text; of rows equal in role and text the
    first is no duplicate. A null conv_id is a conversation. ``gaps`` counts the turns missing
    between the least and the greatest (0 if all are null). Roles other than those beginning
    with s, u or a can't be kept. ``edit`` is K, R or I. Other columns are ignored.
    """
    given = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    keys = ["conv_id", "turn", "role"]
    table = ordered(given, [*keys, "text"], "turns", [*keys, F.substring("text", 1, 64)])
    blank = ~F.col("text").rlike(WORD)
    first = table.filter(~blank).groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("part", "at")).alias("f")) \
        .select("f.part", "f.at", F.lit(True).alias("first"))
    cut = ~F.regexp_extract("text", f"({WORD})[\\x20\\x09-\\x0D]*\\z", 1).isin(".", "!", "?")
    fault = F.when(blank, BLANK).when(F.col("first").isNull(), DUPLICATE).when(cut, TRUNCATED).otherwise(NONE)
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS))
    kind = F.when((initial > 0) & (F.col("role") != ""), initial - 1).otherwise(3)
    sign = F.char((65 + 4 * fault + kind).cast("int"))
    signs = table.join(first, ["part", "at"], "left").groupBy("conv_id", "part") \
        .agg(F.sort_array(F.collect_list(F.struct("at", sign.alias("sign")))).alias("held")) \
        .select("conv_id", F.struct("part", F.col("held")[0]["at"].alias("at"), F.concat_ws("", "held.sign").alias("signs")).alias("piece"))
    pieces = signs.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    kind_of_id = table.schema["conv_id"].dataType.simpleString()
    solved = stored(pieces.mapInArrow(_solve, SOLVED_SCHEMA.format(kind=kind_of_id)), "audits")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = table.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    report = solved.join(gaps, solved["conv_id"].eqNullSafe(gaps["conv_id"])).select(
        solved["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = solved.select(F.explode("parts").alias("p")).select("p.part", "p.at", F.posexplode("p.edits").alias("pos", "edits")) \
        .select("part", (F.col("at") + F.col("pos")).alias("at"), "edits")

    def step(e):
        role = F.when(e == "K", F.col("role")).when(F.lower(e) == "u", F.lit("user")).otherwise(F.lit("assistant"))
        edit = F.when(e == "K", KEEP).when(e.isin("U", "A"), INSERT).otherwise(REROLE)
        return F.struct(edit.alias("edit"), role.alias("role"), F.when(e.isin("U", "A"), "").otherwise(F.col("text")).alias("text"))

    left = F.transform(F.filter(F.split("edits", ""), lambda e: ~e.isin("", "D")), step)
    rows = table.join(edits, ["part", "at"]).select("conv_id", "part", "at", F.posexplode(left).alias("step", "s")) \
        .select("conv_id", "part", "at", "step", "s.edit", "s.role", "s.text")
    return Repaired(report, rows)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines; its rows follow each other in order."""
    now, key = None, None
    for batch in batches:
        ids, out = batch.column("conv_id").to_pylist(), []
        for conv_id, role, text in zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if now is None or conv_id != key:
                if now is not None:
                    out.append((key, now.hexdigest()))
                now, key = hashlib.sha256(), conv_id
            else:
                now.update(b"\n")
            now.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.column("conv_id").type), pa.array([h for _, h in out])], names=["conv_id", "repaired_sha256"])
        kind = batch.column("conv_id").type
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([now.hexdigest()])], names=["conv_id", "repaired_sha256"])


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of repaired rows; texts are read in order, one at a time."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at", "step")
    return order.select("conv_id", "role", "text").mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")
