"""Repair of damaged conversations at least cost, with an audit trail of the edits.

A repaired conversation has role initials `(s?(ua)+)?`. An automaton of four states reads them: 0 nothing yet, 1 after a
system row, 2 after a user row, 3 after an assistant row; 0 and 3 may end. Every state takes exactly one of user and
assistant next, so an audit string (D delete, I insert, K keep, R give another role) says all about a repair. The
programme over rows and states keeps for each state the least (cost, audit), in ASCII order.

Audits are not copied: `Audits` shares prefixes as linked nodes. Ancestors by binary lifting and rolling hashes of
prefixes find the longest common prefix of two audits by bisection when costs tie, and what hashes call equal is verified.

A conversation may be of any length: its rows are dealt by ranges into chunks of at most `CHUNK` rows; chunks after
the first are solved from all four states, each where it lies, and a task then joins a conversation's chunks in
order, again by `Audits`, whose nodes now hold the audit of a whole chunk. Texts pass one task in order only to be hashed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeskein.llm._hot import left_join_split
from codeskein.llm._tables import Scratch, partitions
from codeskein.llm._words import _give_back

SPACES = " \t\n\x0b\x0c\r"
CHUNK, CHUNK_BYTES = 1024, 4 << 20
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Fault of a row; a row's code is 4 * its role (s, u, a, other) + its fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: The state after a row of the role, where the role may stand; and the role that may always come next.
KEEPS = [{0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2}]
NEXT, ROLE = [2, 2, 3, 2], ["user", "user", "assistant", "user"]
ENDS = (0, 3)


class Audits:
    """Strings that share their prefixes: node 0 is empty, every other node adds a label to its parent's string."""

    def __init__(self, base: int = 1_000_003, modulus: int = (1 << 61) - 1):
        self.base, self.modulus = base, modulus
        self.label, self.depth, self.hash = [""], [0], [0]
        self.up: list[tuple[int, ...]] = [()]
        self._verified: set[tuple[int, int, int]] = set()

    def add(self, parent: int, label: str) -> int:
        """The node of the parent's string and then `label`, which is not empty."""
        node, jumps, k = len(self.label), [parent], 0
        while len(self.up[jumps[k]]) > k:
            jumps.append(self.up[jumps[k]][k])
            k += 1
        self.up.append(tuple(jumps))
        self.label.append(label)
        self.depth.append(self.depth[parent] + len(label))
        self.hash.append(self._extended(self.hash[parent], label))
        return node

    def _extended(self, h: int, label: str) -> int:
        for c in label:
            h = (h * self.base + ord(c)) % self.modulus
        return h

    def _holding(self, node: int, length: int) -> int:
        """The ancestor, or the node, that is the first on its path with at least `length` characters."""
        for k in range(len(self.up[node]) - 1, -1, -1):
            if k < len(self.up[node]) and self.depth[self.up[node][k]] >= length:
                node = self.up[node][k]
        return node

    def _head(self, node: int, length: int) -> int:
        """The hash of the first `length` characters."""
        node = self._holding(node, length)
        if self.depth[node] == length:
            return self.hash[node]
        parent = self.up[node][0]
        return self._extended(self.hash[parent], self.label[node][: length - self.depth[parent]])

    def text(self, node: int, length: int | None = None, until: int = 0) -> str:
        """The characters from `until` to `length`."""
        length = self.depth[node] if length is None else length
        parts, node = [], self._holding(node, length)
        while node and self.depth[node] > until:
            start = self.depth[self.up[node][0]]
            parts.append(self.label[node][max(0, until - start) : max(0, length - start)])
            node = self.up[node][0]
        return "".join(reversed(parts))

    def _meeting(self, a: int, b: int) -> int:
        """Characters up to the last common node of two paths."""
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.up[a][0]
            else:
                b = self.up[b][0]
        return self.depth[a]

    def _same(self, a: int, b: int, length: int) -> bool:
        """Whether the first `length` characters agree; equal hashes are verified on what the two do not share."""
        a, b = self._holding(a, length), self._holding(b, length)
        if a == b:
            return True
        if self._head(a, length) != self._head(b, length):
            return False
        key = (min(a, b), max(a, b), length)
        if key not in self._verified:
            shared = self._meeting(a, b)
            if self.text(a, length, shared) != self.text(b, length, shared):
                return False
            self._verified.add(key)
        return True

    def common(self, a: int, b: int) -> int:
        """Length of the longest common prefix."""
        low, high = 0, min(self.depth[a], self.depth[b])
        if self._same(a, b, high):
            return high
        while high - low > 1:
            middle = (low + high) // 2
            if self._same(a, b, middle):
                low = middle
            else:
                high = middle
        return low

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's."""
        n = self.common(a, b)
        if n in (self.depth[a], self.depth[b]):
            return self.depth[a] < self.depth[b]
        return self.text(a, n + 1, n) < self.text(b, n + 1, n)


def _better(audits: Audits, best: dict, to: int, cost: int, parent: int, label: str) -> bool:
    """Note a way to a state if it is the least so far."""
    have = best.get(to)
    if have is not None and have[0] < cost:
        return False
    node = audits.add(parent, label) if label else parent
    if have is not None and have[0] == cost and not audits.less(node, have[1]):
        return False
    best[to] = (cost, node)
    return True


def _inserted(audits: Audits, best: dict) -> dict:
    """Insertions after a row, until none is better."""
    open_ = list(best)
    while open_:
        q = open_.pop()
        cost, node = best[q]
        if _better(audits, best, NEXT[q], cost + INSERT, node, "I"):
            open_.append(NEXT[q])
    return best


def solved(codes: str, start: int, first: bool, audits: Audits | None = None) -> dict[int, tuple[int, str]]:
    """State at the end to the least (cost, audit) of rows read from a state; `first`: insertions may come before them."""
    audits = Audits() if audits is None else audits
    best = {start: (0, 0)}
    if first:
        best = _inserted(audits, best)
    for code in codes:
        role, fault = divmod(ord(code) - 65, 4)
        then: dict[int, tuple[int, int]] = {}
        for q, (cost, node) in best.items():
            _better(audits, then, q, cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            more = TRUNCATED if fault == CUT else 0
            if role in KEEPS[q]:
                _better(audits, then, KEEPS[q][role], cost + more, node, "K")
            _better(audits, then, NEXT[q], cost + more + REROLE, node, "R")
        best = _inserted(audits, then)
    return {q: (cost, audits.text(node)) for q, (cost, node) in best.items()}


@lru_cache(maxsize=50_000)
def solved_first(codes: str) -> dict[int, tuple[int, str]]:
    return solved(codes, 0, True)


def joined(chunks: list[dict[int, dict[int, tuple[int, str]]]]) -> list[tuple[int, str]]:
    """(cost, audit) of every chunk on the least way through all; a chunk maps start state to `solved`."""
    audits = Audits()
    best: dict[int, tuple[int, int]] = {0: (0, 0)}
    where: dict[int, tuple[int, int]] = {}
    for table in chunks:
        then: dict[int, tuple[int, int]] = {}
        for q, (cost, node) in best.items():
            for to, (more, audit) in table[q].items():
                if _better(audits, then, to, cost + more, node, audit):
                    where[then[to][1]] = (q, more)
        best = then
    cost, node = min((c, i) for q, (c, i) in best.items() if q in ENDS)
    for q in ENDS:
        if q in best and best[q][0] == cost and best[q][1] != node and audits.less(best[q][1], node):
            node = best[q][1]
    steps = []
    while node:
        steps.append((where[node][1], audits.label[node]))
        node = audits.up[node][0]
    return steps[::-1]


# --- tables ---


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after damage by the remainder of crc32(`conv_id:turn`) by 20.

    Nulls in role and text, and in the text that is hashed, count as one space. Rows that go stay as marks (`gone`).
    """

    def spaced(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    harm = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))), F.lit(20))
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") == 0).alias("gone"), F.explode(times).alias("time"))
    return out.drop("time")


PACKED = "conv_id long, block long, later boolean, turns array<long>, roles array<string>, texts array<string>, codes array<int>, marks array<binary>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as chunks: runs of one conversation of at most CHUNK rows and about CHUNK_BYTES. `later`: maybe not the first of it."""
    block, last = TaskContext.get().partitionId() << 33, "unknown"
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_pylist()
        size = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False)
        cuts, held = [0], 0
        for i in range(1, len(ids)):
            held += int(size[i - 1])
            if ids[i] != ids[i - 1] or i - cuts[-1] >= CHUNK or held >= CHUNK_BYTES:
                cuts.append(i)
                held = 0
        later = [last == "unknown" or ids[0] == last, *(ids[c] == ids[c - 1] for c in cuts[1:])]
        here = pc.invert(batch.column(4))
        n = np.concatenate([[0], np.cumsum(here.to_numpy(zero_copy_only=False))])[[*cuts, len(ids)]].astype(np.int32)
        rows = batch.filter(here)
        lists = [pa.ListArray.from_arrays(pa.array(n), rows.column(i)) for i in (1, 2, 3, 5, 6)]
        blocks = pa.array(range(block, block + len(cuts)), pa.int64())
        block, last = block + len(cuts), ids[-1]
        columns = [batch.column(0).take(pa.array(cuts)), blocks, pa.array(later), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "later", "turns", "roles", "texts", "codes", "marks"])
    _give_back()


SOLVED = "conv_id long, block long, codes string, ways array<struct<start: int, stop: int, cost: long, audit: string>>"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks that may not be the first of their conversation, the best ways from every state to every state."""
    for batch in batches:
        got = batch.to_pydict()
        ways = [
            [{"start": q, "stop": to, "cost": cost, "audit": audit} for q in range(4) for to, (cost, audit) in solved(codes, q, False).items()] if later else []
            for codes, later in zip(got["codes"], got["later"])
        ]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(ways, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "codes", "ways"])


COUNTS = ("blank", "duplicate", "truncated", "illegal")
PLANS = "conv_id long, block long, audit string, cost long, blank long, duplicate long, truncated long, illegal long"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def plans(rows: list[tuple[int, str, list[dict]]]) -> list[tuple[int, str, int, int, int, int, int]]:
    """Of the chunks (block, codes, ways) of a conversation: block, audit, cost and faults of each."""
    if len(rows) == 1:
        ends = solved_first(rows[0][1])
        steps = [min(ends[q] for q in ENDS if q in ends)]
    else:
        tables = [{0: solved_first(rows[0][1])}]
        for _, _, ways in rows[1:]:
            table: dict[int, dict[int, tuple[int, str]]] = {}
            for w in ways:
                table.setdefault(w["start"], {})[w["stop"]] = (w["cost"], w["audit"])
            tables.append(table)
        steps = joined(tables)
    out, before = [], None
    for (block, codes, _), (cost, audit) in zip(rows, steps):
        roles, faults = zip(*(divmod(ord(c) - 65, 4) for c in codes))
        pairs = zip(roles if before is None else (before, *roles), roles[1:] if before is None else roles)
        illegal = sum(p not in _LEGAL for p in pairs)
        out.append((block, audit, cost, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal))
        before = roles[-1]
    return out


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of (conversation, block) to the plan of each."""
    names = [part.split()[0] for part in PLANS.split(", ")]
    held: list[tuple[int, str, list[dict]]] = []
    last = None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    out: list[tuple] = []
    for batch in batches:
        for conv, block, codes, ways in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held and conv != last:
                out += [(last, *p) for p in plans(held)]
                held = []
            last = conv
            held.append((block, codes, ways))
        if out:
            yield batch_of(out)
            out = []
    if held:
        yield batch_of([(last, *p) for p in plans(held)])
    _give_back()


REPAIRED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class _Conversation:
    """What a conversation's chunks add up to, in order; texts are hashed and let go."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.hash, self.lines = conv_id, 0, hashlib.sha256(), 0
        self.first = self.last = None
        self.turns, self.audits, self.sums = 0, [], [0] * 5
        self.plan: list[str] = []

    def planned(self, audit: str, sums: list[int]) -> None:
        self.audits.append(audit)
        self.sums = [a + b for a, b in zip(self.sums, sums)]
        self.plan = re.findall("^I+|[DKR]I*", audit)

    def _say(self, line: str) -> None:
        self.hash.update((("\n" if self.lines else "") + line).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _insert(self, marks: str) -> None:
        for _ in marks:
            self._say(f"{ROLE[self.state]}:")
            self.state = NEXT[self.state]

    def read(self, turns: list, roles: list[str], texts: list[str]) -> None:
        if self.plan and self.plan[0].startswith("I"):
            self._insert(self.plan.pop(0))
        for step, turn, role, text in zip(self.plan, turns, roles, texts):
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
            if step[0] == "K":
                self._say(f"{role}:{text}")
                self.state = KEEPS[self.state]["sua".index(role[0])]
            elif step[0] == "R":
                self._say(f"{ROLE[self.state]}:{text}")
                self.state = NEXT[self.state]
            self._insert(step[1:])

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, *faults = self.sums
        return (self.conv_id, gaps, *faults, cost, "".join(self.audits), self.hash.hexdigest())


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans and texts in order of (conversation, block), a chunk's plan first, to one row a conversation."""
    names = [part.split()[0] for part in REPAIRED.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    now, out = None, []
    for batch in batches:
        get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            conv = get["conv_id"][i].as_py()
            if now is None or conv != now.conv_id:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(conv)
            if get["audit"][i].is_valid:
                now.planned(get["audit"][i].as_py(), [get[c][i].as_py() for c in ("cost", *COUNTS)])
            else:
                now.read(*(get[c][i].as_py() for c in ("turns", "roles", "texts")))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(now.row(), kinds)], names=names)
    _give_back()


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of `rows` (conv_id, turn, role, text, gone): its faults, the least cost, the audit, the repaired text's hash.

    Rows are ordered by turn, null first, then by the SHA-256 of role and text; equal rows may change places. Rows with `gone` name a
    conversation and are else ignored: one without other rows has zeros, an empty audit and the hash of the empty string. A null
    conv_id is a conversation. Roles that begin with no s, u or a can only be given another role or deleted. Role and text
    are not null; other columns are not read. No rows give no rows.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    n = partitions(rows.sparkSession)
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    coded = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "gone",
        (role * 4 + fault).cast("int").alias("code"), F.unhex(F.sha2(said, 256)).alias("mark"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv_id", "turn", "mark", "tie"]
    dealt = coded.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie")
    packed = scratch.keep(dealt.mapInArrow(_packed, PACKED), "packed")

    each = packed.select("conv_id", "block", F.posexplode(F.arrays_zip("codes", "marks")).alias("pos", "it"))
    owner = F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))
    each = each.select("conv_id", "block", "pos", F.col("it.codes").alias("code"), F.unhex(F.sha2(F.concat(owner, F.lit(":"), F.hex("it.marks")), 256)).alias("mark"))
    each = scratch.keep(each, "each")
    place = F.struct("block", "pos")
    seen = each.groupBy("mark").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    met = left_join_split(each, seen, ["mark"], "times", each.count())
    again = F.coalesce(place > F.col("first"), F.lit(False)) & (F.col("code") % 4 != BLANK)
    code = F.when(again, F.col("code") - F.col("code") % 4 + DUPLICATE).otherwise(F.col("code"))
    met = met.select("block", F.struct("pos", F.char((code + 65).cast("long")).alias("code")).alias("it"))
    strings = met.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("it")), lambda x: x["code"]), "").alias("codes"))
    chunks = packed.select("conv_id", "block", "later").join(strings, "block").select("conv_id", "block", "later", "codes")
    ways = chunks.mapInArrow(_solved, SOLVED)
    ways = ways.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block")
    planned = scratch.keep(ways.mapInArrow(_planned, PLANS), "plans")

    texts = packed.select("conv_id", "block", "turns", "roles", "texts")
    both = planned.unionByName(texts, allowMissingColumns=True).withColumn("kind", F.col("audit").isNull())
    both = both.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block", "kind")
    return both.drop("kind").mapInArrow(_repaired, REPAIRED)
