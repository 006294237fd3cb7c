"""Conversation structure repair: cheapest edits, least audit, by a persistent audit DP.

A conversation's rows, in order, are kept (K), given another role (R), deleted
(D) or have empty rows inserted before them (I), so that the initials of the
roles read ``(s?(ua)+)?``.  Its automaton has four states (nothing yet, after s,
after u, after a).  For every row and state the DP holds the least cost and, of
the audits of that cost, the ASCII-least.  Audits are linked nodes that share
their prefixes; a node knows its ancestors 1, 2, 4, ... letters back and a
rolling hash of its letters.  Equal costs are compared at the end of the longest
common prefix, found by halving over the ancestors' hashes; the prefix is then
verified letter by letter back to the first shared node, and two audits whose
hashes collide are compared as plain text.

An audit decides the states it passes, so no audit is a proper prefix of another
of the same rows, cost and state (the rest would be inserts, which cost more):
the least audit so far stays the least.

Scale: rows are dealt by ranges of (conversation, turn, role, text), so that a
conversation of any size is spread over tasks.  What lies whole inside a range
and has at most ``BLOCK_ROWS`` rows and ``BLOCK_BYTES`` of text is repaired there.
The rest (at most two conversations a range, and the very large ones) is repaired
in blocks: a block gives, for every pair of states before and after it, cost,
rank and audit; a fold over these few numbers, one row a block, fixes the states
between blocks; the blocks' audits and texts follow.  Only the digest of a
conversation's repaired text is taken in one task, as a stream, since SHA-256 is
sequential; its audit is one cell of the result.

Defined cases: null conversation ids are one conversation; null turns come
first; rows of one turn go by role, then text; null role or text counts as one
space; a role that is empty has no initial and can't be kept; other columns of
the input are ignored; a conversation without rows left has zeros, an empty
audit and the digest of the empty text; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BLOCK_ROWS, BLOCK_BYTES = 50_000, 16 << 20
PREFIX = 32  # characters of role and text that take part in the choice of ranges
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
AFTER_INSERT = (2, 2, 3, 2)  # states: 0 nothing yet, 1 after s, 2 after u, 3 after a
AFTER_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE_INTO = {2: "user", 3: "assistant"}
TAIL = ("", "II", "I", "")  # inserts that end a conversation from each state
MODULUS, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)

_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


class Node:
    """The end of an audit: its last letter and the audit before it."""

    __slots__ = ("ancestors", "depth", "hash", "letter")

    def __init__(self, parent: Node | None, letter: str):
        self.letter = letter
        self.ancestors: list[Node] = []
        if parent is None:
            self.depth, self.hash = 0, 0
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * BASE + ord(letter)) % MODULUS
        up, j = parent, 0
        self.ancestors.append(up)
        while j < len(up.ancestors):  # the ancestor 2^(j+1) back is the one 2^j back of the one 2^j back
            up = up.ancestors[j]
            self.ancestors.append(up)
            j += 1

    def at(self, depth: int) -> Node:
        node = self
        while node.depth > depth:
            node = node.ancestors[(node.depth - depth).bit_length() - 1]
        return node

    def text(self) -> str:
        out, node = [], self
        while node.depth:
            out.append(node.letter)
            node = node.ancestors[0]
        return "".join(reversed(out))


def same(a: Node, b: Node) -> bool:
    """Whether two audits of one length are letter for letter equal; ends at the first node that they share."""
    while a is not b and a.depth:
        if a.letter != b.letter:
            return False
        a, b = a.ancestors[0], b.ancestors[0]
    return True


def less(a: Node, b: Node) -> bool:
    """Whether audit a comes before audit b."""
    depth = min(a.depth, b.depth)
    x, y = a.at(depth), b.at(depth)
    if x is not y and x.hash != y.hash:
        for j in reversed(range(len(x.ancestors))):
            if j < len(x.ancestors) and x.ancestors[j].hash != y.ancestors[j].hash:
                x, y = x.ancestors[j], y.ancestors[j]
        if same(x.ancestors[0], y.ancestors[0]):
            return x.letter < y.letter
        return a.text() < b.text()
    return a.depth < b.depth if same(x, y) else a.text() < b.text()


class Paths:
    """The best audit into each state, from one state, over the rows met so far."""

    def __init__(self, start: int):
        self.best: list[tuple[int, Node] | None] = [None] * 4
        self.best[start] = (0, Node(None, ""))

    @staticmethod
    def offer(best: list, state: int, cost: int, parent: Node, letter: str) -> None:
        now = best[state]
        if now is None or cost < now[0]:
            best[state] = (cost, Node(parent, letter))
        elif cost == now[0]:
            node = Node(parent, letter)
            if less(node, now[1]):
                best[state] = (cost, node)

    def inserts(self) -> None:
        for _ in range(2):  # a third insert would come back to a state that is cheaper without
            before = list(self.best)
            for state, path in enumerate(before):
                if path is not None:
                    self.offer(self.best, AFTER_INSERT[state], path[0] + INSERT, path[1], "I")

    def row(self, initial: str, fault: int) -> None:
        self.inserts()
        out: list[tuple[int, Node] | None] = [None] * 4
        extra = TRUNCATED if fault == CUT else 0
        for state, path in enumerate(self.best):
            if path is None:
                continue
            cost, node = path
            self.offer(out, state, cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            if (kept := AFTER_KEEP[state].get(initial)) is not None:
                self.offer(out, kept, cost + KEEP + extra, node, "K")
            self.offer(out, AFTER_INSERT[state], cost + REROLE + extra, node, "R")
        self.best = out


def text_fault(text: str) -> int:
    last = _LAST.search(text)
    return BLANK if last is None else NONE if last[1] in ".!?" else CUT


class Facts:
    """Counts of a stretch of rows and what its neighbours need to know of its ends."""

    FIELDS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")

    def __init__(self):
        self.count = dict.fromkeys(self.FIELDS, 0)
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        count = self.count
        if count["rows"]:
            count["illegal"] += self.last_initial + initial not in ("su", "ua", "au")
        else:
            self.first_initial = initial
        count["rows"] += 1
        self.last_initial = initial
        if fault:
            count[(None, "blank", "duplicate", "truncated")[fault]] += 1
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            count["turns"] += turn != self.last_turn
            self.last_turn = turn

    def follow(self, later: Facts) -> None:
        """Take in the facts of the stretch that comes next."""
        count = self.count
        if not later.count["rows"]:
            return
        joint = count["rows"] and self.last_initial + later.first_initial not in ("su", "ua", "au")
        shared = later.first_turn is not None and later.first_turn == self.last_turn
        for name in self.FIELDS:
            count[name] += later.count[name]
        count["illegal"] += int(joint)
        count["turns"] -= int(shared)
        self.first_initial = later.first_initial if self.first_initial is None else self.first_initial
        self.last_initial = later.last_initial
        self.first_turn = later.first_turn if self.first_turn is None else self.first_turn
        self.last_turn = later.last_turn if later.last_turn is not None else self.last_turn

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.count["turns"]

    def packed(self) -> dict:
        return self.count | {"first_turn": self.first_turn, "last_turn": self.last_turn, "first_initial": self.first_initial, "last_initial": self.last_initial}

    @classmethod
    def unpacked(cls, d: dict) -> Facts:
        out = cls()
        out.count = {name: d[name] for name in cls.FIELDS}
        out.first_turn, out.last_turn, out.first_initial, out.last_initial = d["first_turn"], d["last_turn"], d["first_initial"], d["last_initial"]
        return out


def lines(letters: str, rows, state: int):
    """The repaired lines that a piece of audit makes of its rows, from a state on."""
    rows = iter(rows)
    for letter in letters:
        role, text = (None, "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        state = AFTER_KEEP[state][role[:1]] if letter == "K" else AFTER_INSERT[state]
        yield f"{role if letter == 'K' else ROLE_INTO[state]}:{text}"


class Digest:
    """SHA-256 of lines joined by line feeds, as they come; the text too if asked."""

    def __init__(self, keep: bool):
        self.sha, self.some, self.kept = hashlib.sha256(), False, [] if keep else None

    def add(self, line: str) -> None:
        self.sha.update(("\n" if self.some else "").encode() + line.encode())
        self.some = True
        if self.kept is not None:
            self.kept.append(line)


_FACTS = T.StructType([*[T.StructField(n, T.LongType()) for n in Facts.FIELDS],
                       T.StructField("first_turn", T.LongType()), T.StructField("last_turn", T.LongType()),
                       T.StructField("first_initial", T.StringType()), T.StructField("last_initial", T.StringType())])
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = T.StructType([*[T.StructField(n, T.LongType()) for n in _COUNTS], T.StructField("audit", T.StringType()),
                        T.StructField("repaired_sha256", T.StringType()), T.StructField("repaired", T.StringType())])


def _result(facts: Facts, cost: int, audit: str, digest: Digest) -> dict:
    return {"gaps": facts.gaps(), **{n: facts.count[n] for n in _COUNTS[1:5]}, "cost": cost, "audit": audit,
            "repaired_sha256": digest.sha.hexdigest(), "repaired": "\n".join(digest.kept) if digest.kept is not None else None}


def repaired(rows: list[tuple], keep: bool = False) -> dict:
    """One conversation's result from its rows (turn, role, text, copies) in order."""
    facts, paths, seen, content = Facts(), Paths(0), set(), []
    for turn, role, text, copies in rows:
        for _ in range(copies):
            fault = text_fault(text)
            if fault != BLANK and (role, text) in seen:
                fault = DUPLICATE
            seen.add((role, text))
            facts.add(turn, role[:1], fault)
            paths.row(role[:1], fault)
            content.append((role, text))
    paths.inserts()
    ends = [p for p in (paths.best[0], paths.best[3]) if p is not None]
    cost, node = functools.reduce(lambda a, b: b if b[0] < a[0] or (b[0] == a[0] and less(b[1], a[1])) else a, ends)
    audit, digest = node.text(), Digest(keep)
    for line in lines(audit, content, 0):
        digest.add(line)
    return _result(facts, cost, audit, digest)


def _stream(batches, groups: int):
    """(values of the first ``groups`` columns, the rest) of every row, in order."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            yield row[:groups], row[groups:]


def _out(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _whole_or_open(schema: pa.Schema, keep: bool, most_rows: int, most_bytes: int):
    """Rows sorted by conversation: a result for each that lies whole inside the range, else its rows in numbered blocks."""
    def run(batches):
        segment = TaskContext.get().partitionId()
        out, weight = [], 0

        def opened(key, block, held):
            return [{"open": True, "id": key, "seg": segment, "blk": block, "pos": i, "turn": r[0], "role": r[1], "text": r[2], "copies": r[3]} for i, r in enumerate(held)]

        key, held, size, block, first = None, [], 0, -1, True  # block: the last one put out, -1 if none
        for (new,), row in _stream(batches, 1):
            if key is None or key[0] != new:
                if key is not None:
                    out += opened(key[0], block + 1, held) if first or block >= 0 else [{"open": False, "id": key[0], "result": repaired(held, keep)}]
                    weight += size
                    first = False
                key, held, size, block = (new,), [], 0, -1
            held.append(row)
            size += len(row[1]) + len(row[2])
            if len(held) >= most_rows or size >= most_bytes:
                out += opened(new, block + 1, held)
                weight += size
                held, size, block = [], 0, block + 1
            if len(out) >= 4096 or weight >= most_bytes:
                yield _out(out, schema)
                out, weight = [], 0
        if key is not None and (held or block < 0):
            out += opened(key[0], block + 1, held)
        yield _out(out, schema)
    return run


def _blocks(schema: pa.Schema):
    """Rows sorted by (conversation, segment, block, place), duplicates marked: facts, costs, ranks and audits of each block."""
    def run(batches):
        key, facts, paths = None, None, None

        def closed():
            costs, ranks, audits = [], [], []
            for start in paths:
                ends = [q for q in range(4) if start.best[q] is not None]
                order = sorted(ends, key=functools.cmp_to_key(lambda a, b, s=start: -1 if less(s.best[a][1], s.best[b][1]) else 1))
                costs += [start.best[q][0] if q in ends else None for q in range(4)]
                ranks += [order.index(q) if q in ends else None for q in range(4)]
                audits += [start.best[q][1].text() if q in ends else None for q in range(4)]
            return _out([{"id": key[0], "seg": key[1], "blk": key[2], "facts": facts.packed(), "costs": costs, "ranks": ranks, "audits": audits}], schema)

        for new, (_, turn, role, text, copies, late) in _stream(batches, 3):
            if new != key:
                if key is not None:
                    yield closed()
                key, facts, paths = new, Facts(), [Paths(s) for s in range(4)]
            for copy in range(copies):
                fault = text_fault(text)
                if fault != BLANK and (late or copy):
                    fault = DUPLICATE
                facts.add(turn, role[:1], fault)
                for path in paths:
                    path.row(role[:1], fault)
        if key is not None:
            yield closed()
    return run


def choose(blocks: list[tuple[list, list]]) -> tuple[int, list[tuple[int, int]]]:
    """Least cost and the states before and after each block, from the blocks' (costs, ranks) in order."""
    togo = [2 * len(tail) for tail in TAIL]
    after = [togo]
    for costs, _ in reversed(blocks):
        togo = [min((costs[4 * p + q] + togo[q] for q in range(4) if costs[4 * p + q] is not None), default=1 << 62) for p in range(4)]
        after.append(togo)
    after.reverse()
    state, steps = 0, []
    for (costs, ranks), rest in zip(blocks, after[1:]):
        ends = [q for q in range(4) if costs[4 * state + q] is not None]
        end = min(ends, key=lambda q: (costs[4 * state + q] + rest[q], ranks[4 * state + q]))
        steps.append((state, end))
        state = end
    return after[0][0], steps


def _choices(schema: pa.Schema):
    """Blocks sorted by (conversation, segment, block): the states of each, and on the last one the conversation's facts."""
    def run(batches):
        key, held = None, []

        def closed():
            cost, steps = choose([(costs, ranks) for _, _, _, costs, ranks in held])
            facts = Facts()
            for _, _, f, _, _ in held:
                facts.follow(Facts.unpacked(f))
            last = len(held) - 1
            return _out([{"id": key[0], "seg": s, "blk": b, "start": p, "end": q, "cost": cost if i == last else None, "facts": facts.packed() if i == last else None}
                         for i, ((s, b, _, _, _), (p, q)) in enumerate(zip(held, steps))], schema)

        for new, row in _stream(batches, 1):
            if key is not None and new != key:
                yield closed()
                held = []
            key = new
            held.append(row)
        if key is not None:
            yield closed()
    return run


def _finish(schema: pa.Schema, keep: bool):
    """Rows sorted by (conversation, segment, block, place), each block led by its piece of audit: a result a conversation."""
    def run(batches):
        key, digest, audit, pending = None, None, [], None

        def block_rows(stream):
            """The rows of the current block, up to the next block's lead, which stays pending."""
            nonlocal pending
            for pending in stream:
                if pending[1][0] < 0:
                    return
                _, _, role, text, copies, *_ = pending[1]
                for _ in range(copies):
                    yield role, text
            pending = None

        stream = _stream(batches, 3)
        pending = next(stream, None)
        while pending is not None:
            (new, _, _), (_, _, _, _, _, piece, start, end, cost, facts) = pending
            if key is None or key[0] != new:
                key, digest, audit = (new,), Digest(keep), []
            rows = block_rows(stream)
            for line in lines(piece, rows, start):
                digest.add(line)
            for _ in rows:  # a piece has a letter for every row; this only moves on to the next lead
                raise RuntimeError("an audit ended before its block")
            audit.append(piece)
            if facts is not None:
                for line in lines(TAIL[end], (), end):
                    digest.add(line)
                yield _out([{"id": new, "result": _result(Facts.unpacked(facts), cost, "".join(audit) + TAIL[end], digest)}], schema)
    return run


def repair(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           copies_col: str | None = None, keep: tuple[str, ...] = ("repaired",), block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and, if kept, the repaired text.

    ``copies_col`` counts how often a row stands at its place (0: it is missing, though its conversation is still named).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    src = C.pick(conversations, id=conv_col, turn=turn_col, role=role_col, text=text_col, **({"copies": copies_col} if copies_col else {}))
    copies = F.coalesce(F.col("copies").cast("int"), F.lit(1)) if copies_col else F.lit(1)
    rows = src.select("id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                      F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), copies.alias("copies"))
    ident = T.StructField("id", C.column_type(src, "id"))
    place = [T.StructField("seg", T.IntegerType()), T.StructField("blk", T.IntegerType())]
    order = ["id", "turn", "role", "text", "copies"]
    dealt = (rows.repartitionByRange("id", "turn", F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX)).sortWithinPartitions(*order))
    first = T.StructType([T.StructField("open", T.BooleanType()), ident, T.StructField("result", _RESULT), *place, T.StructField("pos", T.IntegerType()),
                          T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                          T.StructField("copies", T.IntegerType())])
    wanted = "repaired" in keep
    done = C.written(dealt.mapInArrow(_whole_or_open(to_arrow_schema(first), wanted, block_rows, block_bytes), first), "repair-first")

    # what ranges cut: duplicates by an aggregate, then block by block
    parts = done.where("open").select("id", "seg", "blk", "pos", "turn", "role", "text", "copies")
    spot = F.struct("seg", "blk", "pos")
    marked = parts.withColumn("digest", F.sha2("text", 256))
    firsts = (marked.where("copies > 0").groupBy("id", "role", "digest").agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select(F.col("id").alias("of"), F.col("role").alias("by"), F.col("digest").alias("what"), "first"))
    late = (marked.join(firsts, marked["id"].eqNullSafe(firsts["of"]) & (marked["role"] == firsts["by"]) & (marked["digest"] == firsts["what"]), "left")
            .select(*parts.columns, F.coalesce(F.col("first") != spot, F.lit(False)).alias("late")))
    block = T.StructType([ident, *place, T.StructField("facts", _FACTS), T.StructField("costs", T.ArrayType(T.LongType())),
                          T.StructField("ranks", T.ArrayType(T.IntegerType())), T.StructField("audits", T.ArrayType(T.StringType()))])
    blocks = C.written(late.repartition("id", "seg", "blk").sortWithinPartitions("id", "seg", "blk", "pos")
                       .mapInArrow(_blocks(to_arrow_schema(block)), block), "repair-blocks")
    choice = T.StructType([ident, *place, T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                           T.StructField("cost", T.LongType()), T.StructField("facts", _FACTS)])
    chosen = (blocks.select("id", "seg", "blk", "facts", "costs", "ranks").repartition("id").sortWithinPartitions("id", "seg", "blk")
              .mapInArrow(_choices(to_arrow_schema(choice)), choice))
    c, b = chosen.alias("c"), blocks.alias("b")
    leads = (c.join(b, F.col("c.id").eqNullSafe(F.col("b.id")) & (F.col("c.seg") == F.col("b.seg")) & (F.col("c.blk") == F.col("b.blk")))
             .select("c.id", "c.seg", "c.blk", F.lit(-1).alias("pos"), F.get("b.audits", 4 * F.col("c.start") + F.col("c.end")).alias("piece"),
                     "c.start", "c.end", "c.cost", "c.facts"))
    both = (parts.unionByName(leads, allowMissingColumns=True)
            .select("id", "seg", "blk", "pos", "turn", "role", "text", "copies", "piece", "start", "end", "cost", "facts")
            .repartition("id").sortWithinPartitions("id", "seg", "blk", "pos"))
    last = T.StructType([ident, T.StructField("result", _RESULT)])
    rest = both.mapInArrow(_finish(to_arrow_schema(last), wanted), last)
    names = [*_COUNTS, "audit", "repaired_sha256", *["repaired"] * wanted]
    return done.where("not open").select("id", "result").unionByName(rest).select(F.col("id").alias(conv_col), *[f"result.{n}" for n in names])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with one fault in four, chosen by the CRC-32 of ``conv_id:turn``; ``copies`` tells missing and repeated ones."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"])) % 20
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(text["role"]).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text["text"], ".!?", "")).otherwise(text["text"]).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(C.table(spark, sf_dir, "conversations")), copies_col="copies", keep=())


def _sql() -> str:
    """A recursion over the rows of every conversation; a state is (cost, audit, lines), so that ``list_min`` breaks ties by audit."""
    def step(state: str, cost: str, letter: str, line: str | None = None) -> str:
        out = f"list_append({state}.t, {line})" if line else f"{state}.t"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {out}}} END"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def inserted(states: list[str]) -> tuple[str, str]:
        s0, s1, s2, s3 = states
        into_u = least(s2, *[step(s, "2", "I", "'user:'") for s in (s0, s1, s3)])
        return into_u, least(s3, step(s2, "2", "I", "'assistant:'"))

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN r.fault NOT IN (1, 2) AND r.ini = '{initial}' THEN {step(state, 'r.extra', 'K', chr(114) + '.line')} END"

    def rerole(state: str, role: str) -> str:
        return f"CASE WHEN r.fault NOT IN (1, 2) THEN {step(state, '2 + r.extra', 'R', chr(39) + role + ':' + chr(39) + ' || r.text')} END"

    u1, a1 = inserted(["p.s0", "p.s1", "p.s2", "p.s3"])
    blank = "{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}"
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]))"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS v FROM range(256) x(b))),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM conversations, crc),
damage AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM damage),
rows_ AS (
  SELECT *, left(role, 1) AS ini, role || ':' || text AS line,
         CASE WHEN final = '' THEN 1 WHEN nth > 1 THEN 2 WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         CASE WHEN final NOT IN ('', '.', '!', '?') AND nth = 1 THEN 1 ELSE 0 END AS extra,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM placed),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {blank} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM facts
  UNION ALL
  SELECT p.conv_id, r.n,
         {step('p.s0', '3', 'D')},
         {least(step('p.s1', '3', 'D'), kept('p.s0', 's'))},
         {least(step('p.u', '3', 'D'), *[kept(s, 'u') for s in ('p.s0', 'p.s1', 'p.a')], *[rerole(s, 'user') for s in ('p.s0', 'p.s1', 'p.a')])},
         {least(step('p.a', '3', 'D'), kept('p.u', 'a'), rerole('p.u', 'assistant'))}
  FROM (SELECT conv_id, n, s0, s1, u, {least('a', step('u', '2', 'I', "'assistant:'"))} AS a
        FROM (SELECT p.conv_id, p.n, p.s0, p.s1, {u1} AS u, {a1} AS a FROM path p)) p
  JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1),
ends AS (
  SELECT f.conv_id, {least('s0', 's3', step('s2', '2', 'I', "'assistant:'"), "CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 4, 'a': s1.a || 'II', 't': list_concat(s1.t, ['user:', 'assistant:'])} END")} AS e
  FROM path p JOIN facts f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit,
       sha256(coalesce(array_to_string(e.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _sql()
