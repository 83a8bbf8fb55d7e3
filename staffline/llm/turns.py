"""Conversation repair: generalised LR parsing of the roles, with weighted edits.

The role sequence of a conversation must fit the grammar below (an optional system turn, then user and
assistant in turn). An LR automaton is built from the productions. Rows are read with a
graph-structured stack: every edit of a row (keep, rerole, delete) and every insertion in front of it is a
branch, and branches that reach the same stack top are merged into the one of least (cost, audit),
the audit being the initials of the edits. Two audits of equal cost that reach one top over the same rows
are never prefixes of each other (an insertion costs), so the least one stays least whatever
follows, and stacks with equal tops accept the same continuations in this grammar.

Rows are sorted by range over (conversation, turn, role, text), so a conversation that holds a third of
all rows is cut over many tasks. A conversation that lies inside one task and is short is repaired
there. Of the others every stretch of rows gives a table (top before, top after) -> (cost, audit); the
tables are folded in order, and the repaired rows then run through the hash one after another
(a digest of the whole conversation can only be made in order, so this streams, holding one row).

Defined results: a null text or role is one space, a null conversation or turn is one space in the key of the
damage and a value like any other elsewhere; turns sort with nulls first, equal turns by role and text;
equal rows are counted once and repeated where they are read; a conversation all of whose rows are dropped
stays with zeros; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.llm.store import parallelism, staged

#: Productions; the first is the start symbol's. Terminals are the initials of roles.
GRAMMAR = (("S", ()), ("S", ("P",)), ("S", ("s", "P")), ("P", ("u", "a")), ("P", ("P", "u", "a")))
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
CHUNK_ROWS, CHUNK_CHARS = 2048, 4 << 20  # a longer stretch of one conversation is handled as a part
SMALL = 100_000  # rows of a table that may be sent to all tasks
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Stack = tuple[int, ...]


class Automaton:
    """LR(0) states of a grammar, with the lookaheads at which each reduces (SLR)."""

    def __init__(self, productions=GRAMMAR):
        self.rules = [("", (productions[0][0],)), *productions]
        self.heads = {h for h, _ in self.rules}
        self.follow = self._follow()
        start = self._closure(frozenset({(0, 0)}))
        self.states, self.goto = [start], {}
        for n, state in enumerate(self.states):
            for symbol in sorted({self.rules[r][1][d] for r, d in state if d < len(self.rules[r][1])}):
                moved = self._closure(frozenset((r, d + 1) for r, d in state
                                                if d < len(self.rules[r][1]) and self.rules[r][1][d] == symbol))
                if moved not in self.states:
                    self.states.append(moved)
                self.goto[n, symbol] = self.states.index(moved)

    def _closure(self, items: frozenset) -> frozenset:
        found, todo = set(items), list(items)
        while todo:
            r, d = todo.pop()
            body = self.rules[r][1]
            for k, (head, _) in enumerate(self.rules):
                if d < len(body) and head == body[d] and (k, 0) not in found:
                    found.add((k, 0))
                    todo.append((k, 0))
        return frozenset(found)

    def _follow(self) -> dict[str, set[str]]:
        nullable = {h for h, b in self.rules if not b}
        first: dict[str, set[str]] = {h: set() for h in self.heads}
        follow: dict[str, set[str]] = {h: set() for h in self.heads} | {"": {"$"}}
        of = lambda x: first[x] if x in self.heads else {x}
        for _ in range(sum(len(b) + 1 for _, b in self.rules) * 4):  # to the fixed point
            for head, body in self.rules:
                if body:
                    first[head] |= of(body[0])
                    if all(x in nullable for x in body):
                        nullable.add(head)
                after = set(follow[head])
                for x in reversed(body):
                    if x in self.heads:
                        follow[x] |= after
                        after = first[x] | (after if x in nullable else set())
                    else:
                        after = {x}
        return follow

    def advance(self, stack: Stack, terminal: str) -> Stack | None:
        """The stack after all reductions that the terminal calls for and its shift; for ``$`` the stack that
        accepts; None where it doesn't fit."""
        while True:
            state = self.states[stack[-1]]
            if terminal == "$" and (0, 1) in state:
                return stack
            if (stack[-1], terminal) in self.goto:
                return (*stack, self.goto[stack[-1], terminal])
            done = [r for r, d in state if r and d == len(self.rules[r][1]) and terminal in self.follow[self.rules[r][0]]]
            if not done:
                return None
            head, body = self.rules[done[0]]
            stack = stack[:len(stack) - len(body)]
            stack = (*stack, self.goto[stack[-1], head])


class Repairer:
    """Edits over the automaton. Tops are states; each has one stack that stands for all with that top."""

    def __init__(self, automaton: Automaton | None = None):
        self.lr = automaton or Automaton()
        self.stacks: dict[int, Stack] = {0: (0,)}
        todo = [0]
        while todo:
            at = self.stacks[todo.pop()]
            for terminal in ("s", *ROLES):
                if (stack := self.lr.advance(at, terminal)) and stack[-1] not in self.stacks:
                    self.stacks[stack[-1]] = stack
                    todo.append(stack[-1])
        self.expected = {top: [t for t in ROLES if self.lr.advance(s, t)] for top, s in self.stacks.items()}
        self.final = {top: bool(self.lr.advance(s, "$")) for top, s in self.stacks.items()}
        self.steps: dict[tuple, list] = {}

    def shift(self, top: int, terminal: str) -> int | None:
        stack = self.lr.advance(self.stacks[top], terminal)
        return stack[-1] if stack else None

    def _inserted(self, top: int) -> list[tuple[int, int, str]]:
        """Tops reached by insertions alone, each by the cheapest: (top, cost, audit)."""
        best, todo = {top: (0, "")}, [top]
        while todo:
            at = todo.pop(0)
            for t in self.expected[at]:
                cost, audit = best[at]
                to, made = self.shift(at, t), (cost + INSERT, audit + "I")
                if to not in best or made < best[to]:
                    best[to] = made
                    todo.append(to)
        return [(t, *v) for t, v in best.items()]

    def moves(self, initial: str, must_go: bool, cut_off: bool) -> dict[int, list[tuple[int, int, str]]]:
        """From each top over one row: (top after, cost, audit), insertions in front included."""
        key = (initial if initial in ("s", *ROLES) else "", must_go, cut_off)
        if key not in self.steps:
            out: dict[int, list] = {}
            for top in self.stacks:
                best: dict[int, tuple[int, str]] = {}
                for at, cost, audit in self._inserted(top):
                    edits = [(at, DELETE, "D")]
                    if not must_go:
                        late = TRUNCATED * cut_off
                        edits += [(self.shift(at, key[0]), KEEP + late, "K")] if key[0] else []
                        edits += [(self.shift(at, t), REROLE + late, "R") for t in ROLES]
                    for to, more, initial_ in edits:
                        made = (cost + more, audit + initial_)
                        if to is not None and (to not in best or made < best[to]):
                            best[to] = made
                out[top] = [(to, *v) for to, v in best.items()]
            self.steps[key] = out
        return self.steps[key]

    @staticmethod
    def read(tops: dict[int, tuple[int, str]], moves: dict[int, list]) -> dict[int, tuple[int, str]]:
        """The next level of the graph-structured stack: equal tops are merged by least (cost, audit)."""
        out: dict[int, tuple[int, str]] = {}
        for top, (cost, audit) in tops.items():
            for to, more, edits in moves[top]:
                old = out.get(to)
                if old is None or cost + more <= old[0]:
                    made = (cost + more, audit + edits)
                    if old is None or made < old:
                        out[to] = made
        return out

    def close(self, tops: dict[int, tuple[int, str]]) -> tuple[int, str]:
        """Least (cost, audit) at the end, insertions there included."""
        return min((cost + more, audit + edits) for top, (cost, audit) in tops.items()
                   for to, more, edits in self._inserted(top) if self.final[to])

    def rows(self, audit: str) -> Callable[[str, str | None], list[str]]:
        """Replays an audit: the function takes each row (role, text) in order, then None twice at the end, and
        gives the repaired lines."""
        top, i = 0, 0

        def follow(role: str | None, text: str | None) -> list[str]:
            nonlocal top, i
            lines = []
            while i < len(audit):
                edit, i = audit[i], i + 1
                if edit == "D":
                    break
                if edit == "K":
                    top = self.shift(top, role[:1])
                    lines.append(f"{role}:{text}")
                    break
                t = self.expected[top][0]
                top = self.shift(top, t)
                lines.append(f"{ROLES[t]}:{text if edit == 'R' else ''}")
                if edit == "R":
                    break
            return lines

        return follow


@functools.lru_cache(maxsize=1)
def repairer() -> Repairer:
    return Repairer()


class Stretch:
    """What is known of consecutive rows of one conversation, without their texts."""

    def __init__(self, starts: list[int]):
        self.tops = {s: {s: (0, "")} for s in starts}
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.last_turn = None
        self.first = self.last = None

    def add(self, turn: int | None, role: str, fault: str) -> None:
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.n["illegal"] += 1
        self.last = initial
        if fault:
            self.n[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.n["turns"] += 1
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
        moves = repairer().moves(initial, fault in ("blank", "duplicate"), fault == "truncated")
        for start, tops in self.tops.items():
            self.tops[start] = Repairer.read(tops, moves)

    def packed(self) -> str:
        return json.dumps([{s: [[t, *v] for t, v in tops.items()] for s, tops in self.tops.items()}, self.n, self.low, self.high,
                           self.first, self.last])

    def follow(self, packed: str) -> None:
        """Appends a later stretch (packed) to this one, whose only start is the first."""
        table, n, low, high, first, last = json.loads(packed)
        moves = {int(s): [(t, c, a) for t, c, a in ends] for s, ends in table.items()}
        self.tops[0] = Repairer.read(self.tops[0], moves)
        for k, v in n.items():
            self.n[k] += v
        if first is not None:
            if self.first is None:
                self.first = first
            elif self.last + first not in LEGAL:
                self.n["illegal"] += 1
            self.last = last
        if low is not None:
            self.n["turns"] -= low == self.high
            self.low = low if self.low is None else self.low
            self.high = high

    def result(self) -> tuple[list[int], str]:
        """(gaps, blank, duplicate, truncated, illegal, cost) and the audit."""
        cost, audit = repairer().close(self.tops[0])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n["turns"]
        return [gaps, *[self.n[k] for k in COUNTS[1:5]], cost], audit


def digest(audit: str, rows: list[tuple[str, str | None]]) -> str:
    sha, replay, more = hashlib.sha256(), repairer().rows(audit), False
    for role, text in [*rows, (None, None)]:
        for line in replay(role, text):
            sha.update((("\n" if more else "") + line).encode())
            more = True
    return sha.hexdigest()


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, n: the rows after damage, ``n`` times each (0: the row is dropped, only its
    conversation stays)."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.pmod(F.crc32(F.concat_ws(":", spoken(conv), spoken(turn)).cast("binary")), F.lit(20))
    hurt = F.when(case == 1, F.lit("")).when(case == 2, F.regexp_replace(spoken(text), "[.!?]", "")).otherwise(spoken(text))
    gone = case == 0
    return conversations.select(
        F.col(conv).alias("conv"), F.when(~gone, F.col(turn).cast("long")).alias("turn"),
        F.when(gone, F.lit("")).when(case == 4, F.lit("user")).otherwise(spoken(role)).alias("role"),
        F.when(gone, F.lit("")).otherwise(hurt).alias("text"),
        F.when(gone, 0).when(case == 3, 2).otherwise(1).alias("n"))


def judged(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number, and what each is by itself and by its conversation: blank,
    whole (ends a sentence), again (its role and text stand at an earlier turn)."""
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("__d", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn").alias("turn"))
    seen = (rows.filter("n > 0").groupBy("conv", "role", "__d").agg(F.min(place).alias("at"), F.count("*").alias("c"))
            .filter("c > 1").select(F.col("conv").alias("__conv"), F.col("role").alias("__role"), F.col("__d").alias("__dd"), "at"))
    seen = staged(seen, "turns-repeated")
    if seen.count() <= SMALL:
        seen = F.broadcast(seen)
    both = rows.join(seen, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role"))
                     & (F.col("__d") == F.col("__dd")), "left")
    later = F.col("turn").isNotNull() & (~F.col("at.dated") | (F.col("turn") > F.col("at.turn")))
    return both.select("conv", "turn", "role", "text", "n", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                       F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("whole"),
                       F.coalesce(later, F.lit(False)).alias("again"))


WHOLE, PART, ROW = 0, 1, 2


def _repair_stretches(schema: T.StructType) -> Callable:
    """Sorted rows in, for each conversation its result (WHOLE) or, where it may go on in another task or is
    long, its stretches (PART) and rows (ROW; no text where it is deleted anyway)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tops = list(repairer().stacks)
        out: list[tuple] = []
        names = schema.names

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
            out.clear()
            return batch

        def spill(conv, rows: list, chunk: int) -> None:
            stretch = Stretch(tops)
            for k, (turn, role, text, fault) in enumerate(rows):
                stretch.add(turn, role, fault)
                out.append((ROW, conv, part, chunk, k, role, None if fault in ("blank", "duplicate") else text, None, None, None))
            out.append((PART, conv, part, chunk, 0, None, None, None, stretch.packed(), None))

        def finish(conv, rows: list) -> None:
            stretch = Stretch([0])
            for turn, role, _, fault in rows:
                stretch.add(turn, role, fault)
            counts, audit = stretch.result()
            out.append((WHOLE, conv, part, 0, 0, None, None, counts, audit, digest(audit, [(r, t) for _, r, t, _ in rows])))

        started = first = True
        conv, rows, chars, chunk, types = None, [], 0, 0, None
        for batch in batches:
            if types is None:
                types = [pa.int32(), batch.schema.field("conv").type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(),
                         pa.list_(pa.int64()), pa.string(), pa.string()]
            for lo in range(0, batch.num_rows, 256):
                d = batch.slice(lo, 256).to_pydict()
                for c, turn, role, text, n, blank, whole, again in zip(*[d[x] for x in (
                        "conv", "turn", "role", "text", "n", "blank", "whole", "again")], strict=True):
                    if started or c != conv:
                        if not started:
                            if first or chunk:
                                spill(conv, rows, chunk)
                            else:
                                finish(conv, rows)
                            first = False
                        started, conv, rows, chars, chunk = False, c, [], 0, 0
                    for k in range(n):
                        fault = "blank" if blank else "duplicate" if again or k else "" if whole else "truncated"
                        rows.append((turn, role, text, fault))
                        chars += len(text)
                        if len(rows) >= CHUNK_ROWS or chars >= CHUNK_CHARS:
                            spill(conv, rows, chunk)
                            yield flush()
                            rows, chars, chunk = [], 0, chunk + 1
                    if len(out) >= 4096:
                        yield flush()
        if not started:
            spill(conv, rows, chunk)
            yield flush()

    return run


def _fold(schema: T.StructType) -> Callable:
    """Stretches in order in, one row per conversation out: (conv, counts, audit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, stretch = False, None, None
        for batch in batches:
            types = [batch.schema.field("conv").type, pa.list_(pa.int64()), pa.string()]
            out: list[tuple] = []
            for c, packed in zip(batch.column("conv").to_pylist(), batch.column("told").to_pylist(), strict=True):
                if not started or c != conv:
                    if started:
                        out.append((conv, *stretch.result()))
                    started, conv, stretch = True, c, Stretch([0])
                stretch.follow(packed)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv, *stretch.result()), types, strict=True)], names=schema.names)

    return run


def _hash(schema: T.StructType) -> Callable:
    """The audit of a conversation, then its rows in order; (conv, counts, audit, hash) out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = replay = None

        def close() -> tuple:
            conv, counts, audit, sha, more = held
            for line in replay(None, None):
                sha.update((("\n" if more else "") + line).encode())
                more = True
            return conv, counts, audit, sha.hexdigest()

        for batch in batches:
            types = [batch.schema.field("conv").type, pa.list_(pa.int64()), pa.string(), pa.string()]
            out: list[tuple] = []
            for lo in range(0, batch.num_rows, 256):
                d = batch.slice(lo, 256).to_pydict()
                for kind, conv, role, text, counts, told in zip(*[d[x] for x in ("kind", "conv", "role", "text", "counts", "told")], strict=True):
                    if kind == WHOLE:
                        if held:
                            out.append(close())
                        held, replay = [conv, counts, told, hashlib.sha256(), False], repairer().rows(told)
                        continue
                    for line in replay(role, text):
                        held[3].update((("\n" if held[4] else "") + line).encode())
                        held[4] = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(close(), types, strict=True)], names=schema.names)

    return run


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``rows``: conv, turn, role, text, n (n copies; 0 only names the conversation). Per conversation: gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    n = parallelism(rows.sparkSession)
    conv = T.StructField("conv", rows.schema["conv"].dataType)
    counts, told = T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("told", T.StringType())
    integer = lambda c: T.StructField(c, T.IntegerType())
    text = lambda c: T.StructField(c, T.StringType())
    schema = T.StructType([integer("kind"), conv, integer("part"), integer("chunk"), integer("k"), text("role"), text("text"),
                           counts, told, text("sha")])
    ordered = (judged(rows).repartitionByRange(n, "conv", "turn", "role", F.substring("text", 1, 64))
               .sortWithinPartitions("conv", "turn", "role", "text"))
    out = staged(ordered.mapInArrow(_repair_stretches(schema), schema), "turns-stretches")
    parts = out.filter(F.col("kind") == PART).select("conv", "part", "chunk", "told").repartition(n, "conv")
    folded = parts.sortWithinPartitions("conv", "part", "chunk").mapInArrow(
        _fold(T.StructType([conv, counts, told])), T.StructType([conv, counts, told]))
    left = out.filter(F.col("kind") == ROW).select("kind", "conv", "part", "chunk", "k", "role", "text", "counts", "told")
    first = folded.select(F.lit(WHOLE).alias("kind"), "conv", F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("chunk"),
                          F.lit(None).cast("int").alias("k"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text"), "counts", "told")
    result = T.StructType([conv, counts, told, text("sha")])
    hashed = (first.unionByName(left).repartition(n, "conv").sortWithinPartitions("conv", "kind", "part", "chunk", "k")
              .mapInArrow(_hash(result), result))
    every = out.filter(F.col("kind") == WHOLE).select("conv", "counts", "told", "sha").unionByName(hashed)
    return every.select(F.col("conv").alias(conv_col), *[F.col("counts")[i].alias(c) for i, c in enumerate(COUNTS)],
                        F.col("told").alias("audit"), F.col("sha").alias("repaired_sha256"))


def repair_damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """Damages the rows by the contract's rule and repairs every conversation."""
    return repair_conversations(damaged(conversations, conv, turn, role, text), conv)


def intact(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as they are, in the form ``repair_conversations`` takes."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spoken(role).alias("role"),
                                spoken(text).alias("text"), F.lit(1).alias("n"))


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) of rows given as (role, fault): the parser by itself."""
    stretch = Stretch([0])
    for role, fault in rows:
        stretch.add(None, role, fault)
    counts, audit = stretch.result()
    return counts[-1], audit
