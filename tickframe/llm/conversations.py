"""Repair of conversations whose rows were lost, repeated, cut off or given a wrong role.

Generalised LR repair. The roles of a sound conversation form a sentence of the grammar

    Talk  -> (nothing) | Turns          Turns -> Open u a | Turns u a          Open -> s | (nothing)

read by an LR table that is made from these rules. The rows go through a graph-structured stack:
each top is an LR state with the stack below it, shared by all tops that grew from it. For every
row and every top the actions are keep (the table must shift the row's role), rerole to user or
assistant, and delete; before any row and at the end user or assistant rows may be inserted. Each
action has a weight and a letter. Equal tops are merged by the minimum of (cost, letters); as what
may follow depends on the top alone, nothing is lost by that. The accepted top with the smallest
(cost, letters) gives the repair.

Big conversations are not read in one piece. All rows are sorted by conversation and turn over
all tasks; rows that follow each other in a task form blocks of at most ``BLOCK``. For each
block and each top it may be entered with the cheapest way to each top is found, then the blocks
of a conversation are put together. Only letters move in that step, no texts.

Rules: nulls in role, text and turn: a null role or text is one space, null turns come first; a
null conversation id is an id like others. Rows of one turn are ordered by role, then text; rows
that agree in all are interchangeable. The other columns of the table are not read.

A row's first fault counts: ``blank`` (no visible character), ``duplicate`` (role and text occur
earlier in the conversation), ``truncated`` (does not end in one of ``. ! ?``). Blank and
duplicate rows must be deleted, truncated ones cost more if they are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.llm.common import BLANKS, id_key, stored

# Weights and letters of the actions.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
ROLES = {"u": "user", "a": "assistant"}
GRAMMAR = [("Talk", ()), ("Talk", ("Turns",)), ("Turns", ("Open", "u", "a")), ("Turns", ("Turns", "u", "a")),
           ("Open", ("s",)), ("Open", ())]
TOKENS, END = ("s", "u", "a"), "$"
#: Rows of a block at most (a power of two).
BLOCK_BITS = 12


# ---- the LR table ----

@lru_cache(maxsize=1)
def _table() -> tuple[dict[tuple[int, str], tuple], dict[tuple[int, str], int]]:
    """Actions and gotos of the grammar's SLR table; state 0 is the start."""
    left = {a for a, _ in GRAMMAR}
    empty, first, follow = set(), {a: set() for a in left}, {a: set() for a in left}
    follow["Talk"].add(END)
    size = -1
    while size != (size := len(empty) + sum(map(len, [*first.values(), *follow.values()]))):
        for a, body in GRAMMAR:
            if all(x in empty for x in body):
                empty.add(a)
            tail = set(follow[a])
            for x in reversed(body):
                if x in left:
                    follow[x] |= tail
                starts = first[x] if x in left else {x}
                tail = tail | starts if x in empty else set(starts)
            for x in body:
                first[a] |= first[x] if x in left else {x}
                if x not in empty:
                    break

    def closed(items: Iterable[tuple[int, int]]) -> frozenset:
        new = list(items)
        out = set(new)
        while new:
            rule, dot = new.pop()
            body = GRAMMAR[rule][1]
            for r, (a, _) in enumerate(GRAMMAR):
                if dot < len(body) and body[dot] == a and (r, 0) not in out:
                    out.add((r, 0))
                    new.append((r, 0))
        return frozenset(out)

    states = [closed((r, 0) for r, (a, _) in enumerate(GRAMMAR) if a == "Talk")]
    action: dict[tuple[int, str], tuple] = {}
    goto: dict[tuple[int, str], int] = {}
    for n, items in enumerate(states):  # grows while it is read
        for x in sorted({GRAMMAR[r][1][d] for r, d in items if d < len(GRAMMAR[r][1])}):
            to = closed((r, d + 1) for r, d in items if d < len(GRAMMAR[r][1]) and GRAMMAR[r][1][d] == x)
            if to not in states:
                states.append(to)
            goto[n, x] = states.index(to)
        for r, d in items:
            head, body = GRAMMAR[r]
            if d == len(body):
                for token in follow[head]:
                    assert (n, token) not in action and (token == END or (n, token) not in goto), "the grammar is not SLR"
                    action[n, token] = ("accept",) if head == "Talk" else ("reduce", head, len(body))
        for token in TOKENS:
            if (n, token) in goto:
                action[n, token] = ("shift", goto[n, token])
    return action, goto


class Stack:
    """A node of the graph-structured stack: an LR state and the node below it."""

    __slots__ = ("state", "below")

    def __init__(self, state: int, below: Stack | None):
        self.state, self.below = state, below


def _reduced(top: Stack, token: str) -> tuple[Stack, tuple]:
    """The stack after all reductions that ``token`` allows, and the action that then follows."""
    action, goto = _table()
    while (act := action.get((top.state, token), ("error",)))[0] == "reduce":
        below = top
        for _ in range(act[2]):
            below = below.below
        top = Stack(goto[below.state, act[1]], below)
    return top, act


@lru_cache(maxsize=1)
def _moves() -> tuple[dict[tuple[int, str], int], dict[int, Stack], set[int]]:
    """Shifts from top to top, a stack of each top, and the tops that accept the end.

    In this grammar a top determines the stack below it (asserted), so a top can stand for its
    stack where a block begins.
    """
    start = Stack(0, None)
    tops, shift, accept, new = {0: start}, {}, set(), [start]

    def states(s: Stack | None) -> list[int]:
        return [] if s is None else [s.state, *states(s.below)]

    while new:
        top = new.pop()
        if _reduced(top, END)[1] == ("accept",):
            accept.add(top.state)
        for token in TOKENS:
            below, act = _reduced(top, token)
            if act[0] == "shift":
                node = Stack(act[1], below)
                shift[top.state, token] = node.state
                if node.state in tops:
                    assert states(tops[node.state]) == states(node)
                else:
                    tops[node.state] = node
                    new.append(node)
    return shift, tops, accept


# ---- repair of a block ----

Way = tuple[int, str]
#: A row as the parser sees it: its role's token (another letter fits nowhere) and its fault.
Seen = tuple[str, str]


def _with_inserts(tops: dict[int, Way]) -> dict[int, Way]:
    shift = _moves()[0]
    out, new = dict(tops), list(tops)
    while new:
        top = new.pop()
        cost, letters = out[top]
        for token in ROLES:
            to = shift.get((top, token))
            if to is not None and ((way := (cost + INSERT, letters + "I")) < out.get(to, (1 << 60, ""))):
                out[to] = way
                new.append(to)
    return out


def _read(tops: dict[int, Way], row: Seen) -> dict[int, Way]:
    """The tops after a row, equal ones merged by the smallest (cost, letters)."""
    shift = _moves()[0]
    token, fault = row
    out: dict[int, Way] = {}
    for top, (cost, letters) in tops.items():
        ways = [(top, (cost + DELETE, letters + "D"))]
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED if fault == "truncated" else 0
            if (to := shift.get((top, token))) is not None:
                ways.append((to, (cost + extra, letters + "K")))
            ways += [(to, (cost + REROLE + extra, letters + "R")) for t in ROLES if (to := shift.get((top, t))) is not None]
        for to, way in ways:
            if to not in out or way < out[to]:
                out[to] = way
    return out


def block_ways(rows: tuple[Seen, ...]) -> dict[int, dict[int, Way]]:
    """For each top at the start of the rows the cheapest way to each top after them (inserts before rows only)."""
    out = {}
    for entry in sorted(_moves()[1]):
        tops = {entry: (0, "")}
        for row in rows:
            tops = _read(_with_inserts(tops), row)
        out[entry] = tops
    return out


@lru_cache(maxsize=20_000)
def _short_ways(rows: tuple[Seen, ...]) -> dict[int, dict[int, Way]]:
    """Short conversations repeat the same few patterns."""
    return block_ways(rows)


def best_repair(blocks: Iterable[dict[int, dict[int, Way]]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and for each block the top it is entered with and its letters (the last with the inserts at the end)."""
    # Equal letters are never compared twice: each top keeps its letters and the way back to the block before.
    tops: dict[int, tuple[int, str, tuple | None]] = {0: (0, "", None)}
    for ways in blocks:
        new: dict[int, tuple[int, str, tuple | None]] = {}
        for entry, (cost, letters, back) in tops.items():
            for to, (more, its) in ways[entry].items():
                if to not in new or (cost + more, letters + its) < new[to][:2]:
                    new[to] = (cost + more, letters + its, (back, entry, its))
        tops = new
    end = _with_inserts({top: way[:2] for top, way in tops.items()})
    top = min(_moves()[2] & set(end), key=end.get)
    cost, letters = end[top]
    inserted = next(k for k in range(len(letters) + 1) if any(
        w[:2] == (cost - INSERT * k, letters[:len(letters) - k]) for w in tops.values()))
    back = next(w[2] for w in tops.values() if w[:2] == (cost - INSERT * inserted, letters[:len(letters) - inserted]))
    path: list[tuple[int, str]] = []
    while back is not None:
        back, entry, its = back
        path.append((entry, its))
    path.reverse()
    if path:
        path[-1] = (path[-1][0], path[-1][1] + "I" * inserted)
    elif inserted:
        path = [(0, "I" * inserted)]
    return cost, path


class Replay:
    """Follows the letters of a repair and tells the role of each row that stays."""

    def __init__(self, entry: int, letters: str):
        self.top, self.letters, self.at = entry, letters, 0
        self.rows_end = len(letters.rstrip("I"))

    def _shift(self, token: str) -> None:
        self.top = _moves()[0][self.top, token]

    def _forced(self) -> str:
        """The one role of user and assistant that may come next."""
        token = next(t for t in ROLES if (self.top, t) in _moves()[0])
        self._shift(token)
        return ROLES[token]

    def inserts(self) -> Iterator[str]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            yield self._forced()

    def row(self, role: str) -> str | None:
        """The role of the next row, null if it is deleted."""
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self._shift(role[:1])
            return role
        return self._forced() if letter == "R" else None


# ---- tables ----

def token_of(role: Column) -> Column:
    """The grammar's token of a role."""
    return F.substring(role, 1, 1)


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows sorted over all tasks, with ``seq`` (their order), ``talk`` (the id as text) and ``said``; stored.

    Identical rows may be dealt to two tasks, so a copy number closes the sort key.
    """
    clean = rows.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    keyed = clean.withColumns({"talk": id_key(F.col("conv_id")), "copy": F.monotonically_increasing_id()})
    order = ["talk", F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    visible = F.rtrim(F.col("text"), F.lit(BLANKS))
    said = F.struct(
        token_of(F.col("role")).alias("token"),
        F.when(visible == "", "blank").when(~visible.rlike(r"[.!?]\z"), "truncated").otherwise("").alias("fault"),
        F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"))
    return stored(dealt.drop("copy").withColumn("said", said), "talk-rows")


def _with_faults(ordered: DataFrame) -> DataFrame:
    """``talk, conv_id, turn, seq, token, fault`` without texts."""
    thin = ordered.select("talk", "conv_id", "turn", "seq", "said.token", "said.fault", "said.digest")
    again = thin.groupBy("talk", "digest").agg(F.min("seq").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return thin.join(again.drop("n"), ["talk", "digest"], "left").select(
        "talk", "conv_id", "turn", "seq", "token",
        F.when(F.col("fault") == "blank", "blank").when(F.col("seq") > F.col("first"), "duplicate").otherwise(F.col("fault")).alias("fault"))


_WAY = T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("top", T.IntegerType()),
                     T.StructField("cost", T.LongType()), T.StructField("letters", T.StringType())])
_BLOCKS = T.StructType([T.StructField("talk", T.StringType()), T.StructField("block", T.LongType()),
                        T.StructField("ways", T.ArrayType(_WAY)), T.StructField("first_token", T.StringType()),
                        T.StructField("last_token", T.StringType()), T.StructField("illegal", T.LongType())])
LEGAL = {"su", "ua", "au"}


def _block_of(seq: Column) -> Column:
    """Rows that follow each other in one task, at most 2^BLOCK_BITS of them."""
    return F.shiftrightunsigned(seq, BLOCK_BITS)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the first ``keys`` columns of a sorted stream."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = r[:keys], []
            rows.append(r)
    if rows:
        yield key, rows


def _blocks(faults: DataFrame) -> DataFrame:
    """For each conversation's block its cheapest ways, its end tokens and the pairs inside it that are not allowed."""
    keyed = faults.select("talk", _block_of(F.col("seq")).alias("block"), "seq", "token", "fault")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(_groups(batches, 2), 2000):
            out = []
            for (talk, block), rows in part:
                tokens = [r[3] for r in rows]
                ways = (_short_ways if len(rows) <= 16 else block_ways)(tuple((r[3], r[4]) for r in rows))
                out.append({
                    "talk": talk, "block": block, "first_token": tokens[0], "last_token": tokens[-1],
                    "ways": [{"entry": e, "top": t, "cost": c, "letters": x} for e, to in ways.items() for t, (c, x) in to.items()],
                    "illegal": sum(a + b not in LEGAL for a, b in zip(tokens, tokens[1:]))})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(_BLOCKS))

    return keyed.repartition("talk", "block").sortWithinPartitions("talk", "block", "seq").mapInArrow(read, _BLOCKS)


def _chunks(items: Iterator, most: int) -> Iterator[list]:
    part = []
    for x in items:
        part.append(x)
        if len(part) == most:
            yield part
            part = []
    if part:
        yield part


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


_PIECE = T.StructType([T.StructField("block", T.LongType()), T.StructField("entry", T.IntegerType()), T.StructField("letters", T.StringType())])
_REPAIRS = T.StructType([T.StructField("talk", T.StringType()), T.StructField("cost", T.LongType()),
                         T.StructField("illegal", T.LongType()), T.StructField("pieces", T.ArrayType(_PIECE))])


def _repairs(blocks: DataFrame) -> DataFrame:
    """Per conversation the cost, the pairs that are not allowed, and for each block its entry and letters."""

    def ways_of(row: tuple) -> dict[int, dict[int, Way]]:
        out: dict[int, dict[int, Way]] = {}
        for w in row[2]:
            out.setdefault(w["entry"], {})[w["top"]] = (w["cost"], w["letters"])
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(_groups(batches, 1), 500):
            out = []
            for (talk,), rows in part:
                cost, path = best_repair(map(ways_of, rows))
                illegal = sum(r[5] for r in rows) + sum(a[4] + b[3] not in LEGAL for a, b in zip(rows, rows[1:]))
                out.append({"talk": talk, "cost": cost, "illegal": illegal, "pieces": [
                    {"block": r[1], "entry": e, "letters": x} for r, (e, x) in zip(rows, path)]})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(_REPAIRS))

    return blocks.repartition("talk").sortWithinPartitions("talk", "block").mapInArrow(read, _REPAIRS)


class Repair:
    """A table of conversations (``conv_id, turn, role, text``) and its repair."""

    def __init__(self, rows: DataFrame):
        self.ordered = _ordered(rows)
        self.faults = stored(_with_faults(self.ordered), "talk-faults")
        self.found = stored(_repairs(_blocks(self.faults)), "talk-repairs")

    def report(self) -> DataFrame:
        """One row for each conversation that has rows: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``."""
        counted = self.faults.groupBy("talk").agg(
            F.first("conv_id").alias("conv_id"),
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
            *(F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")))
        letters = F.array_join(F.transform("pieces", lambda p: p["letters"]), "")
        return counted.join(self.found, "talk").select(
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", letters.alias("audit"))

    def _replayed(self, *by: str) -> DataFrame:
        """Repaired rows in order, each task with whole groups of ``by``."""
        pieces = self.found.select("talk", F.explode("pieces").alias("p"), F.lit(None).cast("string").alias("role"))
        rows = self.ordered.select("talk", _block_of(F.col("seq")).alias("block"), "seq", F.lit(0).alias("entry"), "role", "text", "turn")
        both = rows.unionByName(pieces.select(
            "talk", "p.block", F.lit(-1).cast("long").alias("seq"), "p.entry", "role", F.col("p.letters").alias("text"),
            F.lit(None).cast("long").alias("turn")))
        schema = T.StructType([T.StructField("talk", T.StringType()), T.StructField("block", T.LongType()),
                               T.StructField("seq", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("turn", T.LongType()),
                               T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            replay = Replay(0, "")
            for b in batches:
                out: list[tuple] = []
                for talk, block, seq, entry, role, text, turn in zip(*(c.to_pylist() for c in b.columns)):
                    if seq == -1:
                        replay, n = Replay(entry, text), 0
                        continue
                    for x in replay.inserts():
                        out.append((talk, block, seq, n, None, x, ""))
                        n += 1
                    kept = replay.row(role)
                    if kept is not None:
                        out.append((talk, block, seq, n, turn, kept, text))
                        n += 1
                    if replay.at == replay.rows_end:
                        for x in replay.inserts():
                            out.append((talk, block, seq, n, None, x, ""))
                            n += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 7, _arrow(schema))],
                                                 schema=_arrow(schema))

        return both.repartition(*by).sortWithinPartitions("talk", "block", "seq").mapInArrow(read, schema)

    def rows(self) -> DataFrame:
        """The repaired conversations: ``conv_id, position, turn, role, text``; inserted rows have no turn."""
        ids = self.faults.select("talk", "conv_id").distinct()
        return self._replayed("talk", "block").join(ids, "talk").select(
            "conv_id", F.struct("block", "seq", "nth").alias("position"), "turn", "role", "text")

    def digests(self) -> DataFrame:
        """``talk, repaired_sha256`` of the rows as ``role:text`` lines, for conversations of which rows are left.

        A digest needs its conversation in order; the rows stream through, none is held.
        """

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            talk, h = None, None
            for b in batches:
                done = []
                for t, role, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("talk", "role", "text"))):
                    line = f"{role}:{text}".encode()
                    if t == talk:
                        h.update(b"\n" + line)
                    else:
                        if h is not None:
                            done.append((talk, h.hexdigest()))
                        talk, h = t, hashlib.sha256(line)
                yield _digests(done)
            if h is not None:
                yield _digests([(talk, h.hexdigest())])

        return self._replayed("talk").mapInArrow(digest, "talk string, repaired_sha256 string")


def _digests(done: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())],
                                      names=["talk", "repaired_sha256"])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of the contract's test: some lost, emptied, without sentence ends, repeated or given to the user."""
    part = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.pmod(F.crc32(F.concat(part["conv_id"], F.lit(":"), part["turn"]).cast("binary")), F.lit(20))
    hit = rows.select("conv_id", "turn", part["role"].alias("role"), part["text"].alias("text"), fate.alias("fate")).filter("fate <> 0")
    changed = hit.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        "fate")
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return changed.select("conv_id", "turn", "role", "text", F.explode(copies)).drop("col")
