"""Repair of damaged conversations by the cheapest edits, found by A* on the lattice of rows and turns.

A node of the lattice is the number of rows that are dealt with and what the next role may be. Rows in order
are read as a stream and cut into chunks of at most CHUNK rows; A* gives each chunk its cheapest edits between
every pair of states at its ends, so a conversation of any length is the chain of its chunks, and no task has
more of it than its audit, one letter an edit.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 512
DELETE, ROLE, INSERT, TRUNCATED = 4, 3, 3, 3  # costs; keeping costs nothing
SPACE = " \t\n\x0b\x0c\r"
#: What the next role may be, and what follows it: nothing yet, after system, after user, after assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ENDS = (EMPTY, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
Code = tuple[str, str]  # a row's role initial and its fault: blank, duplicate, truncated or none


def edits(rows: list[Code], start: int, last: bool) -> dict[int, tuple[int, str]]:
    """state -> (cost, audit): the cheapest edits of rows from the start state to each state after them; ties go to the ASCII-least audit.

    last: only the cheapest way to a state in which a conversation may end. The heuristic of a node is what the rows
    ahead cost at the least: each blank or duplicate one has to be deleted, and each truncated one is either
    deleted, which costs more, or charged. Keys are (cost + heuristic, audit). Two audits of equal cost that meet in a
    node have equal length, so the lesser one stays so whatever follows.
    """
    ahead = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + {"b": DELETE, "d": DELETE, "t": TRUNCATED, "": 0}[rows[i][1]]
    queue, closed, found = [(ahead[0], "", 0, start)], set(), {}
    while queue:
        key, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = key - ahead[i]
        if i == len(rows) and (not last or state in ENDS):
            found[state] = (cost, audit)
            if last or len(found) == 4:
                break
        role, after = NEXT[state]
        steps = [(INSERT, "I", i, after)]
        if i < len(rows):
            initial, fault = rows[i]
            steps.append((DELETE, "D", i + 1, state))
            if fault not in ("b", "d"):
                charge = TRUNCATED if fault else 0
                steps.append((charge, "K", i + 1, after) if initial == role else (charge + ROLE, "R", i + 1, after))
                if initial == "s" and state == EMPTY:
                    steps.append((charge, "K", i + 1, SYSTEM))
        for price, edit, j, to in steps:
            if (j, to) not in closed:
                heapq.heappush(queue, (cost + price + ahead[j], audit + edit, j, to))
    return found


class Chain:
    """The cheapest edits of a conversation so far, from chunk to chunk."""

    def __init__(self):
        self.settled: list[str] = []  # what the audits of all states begin with
        self.best = {EMPTY: (0, "")}

    def add(self, ways: Iterable[tuple[int, int, int, str]]) -> None:
        """ways: (from state, to state, cost, audit) of the next chunk."""
        new: dict[int, tuple[int, str]] = {}
        for a, b, cost, audit in ways:
            if a in self.best:
                way = (self.best[a][0] + cost, self.best[a][1] + audit)
                new[b] = min(new.get(b, way), way)
        shared = len(os.path.commonprefix([audit for _, audit in new.values()]))
        self.settled.append(next(iter(new.values()))[1][:shared])
        self.best = {state: (cost, audit[shared:]) for state, (cost, audit) in new.items()}

    def end(self) -> tuple[int, str]:
        cost, audit = min(way for state, way in self.best.items() if state in ENDS)
        return cost, "".join(self.settled) + audit


def repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[str]:
    """`role:text` of every row that the edits leave, given (role, text) of the rows in order. Reads no row ahead."""
    state = EMPTY
    for edit in audit:
        initial, to = NEXT[state]
        if edit == "I":
            yield f"{ROLES[initial]}:"
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES[initial]
            elif state == EMPTY and role[:1] == "s":
                to = SYSTEM
            yield f"{role}:{text}"
        state = to


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32(`conv_id:turn`) deals out; nulls become one space first.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes out sentence ends, 3 repeats the row, 4 makes its role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    part = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), part.alias("part")).where("part <> 0")
    text = F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("part") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "part")
    return rows.withColumn("copy", F.explode(F.when(F.col("part") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("part", "copy")


_CHUNKS = """conv_id long, part int, no int, n long, n_turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long,
first_initial string, last_initial string, ways array<struct<a:int,b:int,cost:long,audit:string>>"""
_LEGAL = {"su", "ua", "au"}


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):  # as Python values a part of a batch at a time: texts may be long
            yield from zip(*(c.to_pylist() for c in batch.slice(low, 1024).columns), strict=True)


def _arrow(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows (conv_id, turn, role, text) in order, cut into chunks: counts of faults, and the cheapest edits between all states.

    The order is by turn, nulls first, then role and digest of the text. Rows are dealt by ranges of that order, so a
    conversation of very many rows is the work of many tasks; a row whose role and text stand at an earlier
    turn of the conversation is found by a join, one that is the same as the row before it in the stream.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.when(body == "", "b").when(F.right(body, F.lit(1)).isin(".", "!", "?"), "").otherwise("t").alias("fault"))
    turn = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    same = rows.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"), F.max(turn).alias("last")).where("first < last")
    same = same.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    rows = rows.join(same, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select("conv_id", "turn", "role", "digest", "fault", F.coalesce(turn > F.col("first"), F.lit(False)).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, no, held, conv, before, begun = None, 0, [], None, None, False
        for row in _values(batches):
            part = row[6]
            if held and (row[0] != conv or len(held) == size):
                yield chunk(conv, part, no, held, begun, row[0] != conv)
                no, begun = no + 1, row[0] != conv
                held = []
            conv = row[0]
            key = row[:4]
            fault = "d" if row[4] != "b" and (row[5] or key == before) else row[4]
            held.append((row[1], row[2][:1], fault))
            before = key
        if held:
            yield chunk(conv, part, no, held, begun, False)

    def chunk(conv, part, no, held, begun, ended) -> tuple:
        """begun, ended: whether the conversation is known to begin, or to end, with the chunk."""
        codes = [(initial, fault) for _, initial, fault in held]
        ways = [(a, b, *way) for a in ((EMPTY,) if begun else NEXT) for b, way in edits(codes, a, ended).items()]
        turns = [t for t, _, _ in held if t is not None]
        count = lambda x: sum(f == x for _, f in codes)
        illegal = sum(a + b not in _LEGAL for (a, _), (b, _) in zip(codes, codes[1:], strict=False))
        ways = [{"a": a, "b": b, "cost": cost, "audit": audit} for a, b, cost, audit in ways]
        return (conv, part, no, len(held), len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None, count("b"), count("d"), count("t"), illegal, codes[0][0], codes[-1][0], ways)

    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 8, pa.string(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]
    schema = pa.schema(list(zip([x.split()[0] for x in _CHUNKS.replace("\n", " ").split(", ")], kinds, strict=True)))
    order = ["conv_id", "turn", "role", "digest"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return dealt.mapInArrow(lambda batches: _arrow(run(batches), schema), _CHUNKS)


def repairs(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    rows: conv_id, turn, role, text, none of the last two null; a null conv_id is a conversation, a null turn comes first.
    conversations: the conv_id of those to return, also where they have no rows. A row's first fault counts: blank
    (white space only), duplicate (its role and text stand earlier in the conversation), truncated (no sentence end). Edits keep a
    row, give it another role, delete it (blank and duplicate ones always) or insert an empty one, so that
    roles become an optional system turn and pairs of user and assistant. A role is known by its first letter.
    """
    ids = (rows if conversations is None else conversations).select("conv_id").distinct()
    found = chunks(rows)
    wide = F.struct(*[c for c in found.columns if c != "conv_id"])
    shape = found.select(wide.alias("x")).schema["x"].dataType

    def line(frame: DataFrame, kind: int, **given) -> DataFrame:
        chunk = given.get("chunk", F.lit(None)).cast(shape)
        fields = [given.get(name, F.lit(None)).cast(to).alias(name) for name, to in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))]
        return frame.select("conv_id", F.lit(kind).alias("kind"), *fields, chunk.alias("chunk"), chunk["part"].alias("part"), chunk["no"].alias("no"))

    texts = {c: F.col(c) for c in ("turn", "role", "text")}
    stream = line(ids, 0).unionByName(line(found, 1, chunk=wide)).unionByName(line(rows, 2, digest=F.unhex(F.sha2("text", 256)), **texts))

    def one(conv, lines: Iterator[tuple]) -> tuple | None:
        """lines: the id, the chunks, the rows of one conversation."""
        chain, listed, gaps, faults, last, turns, row = Chain(), False, 0, [0, 0, 0, 0], None, [None, None, 0], None
        for row in lines:
            if row[1] == 2:
                break
            if row[1] == 0:
                listed = True
            else:
                c = row[6]
                chain.add((w["a"], w["b"], w["cost"], w["audit"]) for w in c["ways"])
                faults = [a + c[k] for a, k in zip(faults, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
                faults[3] += last is not None and last + c["first_initial"] not in _LEGAL
                last = c["last_initial"]
                if c["n_turns"]:
                    turns = [c["first_turn"] if turns[0] is None else turns[0], c["last_turn"], turns[2] + c["n_turns"] - (turns[1] == c["first_turn"])]
            row = None
        cost, audit = chain.end()
        total, first = hashlib.sha256(), True

        def texts() -> Iterator[tuple[str, str]]:
            if row is not None:
                yield row[3], row[5]
            for r in lines:
                yield r[3], r[5]

        for said in repaired(texts(), audit):
            total.update((said if first else "\n" + said).encode())
            first = False
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        return (conv, gaps, *faults, cost, audit, total.hexdigest()) if listed else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows, ahead = _values(batches), []

        def own(conv) -> Iterator[tuple]:
            while ahead:
                yield ahead.pop()
            for r in rows:
                if r[0] != conv:
                    ahead.append(r)
                    return
                yield r

        ahead.extend(r for r in [next(rows, None)] if r is not None)
        while ahead:
            conv = ahead[0][0]
            lines = own(conv)
            out = one(conv, lines)
            for _ in lines:
                pass
            if out:
                yield out

    kinds = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in kinds.split(", ")])
    dealt = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "no", "turn", "role", "digest").drop("part", "no")
    return dealt.mapInArrow(lambda batches: _arrow(run(batches), schema, 256), kinds)
