"""Repair of conversations: the cheapest edits that make the roles of a conversation legal.

A legal conversation is empty, or an optional system turn and one or more pairs of user and assistant turns. Its states are
START, SYSTEM, USER and ASSISTANT; with the rows of the conversation they span a graph: an arc keeps (0), reroles (2) or
deletes (3) the next row, or inserts an empty turn (2); a truncated row that is not deleted costs 1 more, a blank or
duplicate row can only be deleted. Costs are small integers, so Dial's bucket queue gives each node's distance to the end;
the walk from the start then takes, of the arcs that are tight, the one whose initial comes first (D, I, K, R).

A conversation may hold a third of all rows, so it is not gathered. Rows go by range of (conversation, turn, role, text) to
tasks, which cut each conversation's stretch into segments of at most SEGMENT_ROWS rows; equal rows are one row with a
count. A conversation within one segment is repaired there. For others each segment gives its 4 x 4 table of distances
between states; these tables alone are chained per conversation (128 bytes a segment), and each segment then walks, in
parallel, from each state that it may be entered in. What is left for one task per conversation is to string the pieces
together and to hash them in order, which a digest of the whole text cannot avoid; it streams.

Damage (`damaged`) is part of the query, not of the repair. Rows: null conv_id is a conversation of its own; null roles and
texts count as one space, so does a null conv_id or turn in the damage key; null turns come first. Rows of the same turn
go by role, then text. Conversations of which nothing is left have zeros, an empty audit and the digest of the empty
text. Extra columns are not read; an empty table gives an empty result. gaps is null where a long cannot hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvetrail.llm.common import materialize, pieces, salted_join

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that each role initial leads to from each state.
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The one role of user and assistant that is legal in a state: what a rerole or an insertion makes.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: No path; above every distance of a segment.
FAR = 1 << 40
#: From a state after the last row to the end, by insertions.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: Rows, and characters of text, that a segment holds at most (a longer row by itself).
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 4 << 20
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

FACTS = ["blank", "duplicate", "truncated", "illegal"]
_ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("fault", pa.string())])
_DONE = pa.struct([("gaps", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
#: A segment: where it stands, its facts, and either its repair or its rows and its table of distances.
_SEGMENT = [("range_id", pa.int32()), ("place", pa.int32()), *((f, pa.int64()) for f in ("low", "high", "turns", *FACTS)), ("first", pa.string()), ("last", pa.string()), ("rows", pa.list_(_ROW)), ("chain", pa.list_(pa.int64())), ("done", _DONE)]
SEGMENT = "range_id int, place int, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, rows array<struct<role:string,text:string,copies:long,fault:string>>, chain array<long>, done struct<gaps:long,cost:long,audit:string,repaired_sha256:string>"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT = [*((f, pa.int64()) for f in ("gaps", *FACTS, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def fault_of(text: str, repeated: bool) -> str:
    """A row's first fault: b(lank), d(uplicate), t(runcated), or none."""
    bare = text.strip(WHITE)
    return "b" if not bare else "d" if repeated else "t" if bare[-1] not in ".!?" else ""


class Graph:
    """The graph of a segment's rows (role, text, copies, fault). Rows that have to go, copies included, are no nodes: they
    cost 3 each wherever a path passes, and their deletion comes before any insertion at the same place."""

    def __init__(self, rows: list[tuple[str, str, int, str]]):
        self.gone = [0]  # rows to delete before each node's row, and after the last
        self.arcs: list[tuple[str, int]] = []  # role initial and extra cost of each row that may stay
        self.rows = []
        for role, text, copies, fault in rows:
            if fault in ("b", "d"):
                self.gone[-1] += copies
            else:
                self.arcs.append((role[:1], TRUNCATED if fault == "t" else 0))
                self.rows.append((role, text))
                self.gone.append(copies - 1)
        self.forced = DELETE * sum(self.gone)

    def edges(self, i: int, state: int) -> list[tuple[str, int, int, int]]:
        """Arcs from a node: letter, cost, row, state; in the order of the letters."""
        out = []
        after = NEXT[state][1]
        if i < len(self.arcs):
            out.append(("D", DELETE, i + 1, state))
        out.append(("I", INSERT, i, after))
        if i < len(self.arcs):
            initial, extra = self.arcs[i]
            if (kept := STEPS[state].get(initial)) is not None:
                out.append(("K", extra, i + 1, kept))
            out.append(("R", REROLE + extra, i + 1, after))
        return out

    def distances(self, end: tuple[int, ...]) -> list[list[int]]:
        """dist[row][state]: the cheapest way to the end without forced deletions, by Dial's buckets from the end on. end:
        what is left to pay in each state after the last row."""
        n = len(self.arcs)
        into: list[list[tuple[int, int]]] = [[] for _ in range(4 * (n + 1))]
        for i in range(n + 1):
            for state in range(4):
                for _, cost, j, to in self.edges(i, state):
                    into[4 * j + to].append((4 * i + state, cost))
        dist = [FAR] * (4 * (n + 1))
        least = min(end)
        ring: list[list[int]] = [[] for _ in range(max(DELETE, REROLE + TRUNCATED, *(e - least for e in end if e < FAR)) + 1)]
        for state, e in enumerate(end):
            if e < FAR:
                dist[4 * n + state] = e - least
                ring[e - least].append(4 * n + state)
        at, waiting = 0, sum(map(len, ring))
        while waiting:  # the ring holds all distances that can be open at a time
            bucket = ring[at % len(ring)]
            while bucket:
                node = bucket.pop()
                waiting -= 1
                if dist[node] != at:
                    continue  # a shorter way was found since
                for source, cost in into[node]:
                    if at + cost < dist[source]:
                        dist[source] = at + cost
                        ring[(at + cost) % len(ring)].append(source)
                        waiting += 1
            at += 1
        return [[d + least if d < FAR else FAR for d in dist[4 * i : 4 * i + 4]] for i in range(n + 1)]

    def walk(self, dist: list[list[int]], state: int, last: bool) -> tuple[str, int]:
        """The least letters over tight arcs from a state, and the state that the segment is left in. A segment is left as
        soon as its rows are used up: what is inserted there is inserted before the next one's rows, whose forced
        deletions come first. The last segment goes on to the end of the conversation."""
        out, i, n = ["D" * self.gone[0]], 0, len(self.arcs)
        while i < n or last and dist[n][state] > 0:
            letter, j, to = next((letter, j, to) for letter, cost, j, to in self.edges(i, state) if dist[j][to] + cost == dist[i][state])
            out.append(letter)
            if j > i:
                out.append("D" * self.gone[j])
            i, state = j, to
        return "".join(out), state

    def chain(self) -> list[int]:
        """Distances from each state before the rows to each state after them, by source and target."""
        columns = [self.distances(tuple(0 if s == target else FAR for s in range(4)))[0] for target in range(4)]
        return [min(FAR, columns[target][source] + self.forced) for source in range(4) for target in range(4)]


def repaired(rows: list[tuple[str, str, int, str]], audit: str, state: int) -> Iterator[str]:
    """The role:text of each turn that stays, in order."""
    at, copy = 0, 0
    for letter in audit:
        if letter == "I":
            role, state = NEXT[state]
            yield f"{role}:"
            continue
        role, text, copies, _ = rows[at]
        copy += 1
        if copy == copies:
            at, copy = at + 1, 0
        if letter == "K":
            state = STEPS[state][role[:1]]
            yield f"{role}:{text}"
        elif letter == "R":
            role, state = NEXT[state]
            yield f"{role}:{text}"


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of the query: (conv_id, turn, role, text, copies). A dropped row leaves its conversation's name, as a row
    of 0 copies."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    role = F.when(kind == 4, "user").otherwise(text_of("role"))
    stays = lambda c, other: F.when(kind != 0, c).otherwise(other)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", stays(F.col("turn"), F.lit(None)).alias("turn"), stays(role, "").alias("role"), stays(text, "").alias("text"), copies.alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """One row for equal rows, with copies, and repeated: whether an earlier turn of the conversation has its role and
    text. Only pairs of role and text that come in several turns are joined back, over salts."""
    apart = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    named = F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    apart = apart.withColumn("mark", F.unhex(F.sha2(named, 256)))
    order: Column = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    several = apart.where("copies > 0").groupBy("mark").agg(F.min(order).alias("earliest"), F.count("*").alias("n")).where("n > 1").select("mark", "earliest")
    joined = salted_join(apart, several, ["mark"], F.col("turn"))
    return joined.select("conv_id", "turn", "role", "text", "copies", (F.col("earliest").isNotNull() & (order > F.col("earliest"))).alias("repeated"))


class Stretch:
    """Rows of a conversation in order, gathered up to a segment."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.chars = conv_id, [], 0
        self.low = self.high = self.last_role = self.first_role = None
        self.turns = 0
        self.facts = dict.fromkeys(FACTS, 0)

    def add(self, turn: int | None, role: str, text: str, copies: int, repeated: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        fault = fault_of(text, repeated)
        self.facts["blank"] += copies if fault == "b" else 0
        self.facts["duplicate"] += copies if fault == "d" else 0 if fault == "b" else copies - 1
        self.facts["truncated"] += fault == "t"
        initial = role[:1]
        if self.rows:
            self.facts["illegal"] += illegal(self.last_role, initial)
        else:
            self.first_role = initial
        self.facts["illegal"] += (copies - 1) * illegal(initial, initial)
        self.last_role = initial
        self.rows.append((role, text, copies, fault))
        self.chars += len(text)

    def full(self, rows: int) -> bool:
        return len(self.rows) >= rows or self.chars >= SEGMENT_CHARS


def illegal(a: str, b: str) -> int:
    return int(a + b not in ("su", "ua", "au") or len(a + b) != 2)


def gaps_of(low: int | None, high: int | None, turns: int) -> int | None:
    gaps = 0 if low is None else high - low + 1 - turns
    return gaps if gaps < 1 << 63 else None


def _cut(batches: Iterator[pa.RecordBatch], segment_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to segments. A conversation that neither begins nor ends a range of rows, and is one segment, is done."""
    range_id = TaskContext.get().partitionId()
    kind, out, place = None, [], 0

    def emit(stretch: Stretch, alone: bool) -> None:
        nonlocal place
        row = {"range_id": range_id, "place": place, "low": stretch.low, "high": stretch.high, "turns": stretch.turns, **stretch.facts, "first": stretch.first_role, "last": stretch.last_role, "rows": None, "chain": None, "done": None}
        graph = Graph(stretch.rows)
        if alone:
            dist = graph.distances(AT_END)
            audit, _ = graph.walk(dist, START, True)
            text = "\n".join(repaired(stretch.rows, audit, START))
            row["done"] = {"gaps": gaps_of(stretch.low, stretch.high, stretch.turns), "cost": dist[0][START] + graph.forced, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
        else:
            row |= {"rows": [dict(zip(("role", "text", "copies", "fault"), r)) for r in stretch.rows], "chain": graph.chain()}
        out.append((stretch.conv_id, row))
        place += 1

    def batch() -> pa.RecordBatch:
        cols = [pa.array([c for c, _ in out], kind), *(pa.array([r[name] for _, r in out], t) for name, t in _SEGMENT)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, names=["conv_id", *(name for name, _ in _SEGMENT)])

    now, whole = None, False  # the stretch, and whether the conversation began within the range and has one segment so far
    for some in pieces(batches):
        kind = some.column(0).type
        for conv_id, turn, role, text, copies, repeated in zip(*(c.to_pylist() for c in some.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    emit(now, whole)
                now, whole = Stretch(conv_id), now is not None
            elif now.full(segment_rows):
                emit(now, False)
                now, whole = Stretch(conv_id), False
            now.add(turn, role, text, copies, repeated)
        if len(out) >= 200:
            yield batch()
    if now is not None:
        emit(now, False)
        yield batch()


def _by_conversation(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows that are sorted by conversation, as one stream for each."""
    rows = (dict(zip(names, row)) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=lambda r: r["conv_id"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each open segment: what is left to pay in each state after it, whether it is its conversation's first or last, and
    the conversation's whole cost."""
    for _, rows in _by_conversation(batches, ["conv_id", "range_id", "place", "chain"]):
        rows = list(rows)  # tables of distances alone
        ends, end = [], list(AT_END)
        for r in reversed(rows):
            ends.append(end)
            end = [min(r["chain"][4 * s + t] + end[t] for t in range(4)) for s in range(4)]
        ends.reverse()
        n = len(rows)
        cols = [pa.array([r["range_id"] for r in rows], pa.int32()), pa.array([r["place"] for r in rows], pa.int32()), pa.array(ends, pa.list_(pa.int64())), pa.array([k == 0 for k in range(n)]), pa.array([k == n - 1 for k in range(n)]), pa.array([end[START]] * n, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["range_id", "place", "after", "begins", "ends", "cost"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each open segment's letters from each state that it may be entered in, and the state that it is left in."""
    kind = pa.list_(pa.struct([("audit", pa.string()), ("state", pa.int32())]))
    for batch in pieces(batches, rows=20):
        walks = []
        for rows, after, begins, ends in zip(*(batch.column(k).to_pylist() for k in ("rows", "after", "begins", "ends"))):
            graph = Graph([tuple(r.values()) for r in rows])
            dist = graph.distances(tuple(after))
            walks.append([dict(zip(("audit", "state"), graph.walk(dist, s, ends))) if s == START or not begins else None for s in range(4)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(walks, kind)], names=[*batch.schema.names, "walks"])


def _string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of each conversation strung together: one is held at a time."""
    names, kind = None, None

    def parts(it):
        nonlocal names, kind
        for b in it:
            names, kind = b.schema.names, b.column(0).type
            yield from pieces([b], rows=20)

    rows = (dict(zip(names, row)) for batch in parts(batches) for row in zip(*(c.to_pylist() for c in batch.columns)))
    for conv_id, segments in groupby(rows, key=lambda r: r["conv_id"]):
        state, audit, digest, begun = START, [], hashlib.sha256(), False
        total, low, high, turns, last = dict.fromkeys(FACTS, 0), None, None, 0, None
        for r in segments:
            here = r["walks"][state]
            for turn in repaired([tuple(x.values()) for x in r["rows"]], here["audit"], state):
                digest.update((("\n" if begun else "") + turn).encode())
                begun = True
            audit.append(here["audit"])
            state, cost = here["state"], r["cost"]
            for f in FACTS:
                total[f] += r[f]
            if r["first"] is not None:
                total["illegal"] += illegal(last, r["first"]) if last is not None else 0
                last = r["last"]
            if r["low"] is not None:
                turns += r["turns"] - (high == r["low"])
                low, high = r["low"] if low is None else low, r["high"]
        values = {"gaps": gaps_of(low, high, turns), **total, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
        yield pa.RecordBatch.from_arrays([pa.array([conv_id], kind), *(pa.array([values[n]], t) for n, t in _RESULT)], names=["conv_id", *(n for n, _ in _RESULT)])


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) to one row for each conv_id: gaps, counts of faults and illegal neighbours,
    cost, audit and digest of the repaired conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "text"]
    dealt = _marked(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = materialize(dealt.mapInArrow(lambda batches: _cut(batches, segment_rows), f"conv_id {kind}, {SEGMENT}"), "segments")
    done = segments.where("done is not null").select("conv_id", "done.gaps", *FACTS, "done.cost", "done.audit", "done.repaired_sha256")
    place = ["conv_id", "range_id", "place"]
    left = segments.where("done is null").drop("done")
    ends = left.select(*place, "chain").repartition("conv_id").sortWithinPartitions(*place).mapInArrow(_chain, "range_id int, place int, after array<long>, begins boolean, ends boolean, cost long")
    walked = left.drop("chain").join(ends, ["range_id", "place"]).select("conv_id", "range_id", "place", "low", "high", "turns", *FACTS, "first", "last", "rows", "after", "begins", "ends", "cost")
    walked = walked.mapInArrow(_walk, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in walked.schema) + ", walks array<struct<audit:string,state:int>>")
    strung = walked.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(_string, f"conv_id {kind}, {RESULT}")
    return done.unionByName(strung)
