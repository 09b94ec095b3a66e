"""Repair of the structure of conversations: the cheapest edits that make their roles alternate.

The edit lattice of a conversation has a node for each number of rows consumed and each state of the roles
written so far (nothing, system, user, assistant). Its edges keep a row (K, 0), give it the role that is due
(R, 2), delete it (D, 3), or insert an empty row of the role that is due (I, 2); a truncated row that stays adds
1, a blank or repeated one may only be deleted. A repaired conversation is empty, or an optional system row
and then pairs of user and assistant.

Bidirectional Dijkstra finds the cheapest paths: a heap from the start and one from the ends take turns until
no path that is still open can be as cheap as the best crossing; then all crossings of that cost are there,
and the one with the least concatenated audit (the initials of its edits) is taken.

Rows are dealt to tasks by ranges of (conversation, turn), so that a long conversation is the work of several.
A task divides what it has of a conversation into pieces of at most ``PIECE_ROWS`` rows. A conversation that is
one piece and surely begins and ends in the task is settled there; each other piece is solved from every state to
every state, and these small tables are composed in the order of the pieces afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialise

PIECE_ROWS = 256
START, SYSTEM, USER, ASSISTANT = range(4)
#: The roles that may follow each state, by their initials, and the states they lead to.
_DUE = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that an edit writes in each state, and the state it leads to.
_WRITE = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
_DONE = (START, ASSISTANT)
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_LEGAL = ("su", "ua", "au")


def _edges(rows: list[tuple[str, bool, bool]]) -> tuple[list, list]:
    """Edges ``(cost, initial, node)`` out of and into each node ``4 * i + state`` of the lattice of ``rows`` (initial of the role, must go, truncated)."""
    out: list[list] = [[] for _ in range(4 * len(rows) + 4)]
    for i in range(len(rows) + 1):
        for state in range(4):
            here, (_, to) = out[4 * i + state], _WRITE[state]
            here.append((2, "I", 4 * i + to))
            if i < len(rows):
                initial, must_go, truncated = rows[i]
                here.append((3, "D", 4 * i + 4 + state))
                if not must_go:
                    if initial in _DUE[state]:
                        here.append((int(truncated), "K", 4 * i + 4 + _DUE[state][initial]))
                    here.append((2 + truncated, "R", 4 * i + 4 + to))
    into: list[list] = [[] for _ in out]
    for node, edges in enumerate(out):
        for cost, edit, to in edges:
            into[to].append((cost, edit, node))
    return out, into


def cheapest(rows: list[tuple[str, bool, bool]], start: int = START, ends: tuple[int, ...] = _DONE, lattice: tuple[list, list] | None = None) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits of ``rows`` from a state to one of ``ends``, the least audit of equals; None where there are none."""
    out, into = lattice or _edges(rows)
    # A node's least label is final when it is taken: labels of one cost are taken in the order of the rows
    # (free edges lead to the next row), and the edits of one row told apart by the audit alone.
    ahead: dict[int, tuple[int, str]] = {start: (0, "")}
    goals = [4 * len(rows) + e for e in ends]
    behind: dict[int, tuple[int, str]] = dict.fromkeys(goals, (0, ""))
    forth, back, past, rest = [(0, 0, start)], [(0, -len(rows), n) for n in goals], set(), set()
    best = 0 if start in behind else None
    while forth and back and (best is None or forth[0][0] + back[0][0] <= best):
        if forth[0][0] <= back[0][0]:
            heap, edges, labels, taken, other, sign = forth, out, ahead, past, behind, 1
        else:
            heap, edges, labels, taken, other, sign = back, into, behind, rest, ahead, -1
        cost, _, node = heappop(heap)
        if node in taken:
            continue
        taken.add(node)
        audit = labels[node][1]
        for price, edit, to in edges[node]:
            if to in taken:
                continue
            label = (cost + price, audit + edit if sign > 0 else edit + audit)
            if to not in labels or label < labels[to]:
                if to not in labels or label[0] < labels[to][0]:
                    heappush(heap, (label[0], sign * (to // 4), to))
                labels[to] = label
            if to in other and (best is None or label[0] + other[to][0] < best):
                best = label[0] + other[to][0]
    if best is None:
        return None
    crossings = [ahead[n][1] + behind[n][1] for n in past & rest if ahead[n][0] + behind[n][0] == best]
    crossings += [behind[n][1] for n in (start,) if n in rest and behind[n][0] == best] + [ahead[n][1] for n in goals if n in past and ahead[n][0] == best]
    for n in past:
        cost, audit = ahead[n]
        crossings += [audit + edit + behind[to][1] for price, edit, to in out[n] if to in rest and cost + price + behind[to][0] == best]
    return best, min(crossings)


def table_of(rows: list[tuple[str, bool, bool]], starts: tuple[int, ...] = (0, 1, 2, 3), last: bool = False) -> list[tuple[int, int, int, str]]:
    """``(from, to, cost, audit)`` of the cheapest edits of a piece between any two states; one that ends a conversation has only ends that are allowed there."""
    lattice, found = _edges(rows), []
    for a in starts:
        for b in _DONE if last else range(4):
            way = cheapest(rows, a, (b,), lattice)
            if way:
                found.append((a, b, *way))
    return found


def apply_edits(rows: list[tuple[str, str]], audit: str, state: int = START) -> tuple[list[tuple[str, str]], int]:
    """The repaired rows (role, text), and the state after them."""
    given, made = iter(rows), []
    for edit in audit:
        role, text = next(given) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = _WRITE[state][0]
        made.append((role, text))
        state = _DUE[state][role[:1]]
    return made, state


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with seeded faults: by CRC-32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its text, 2 takes its ``[.!?]``, 3 repeats it, 4 makes it the user's.

    Nulls of id and turn count as a space there; a null role or text is a space.
    """
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    named = F.concat(conv, F.lit(":"), turn)
    kind, text = F.pmod(F.crc32(named.cast("binary")), F.lit(20)), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                                F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("__kind")).where("__kind != 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.when(F.col("__kind") == 3, 2).otherwise(1)))).drop("__kind", "__copy")


_COUNTS = "n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string, min_turn bigint, max_turn bigint, turns bigint"
_ROWS = "rows array<struct<role: string, text: string>>"
_PIECE = f"part int, piece int, {_COUNTS}, whole boolean, ways array<struct<a: int, b: int, cost: bigint, audit: string>>, {_ROWS}"


def _types(ddl: str) -> list[pa.DataType]:
    """Arrow types of columns in one of the above notations."""
    rows = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    ways = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    known = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return [rows if x.startswith("rows ") else ways if x.startswith("ways ") else known[x.split()[1]] for x in _columns(ddl)]


def _columns(ddl: str) -> list[str]:
    found, deep = [""], 0
    for ch in ddl:
        deep += (ch == "<") - (ch == ">")
        if ch == "," and not deep:
            found.append("")
        else:
            found[-1] += ch
    return [f.strip() for f in found]


class _Emitter:
    """Rows gathered into record batches of ``conv_id`` and the columns of ``ddl``."""

    def __init__(self, ddl: str) -> None:
        self.names, self.types, self.rows = ["conv_id", *(c.split()[0] for c in _columns(ddl))], _types(ddl), []

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), [id_type, *self.types], strict=True)]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, names=self.names)


def _pieces(batches: Iterator[pa.RecordBatch], part: int, piece_rows: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a range of sorted rows ``(conv_id, turn, role, text, digest, kind)``; kind 0 names a conversation, 1 announces repeats, 2 is a row."""
    made, rows, number, id_type = _Emitter(_PIECE), [], 0, pa.int64()
    conv = marker = last = None
    opened = begins = inside = False  # of the conversation at hand: there is one, it begins here, a piece of it is closed

    def close(ends: bool) -> None:
        codes = [(role[:1], blank or duplicate, truncated) for _, role, _, blank, duplicate, truncated in rows]
        shown, whole = [(r[1], r[2]) for r in rows], begins and ends and not inside
        if whole:
            ways = [(START, START, *cheapest(codes))]
            shown = apply_edits(shown, ways[0][3])[0]
        else:
            ways = table_of(codes, (START,) if begins and not inside else range(4), ends)
        turns, initials = [r[0] for r in rows if r[0] is not None], [c[0] for c in codes]
        made.rows.append((conv, part, number, len(rows), *(sum(r[k] for r in rows) for k in (3, 4, 5)), sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
                          *((initials[0], initials[-1]) if rows else (None, None)), min(turns, default=None), max(turns, default=None), len(set(turns)), whole,
                          [dict(zip(("a", "b", "cost", "audit"), w, strict=True)) for w in ways], [{"role": a, "text": b} for a, b in shown]))
        rows.clear()

    for batch in batches:
        id_type = batch.column(0).type
        for c, turn, role, text, digest, kind in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if not opened or c != conv:
                if opened:
                    close(True)
                    number += 1
                opened, conv, begins, inside, marker, last = True, c, kind == 0, False, None, None
            if kind == 0:
                continue
            if kind == 1:
                marker = (turn, digest)
                continue
            if len(rows) == piece_rows:
                close(False)
                number, inside = number + 1, True
            here, words = (turn, digest), text.strip(_WHITE)
            duplicate = bool(words) and here in (marker, last)
            rows.append((turn, role, text, not words, duplicate, bool(words) and not duplicate and words[-1] not in ".!?"))
            last = here
            if len(made.rows) >= 512:
                yield made.batch(id_type)
    if opened:
        close(False)
        yield made.batch(id_type)


def pieces_of(rows: DataFrame, ids: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The pieces of all conversations, written once: ``conv_id``, counts, the cheapest ``ways`` through them and their rows.

    A ``whole`` piece is a conversation of its own; its rows are those after the repair. Every id of ``ids`` has a piece.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit("/"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    marked = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", F.unhex(F.sha2(key, 256)).alias("digest"))
    # Tasks are told of rows that repeat one of an earlier turn by markers, sorted before those rows: only what occurs
    # more than once is looked up, and without its text. Repeats within a turn are neighbours.
    turn = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    several = materialise(marked.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(turn).alias("earliest")).where("n > 1"))
    light = marked.select("conv_id", "turn", "role", "digest", F.monotonically_increasing_id().alias("nth"))
    later = join_spread(light, several, ["digest"], several.select("digest", "n"), "nth").where(turn > F.col("earliest"))
    markers = later.select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind")).distinct()
    named = ids.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(0).alias("kind")).distinct()
    told = named.unionByName(markers).withColumn("text", F.lit(None).cast("string"))
    # Equal rows and their markers are in one range; there repeats are cut out one at a time.
    order = [F.asc_nulls_first("conv_id"), (F.col("kind") > 0).asc(), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    ranged = marked.withColumn("kind", F.lit(2)).unionByName(told).repartitionByRange(*order).sortWithinPartitions(*order, F.asc("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(batches, TaskContext.get().partitionId(), piece_rows)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return materialise(ranged.select("conv_id", "turn", "role", "text", "digest", "kind").mapInArrow(run, f"conv_id {kind}, {_PIECE}"))


_CHOSEN = f"part int, piece int, state int, audit string, {_COUNTS}, cost bigint"


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation in pieces, in order: the edits of every piece, and a row without a piece for the whole."""
    made, id_type = _Emitter(_CHOSEN), pa.int64()
    conv, total = None, None
    best: dict[int, tuple[int, str]] = {}
    steps: list[tuple[int, int, dict[int, tuple[int, str]]]] = []

    def close() -> None:
        state = min((s for s in _DONE if s in best), key=lambda s: best[s])
        cost, audit = best[state]
        made.rows.append((conv, None, None, None, audit, *total, cost))
        for part, piece, chosen in reversed(steps):
            before, edits = chosen[state]
            made.rows.append((conv, part, piece, before, edits, *[None] * 11))
            state = before

    for batch in batches:
        id_type = batch.column(0).type
        for c, part, piece, *counts, ways in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if total is None or c != conv:
                if total is not None:
                    close()
                conv, best, steps, total = c, {START: (0, "")}, [], [0, 0, 0, 0, 0, None, None, None, None, 0]
            reached: dict[int, tuple[int, str]] = {}
            chosen: dict[int, tuple[int, str]] = {}
            for w in ways:
                if w["a"] in best:
                    label = (best[w["a"]][0] + w["cost"], best[w["a"]][1] + w["audit"])
                    if w["b"] not in reached or label < reached[w["b"]]:
                        reached[w["b"]], chosen[w["b"]] = label, (w["a"], w["audit"])
            best = reached
            steps.append((part, piece, chosen))
            if counts[0]:
                meet = total[0] and total[6] + counts[5] not in _LEGAL
                same = counts[7] is not None and counts[7] == total[8]
                total = [*(a + b for a, b in zip(total[:4], counts[:4], strict=True)), total[4] + counts[4] + int(bool(meet)), total[5] if total[0] else counts[5], counts[6],
                         counts[7] if total[7] is None else total[7], total[8] if counts[8] is None else counts[8], total[9] + counts[9] - same]
            if len(made.rows) >= 512:
                yield made.batch(id_type)
    if total is not None:
        close()
        yield made.batch(id_type)


@dataclass
class Repaired:
    """``report``: a row for each conversation; ``rows``: its repaired rows in pieces, in the order of ``part`` and ``piece``."""

    report: DataFrame  # conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    rows: DataFrame  # conv_id, part, piece, whole, rows

    def one_by_one(self) -> DataFrame:
        """``(conv_id, part, piece, place, role, text)``."""
        return self.rows.select("conv_id", "part", "piece", F.posexplode("rows").alias("place", "row")).select("conv_id", "part", "piece", "place", "row.*")


def repair(rows: DataFrame, ids: DataFrame | None = None, piece_rows: int = PIECE_ROWS) -> Repaired:
    """Repairs of the conversations of ``rows(conv_id, turn, role, text)``, and of those ids of ``ids`` that have no row.

    A null role or text is a space, a null id a conversation like any other, a null turn before all others. Rows of
    one turn come in the order of their roles, then of a digest of their texts, so that equal rows are neighbours.
    A conversation without rows is repaired already. Other columns are left aside. Turns are whole numbers.

    The audit of a conversation is one string, as long as the conversation, composed in one task from the tables of its pieces.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    kind, names = rows.schema["conv_id"].dataType.simpleString(), [c.split()[0] for c in _columns(_COUNTS)]
    pieces = pieces_of(rows, rows if ids is None else ids, piece_rows)
    some = pieces.where("NOT whole")
    ordered = some.select("conv_id", "part", "piece", *names, "ways").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "piece")
    chosen = materialise(ordered.mapInArrow(_compose, f"conv_id {kind}, {_CHOSEN}"))
    counted = pieces.where("whole").select("conv_id", *names, F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit")).unionByName(
        chosen.where("piece IS NULL").select("conv_id", *names, "cost", "audit"))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    report = counted.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _Emitter(f"part int, piece int, whole boolean, {_ROWS}")
            for c, part, piece, given, state, audit in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                done = apply_edits([(r["role"], r["text"]) for r in given], audit, state)[0]
                made.rows.append((c, part, piece, False, [{"role": a, "text": b} for a, b in done]))
            yield made.batch(batch.column(0).type)

    edits = chosen.where("piece IS NOT NULL").select("part", "piece", "state", "audit")
    mended = some.select("conv_id", "part", "piece", "rows").join(edits, ["part", "piece"]).select("conv_id", "part", "piece", "rows", "state", "audit")
    mended = mended.mapInArrow(mend, f"conv_id {kind}, part int, piece int, whole boolean, {_ROWS}")
    return Repaired(report, pieces.where("whole").select("conv_id", "part", "piece", "whole", "rows").unionByName(mended))


def with_digest(done: Repaired) -> DataFrame:
    """The report with ``repaired_sha256``, of the repaired ``role:text``, newlines between them.

    The digest of a conversation that is in several pieces is taken over its rows in a stream, which only one task can do.
    """
    lines = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    kind = done.rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, id_type, conv, digest, empty = _Emitter("repaired_sha256 string"), pa.int64(), None, None, True
        for batch in batches:
            id_type = batch.column(0).type
            for c, n, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        made.rows.append((conv, digest.hexdigest()))
                    conv, digest, empty = c, hashlib.sha256(), True
                if n:
                    digest.update(("" if empty else "\n").encode() + text.encode())
                    empty = False
            if made.rows:
                yield made.batch(id_type)
        if digest is not None:
            made.rows.append((conv, digest.hexdigest()))
            yield made.batch(id_type)

    streamed = done.rows.where("NOT whole").select("conv_id", "part", "piece", F.size("rows").alias("n"), lines.alias("lines"))
    streamed = streamed.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "piece").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
    digests = done.rows.where("whole").select("conv_id", F.sha2(lines, 256).alias("repaired_sha256")).unionByName(streamed).withColumnRenamed("conv_id", "__conv")
    return done.report.join(digests, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
