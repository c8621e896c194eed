"""Conversation structure repair: the cheapest edits that make turns alternate, by bidirectional Dijkstra over the edit lattice.

A node of the lattice is how many rows are read and what the repaired turns end with (nothing, a system turn, a user turn, an assistant turn). Edits are its edges: Keep costs 0 where the role fits, Rerole to the user or assistant turn that fits 1, Delete 2, Insert the turn that fits, empty, 5; a truncated row that isn't deleted costs 5 more; blank and duplicate rows can only be deleted. What fits is told by the node, so the edits' initials (the audit) name a path.

* **Search.** Heaps from the start and from the ends meet in the middle. At each node either side keeps its least cost and, of equal costs, the least audit. They go on until no crossing as cheap as the best can be left; of all crossings of that cost the least concatenated audit counts. Nodes of one cost are settled in the order of rows, since keeping is free.
* **Long conversations.** Rows are dealt by ranges of (conversation, turn), so that a conversation may lie in many tasks. Each turns runs of at most `PIECE` rows into the least cost and audit from each state to each other one; a conversation's pieces are then put together in order. Two audits of one piece from one state to another are never one the beginning of the other (inserts cost), so the least of the parts make the least of the whole.
* **Texts** flow through tasks in sorted order and are never gathered.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, rows_fit

#: Rows that one search spans.
PIECE = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

_SPACE = " \t\n\v\f\r"
#: Faults by the codes of rows: 4 * fault + initial.
_FAULTS = ("", "truncated", "blank", "duplicate")
_INITIALS = "sua"
#: States: nothing, system, user, assistant. Where a kept turn leads, and what an inserted or reroled one must be.
_KEEPS = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
_FITS = (2, 2, 3, 2)
_START, _ENDS = 0, (0, 3)
_ROLE = {2: "user", 3: "assistant"}


def _steps(code: int, state: int) -> Iterator[tuple[int, int, str]]:
    """(next state, cost, edit) of a row of `code` read in `state`."""
    fault, initial = divmod(code, 4)
    yield state, DELETE, "D"
    if fault < 2:
        more = TRUNCATED if fault else 0
        if state in _KEEPS[initial]:
            yield _KEEPS[initial][state], KEEP + more, "K"
        yield _FITS[state], REROLE + more, "R"


#: The same, backwards: from which states a row leads to a state.
_BACK = [[[(s, cost, edit) for s in range(4) for t, cost, edit in _steps(code, s) if t == state] for state in range(4)] for code in range(16)]
_AHEAD = [[list(_steps(code, state)) for state in range(4)] for code in range(16)]
_INTO = [[s for s in range(4) if _FITS[s] == state] for state in range(4)]


def cheapest(codes: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of a run of rows from a state to one of `ends`, of equal ones the least audit; None if there is no way. codes: a character for each row."""
    code, n = [ord(c) - 48 for c in codes], len(codes)
    ahead, back = {(0, start): (0, "")}, {(n, t): (0, "") for t in ends}
    sides = (ahead, back)
    heaps = ([(0, 0, start)], [(0, 0, t) for t in sorted(ends)])
    done: tuple[set, set] = (set(), set())
    best = min((0 for node in back if node in ahead), default=None)
    while all(heaps):
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = int(heaps[0][0][0] > heaps[1][0][0])
        cost, at, state = heapq.heappop(heaps[side])
        i = n - at if side else at
        if (i, state) in done[side]:
            continue
        done[side].add((i, state))
        own, other = sides[side], sides[1 - side]
        audit = own[i, state][1]
        if side:
            found = [((i, s), INSERT, "I") for s in _INTO[state]] + ([((i - 1, s), c, e) for s, c, e in _BACK[code[i - 1]][state]] if i else [])
        else:
            found = [((i, _FITS[state]), INSERT, "I")] + ([((i + 1, t), c, e) for t, c, e in _AHEAD[code[i]][state]] if i < n else [])
        for node, more, edit in found:
            new = (cost + more, edit + audit if side else audit + edit)
            if node not in own or new < own[node]:
                own[node] = new
                heapq.heappush(heaps[side], (new[0], n - node[0] if side else node[0], node[1]))
                if node in other and (best is None or new[0] + other[node][0] < best):
                    best = new[0] + other[node][0]
    if best is None:
        return None
    return best, min(x[1] + back[node][1] for node, x in ahead.items() if node in back and x[0] + back[node][0] == best)


@lru_cache(maxsize=20_000)
def _whole(codes: str) -> list[dict]:
    cost, audit = cheapest(codes, _START, _ENDS)
    return [{"s": _START, "t": _ENDS[-1], "cost": cost, "audit": audit}]


def _piece(codes: str) -> list[dict]:
    """The ways through a piece, from each state to each other one."""
    ways = [(s, t, cheapest(codes, s, (t,))) for s in range(4) for t in range(4)]
    return [{"s": s, "t": t, "cost": x[0], "audit": x[1]} for s, t, x in ways if x]


def _texts(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(" "))


def marked(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, fault, row) of every row, written as a table; a null role or text is one space.

    fault: blank (nothing but white space), duplicate (role and text of an earlier row), truncated (doesn't end in . ! or ?, white space aside), or empty; the first that holds. Rows are ordered by turn (nulls first), then role and text; row is their number, in no order, which tells repeated rows apart.
    """
    rows = cut(turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), _texts(role).alias("role"), _texts(text).alias("text"), F.monotonically_increasing_id().alias("row")))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.col("conv_id").isNull(), F.length(conv), conv, F.length("role"), "role", "text").cast("binary"))
    keyed = rows.withColumn("key", key)
    # only keys that come again travel; their rows are counted in parts
    again = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("turn", "row")).alias("first")).where("n > 1").select("key", F.col("first.row").alias("first"))
    again = cut(again)
    known = keyed.join(F.broadcast(again) if rows_fit(again, 250_000) else again, "key", "left")
    rest = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = F.when(rest == "", "blank").when(F.col("first") != F.col("row"), "duplicate").when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    out = cut(known.select("conv_id", "turn", "role", "text", fault.alias("fault"), "row"))
    free(rows, again)
    return out


_ORDER = ("turn", "role", "text", "row")


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of `rows`, as `marked` gives them.

    gaps: turn numbers missing between the first and the last, nulls ignored; illegal: neighbours whose roles' initials aren't su, ua or au; cost, audit: the cheapest edits. Rows without a conversation's id are one conversation, with a null id.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    initial = F.coalesce(*(F.when(F.left("role", F.lit(1)) == c, F.lit(k)) for k, c in enumerate(_INITIALS)), F.lit(3))
    fault = F.coalesce(*(F.when(F.col("fault") == f, F.lit(4 * k)) for k, f in enumerate(_FAULTS)))
    coded = rows.repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER).select("conv_id", F.char(F.lit(48) + fault + initial).alias("code"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, ids, numbers, runs, ways = TaskContext.get().partitionId(), 0, [], [], [], []
        conv, codes, edge, first = None, [], True, True

        def end(last: bool) -> None:
            """A run of rows ends; last: no more of this conversation comes in this task."""
            nonlocal at, edge
            run = "".join(codes)
            codes.clear()
            if run:
                ids.append(conv), numbers.append(at), runs.append(run)
                ways.append(_whole(run) if last and not edge else _piece(run))
                at += 1
            edge = not last  # what follows goes on with the same conversation

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, kind_of), pa.array([part] * len(ids), pa.int32()), pa.array(numbers, pa.int64()), pa.array(runs, pa.string()), pa.array(ways, _WAYS)], names=["conv_id", "part", "at", "codes", "ways"])
            for x in (ids, numbers, runs, ways):
                x.clear()
            return out

        for batch in batches:
            kind_of = batch.schema.field("conv_id").type
            for c, code in zip(batch.column("conv_id").to_pylist(), batch.column("code").to_pylist(), strict=True):
                if first or c != conv:
                    if not first:
                        end(True)
                    conv, first = c, False
                codes.append(code)
                if len(codes) == PIECE:
                    end(False)
            if len(ids) > 1000:
                yield told()
        if not first:
            end(False)  # may go on in the next task
            yield told()

    kinds = f"conv_id {kind}, part int, at long, codes string, ways array<struct<s: int, t: int, cost: long, audit: string>>"
    runs = coded.mapInArrow(pieces, kinds)
    runs = cut(runs)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        conv, first = None, True
        own: dict = {}

        def end() -> None:
            cost, audit = min(own["at"][s] for s in _ENDS if s in own["at"])
            out.append({"conv_id": conv, **dict(zip(_FAULTS[1:], own["faults"], strict=True)), "illegal": own["illegal"], "cost": cost, "audit": "".join([*own["audit"], audit])})

        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), *((c, pa.int64()) for c in (*_FAULTS[1:], "illegal", "cost")), ("audit", pa.string())])
            for r in batch.to_pylist():
                if first or r["conv_id"] != conv:
                    if not first:
                        end()
                    conv, first = r["conv_id"], False
                    own = {"at": {_START: (0, "")}, "audit": [], "illegal": 0, "faults": [0, 0, 0], "last": ""}
                for k in range(3):
                    own["faults"][k] += sum((ord(c) - 48) // 4 == k + 1 for c in r["codes"])
                initials = own["last"] + "".join((*_INITIALS, "x")[(ord(c) - 48) % 4] for c in r["codes"])
                own["illegal"] += sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
                own["last"] = initials[-1]
                new: dict = {}
                for w in r["ways"]:
                    if w["s"] in own["at"]:
                        cost, audit = own["at"][w["s"]]
                        way = (cost + w["cost"], audit + w["audit"])
                        new[w["t"]] = min(way, new.get(w["t"], way))
                same = os.path.commonprefix([x[1] for x in new.values()])  # settled for good
                own["audit"].append(same)
                own["at"] = {t: (cost, audit[len(same) :]) for t, (cost, audit) in new.items()}
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if not first:
            end()
            yield pa.RecordBatch.from_pylist(out, schema)

    sums = runs.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").mapInArrow(together, f"conv_id {kind}, truncated long, blank long, duplicate long, illegal long, cost long, audit string")
    sums = cut(sums)
    # distinct turns are counted in parts, a row for each; a conversation has no more of them than rows
    turns = rows.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    out = sums.join(turns.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    out = cut(out.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
    free(runs, sums)
    return out


_WAYS = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, edit) of the repaired conversations: `rows` (as `marked` gives them) after the audits `found`. edit: K, R or I; an inserted turn has no number and an empty text.

    Rows of a conversation flow through one task in order, behind its audit, and none is held.
    """
    types = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in _ORDER]
    both = rows.select("conv_id", F.lit(1).alias("kind"), *_ORDER, F.lit("").alias("audit")).union(found.select("conv_id", F.lit(0), *none, "audit"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, first, audit, at, state, position = None, True, "", 0, _START, 0
        out: list[tuple] = []

        def put(turn, role: str, text: str, edit: str, to: int) -> None:  # noqa: ANN001
            nonlocal state, position
            out.append((conv, position, turn, role, text, edit))
            state, position = to, position + 1

        def inserts() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                to = _FITS[state]
                put(None, _ROLE[to], "", "I", to)
                at += 1

        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), ("position", pa.int64()), batch.schema.field("turn"), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
            for c, kind, turn, role, text, edits in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "kind", "turn", "role", "text", "audit")), strict=True):
                if kind == 0:
                    if not first:
                        inserts()
                    conv, first, audit, at, state, position = c, False, edits, 0, _START, 0
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit == "K":
                    put(turn, role, text, edit, _KEEPS[_INITIALS.index(role[0])][state])
                elif edit == "R":
                    put(turn, _ROLE[_FITS[state]], text, edit, _FITS[state])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [()] * 6, schema, strict=True)], schema=schema)
            out.clear()
        if not first:
            inserts()
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [()] * 6, schema, strict=True)], schema=schema)

    order = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER)
    return order.mapInArrow(apply, f"conv_id {types['conv_id']}, position long, turn {types['turn']}, role string, text string, edit string")


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): `audits` and `repaired` of a table of turns, so that the roles' initials of each conversation are nothing or an optional system turn and then user and assistant turns in pairs.

    Other columns are ignored, repeated rows are duplicates, null roles and texts are one space, rows without a conversation's id are one conversation. A conversation of which nothing stays has an audit and no turns; an empty table gives empty results.
    """
    rows = marked(turns, conv_id, turn, role, text)
    found = audits(rows)
    return found, repaired(rows, found)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of a repaired conversation's `role:text`, joined by line ends. A digest is taken in order, so a conversation's turns flow through one task; none is held."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        for batch in batches:
            ids, out, of = batch.column("conv_id").to_pylist(), [], batch.schema.field("conv_id").type
            for c, role, text in zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if sha is None or c != conv:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    sha.update(f"\n{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], of), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], of), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return turns.select("conv_id", "position", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(one, f"conv_id {kind}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, told by crc32 of `conv_id:turn` mod 20: 0 drops the row, 1 empties its text, 2 takes . ! and ? out of it, 3 repeats it, 4 makes it a user turn. Nulls are written, and stand in roles and texts, as one space."""
    h = F.crc32(F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id",)), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(_texts("text"), ".!?", "")).otherwise(_texts("text"))
    rows = turns.select("conv_id", "turn", F.when(h == 4, "user").otherwise(_texts("role")).alias("role"), text.alias("text"), h.alias("h")).where("h != 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("h", "copy")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """A row for each conversation of `turns`: what `repair` tells of them after `damaged`; zeros, an empty audit and the digest of nothing where no row is left."""
    found, rows = repair(damaged(turns))
    sums = found.join(digests(rows).withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    out = turns.select("conv_id").distinct().join(sums.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
