"""Repair of conversations: turns that are blank, said twice or cut off go or are paid for, roles are put in order.

What came in is an acceptor with an arc for each turn; the edit transducer keeps a turn, gives it another role, deletes it,
or inserts an empty one; the role grammar `(s?(ua)+)?` accepts what comes out. Their composition is never built: its states
are a turn and a state of the grammar, and arcs are made as a state is left, turn by turn in topological order. Weights are
(cost, labels), compared in that order, so the shortest path is the cheapest repair and among those the one whose labels
come first. Labels of one turn are its insertions and its edit (`D`, `K`, `IK`, `R`, ...), a prefix-free code, and from a
given state they lead to one state only; so paths that meet differ, and comparing them needs only the order of the states
they came from. A turn's insertions never go before a deletion, since behind it they cost the same and come later.

Conversations are sorted by range over all tasks and cut into blocks of at most `block` turns, so one of very many turns is
spread. Where a task sees both ends of a conversation of one block, it is repaired there. Of others each block gives the
weights from every state to every state; these are composed for each conversation (an entry a block, no turns), and each
block is then repaired from the state that the path enters it with.

Edge cases: turns come by turn number, nulls first, then by role and the md5 of the text, so that repeats stay together; a
null role or text is one space; a null conv_id is a conversation of its own; a text is blank where it has nothing but
spaces, tabs and line ends; an empty role is none of the grammar's; repeated rows are said twice; a conversation without
turns has an empty repair; an empty table gives no rows. Other columns are not read and cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.sizes import broadcast_up_to
from .common import only, partitions_for, stored, text_batches

BLANK = " \t\n\x0b\x0c\r"
#: Cost of a kept turn, of another role, of a deletion, of an insertion, and of a turn that is cut off and not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar: states 0 start, 1 after s, 2 after u, 3 after a; the first and the last accept.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, BLOCK, BLOCK_CHARS = 4, 4096, 4 << 20
ROLES = {"u": "user", "a": "assistant"}
NEXT = {(q, r): STEPS[q, r] for q, r in STEPS if r in ROLES}


def _insertions(state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, labels, state) of none to two insertions; a third would come back to where the first led."""
    for n in range(3):
        yield n * INSERT, "I" * n, state
        state = next(to for (q, _), to in NEXT.items() if q == state)


def _arcs(kind: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, labels, state) of what a turn can become in a state of the grammar. kind: initial of the role, fault."""
    initial, fault = kind
    arcs = [(DELETE, "D", state)]
    if fault not in "bd":
        more = TRUNCATED * (fault == "t")
        for cost, labels, at in _insertions(state):
            if (at, initial) in STEPS:
                arcs.append((cost + KEEP + more, labels + "K", STEPS[at, initial]))
            arcs.extend((cost + REROLE + more, labels + "R", to) for (q, _), to in NEXT.items() if q == at)
    return arcs


_MADE: dict[tuple[str, int], list[tuple[int, str, int]]] = {}


def _walk(kinds: str, start: int) -> tuple[dict[int, tuple[int, int]], list[dict[int, tuple[int, str]]]]:
    """(state -> (cost, order among the states' labels), for each turn state -> (state before, labels)) from one state."""
    now, back = {start: (0, 0)}, []
    for i in range(0, len(kinds), 2):
        kind, best = kinds[i : i + 2], {}
        for state, (cost, order) in now.items():
            arcs = _MADE.get((kind, state))
            if arcs is None:
                arcs = _MADE[kind, state] = _arcs(kind, state)
            for more, labels, to in arcs:
                new = (cost + more, order, labels, state)
                if to not in best or new < best[to]:
                    best[to] = new
        back.append({to: (state, labels) for to, (_, _, labels, state) in best.items()})
        now = _ordered({to: (cost, (order, labels)) for to, (cost, order, labels, _) in best.items()})
    return now, back


def _ordered(states: dict[int, tuple]) -> dict[int, tuple[int, int]]:
    """state -> (cost, place) from state -> (cost, what to order by)."""
    place = {to: i for i, to in enumerate(sorted(states, key=lambda to: states[to][1]))}
    return {to: (cost, place[to]) for to, (cost, _) in states.items()}


def _end(now: dict[int, tuple[int, int]]) -> tuple[int, int, str]:
    """(state, cost, labels of the insertions behind the last turn) of the best way to an accepting state."""
    tails = {0: "", 1: "II", 2: "I", 3: ""}
    state = min(now, key=lambda q: (now[q][0] + INSERT * len(tails[q]), now[q][1]))
    return state, now[state][0] + INSERT * len(tails[state]), tails[state]


def _repaired(back: list[dict], enter: int, leave: int, tail: str, roles: list[str], texts: list[str]) -> tuple[str, list[str], list[str]]:
    """(labels, roles, texts) of the path from state to state, and of what is inserted behind it."""
    steps, state = [], leave
    for arcs in reversed(back):
        state, labels = arcs[state]
        steps.append(labels)
    out_roles, out_texts, state = [], [], enter
    for i, labels in enumerate([*reversed(steps), tail]):
        for label in labels:
            if label == "D":
                continue
            if label == "K":
                role, to = roles[i], STEPS[state, roles[i][:1]]
            else:
                (role, to) = next((ROLES[r], to) for (q, r), to in NEXT.items() if q == state)
            out_roles.append(role)
            out_texts.append("" if label == "I" else texts[i])
            state = to
    return "".join([*reversed(steps), tail]), out_roles, out_texts


def faults(text: Column, again: Column) -> Column:
    """The first fault of a turn: b blank, d said before, t cut off, - none."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", "b").when(again, "d").when(last.isin(".", "!", "?"), "-").otherwise("t")


_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
_BLOCK = "first string, last string, low long, high long, " + ", ".join(f"{c} long" for c in _COUNTS)
BLOCKS = f"conv_id {{kind}}, part int, seq int, whole boolean, kinds string, roles array<string>, texts array<string>, {_BLOCK}"
PIECES = f"conv_id {{kind}}, part int, seq int, whole boolean, cost long, audit string, roles array<string>, texts array<string>, {_BLOCK}"
_LEGAL = {"su", "ua", "au"}


def _blocks(df: DataFrame, block: int) -> DataFrame:
    """Blocks of the conversations of sorted turns, with their counts. df: conv_id, turn, role, text, fault (null: not a turn)."""
    ddl = BLOCKS.format(kind=df.schema["conv_id"].dataType.simpleString())
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ready, seq = TaskContext.get().partitionId(), [], 0
        at, begun, rows, chars, opened = None, False, [], 0, False

        def close(end: bool) -> None:
            """The rows held are a block; end: the conversation ends with it, as this task knows."""
            nonlocal seq, chars
            kinds = "".join((r[1][:1] or "x") + r[3] for r in rows)
            turns = sorted({r[0] for r in rows if r[0] is not None})
            ready.append({
                "conv_id": at, "part": part, "seq": seq, "whole": end and opened, "kinds": kinds, "roles": [r[1] for r in rows], "texts": [r[2] for r in rows],
                "first": rows[0][1][:1] if rows else None, "last": rows[-1][1][:1] if rows else None, "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
                "rows": len(rows), "blank": kinds[1::2].count("b"), "duplicate": kinds[1::2].count("d"), "truncated": kinds[1::2].count("t"),
                "illegal": sum(a[1][:1] + b[1][:1] not in _LEGAL for a, b in zip(rows, rows[1:])), "turns": len(turns),
            })
            rows.clear()
            seq, chars = seq + 1, 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(ready, schema=schema)
            ready.clear()
            return made

        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != at:
                    if begun:
                        close(True)
                    # whether the first conversation of a task begins there is not known
                    at, opened, begun = conv, begun, True
                if row[3] is None:
                    continue
                if len(rows) >= block or chars >= BLOCK_CHARS:
                    close(False)
                    opened = False
                rows.append(row)
                chars += len(row[2])
                if len(ready) >= 1000 or sum(len(r["kinds"]) for r in ready[-1:]) >= block:
                    yield out()
            if ready:
                yield out()
        if begun:
            close(False)
            yield out()

    return text_batches(df).mapInArrow(run, ddl)


def _map(df: DataFrame, ddl: str, work) -> DataFrame:
    """df's rows as dicts through work, a dict in, dicts out."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([out for row in batch.to_pylist() for out in work(row)], schema=schema)

    return text_batches(df).mapInArrow(run, ddl)


def _solve(row: dict, enter: int, leave: int | None, tail: str) -> dict:
    now, back = _walk(row["kinds"], enter)
    cost = 0
    if leave is None:
        leave, cost, tail = _end(now)
    audit, roles, texts = _repaired(back, enter, leave, tail, row["roles"], row["texts"])
    return row | {"cost": cost, "audit": audit, "roles": roles, "texts": texts}


def _weights(row: dict) -> Iterator[dict]:
    """The block without its turns; from each state the (state, cost) of all others, in the order of their labels."""
    ways = [_walk(row["kinds"], q)[0] for q in range(STATES)]
    yield {k: v for k, v in row.items() if k not in ("kinds", "roles", "texts")} | {"ways": [[(to, cost) for to, (cost, _) in sorted(w.items(), key=lambda x: x[1][1])] for w in ways]}


def _compose(row: dict) -> Iterator[dict]:
    """The path through the blocks of one conversation: the state each block is entered and left with; counts over borders."""
    blocks = row["blocks"]
    now, back = {0: (0, 0)}, []
    for b in blocks:
        best: dict[int, tuple] = {}
        for state, (cost, order) in now.items():
            for place, way in enumerate(b["ways"][state]):
                new = (cost + way["cost"], order, place, state)
                if way["to"] not in best or new < best[way["to"]]:
                    best[way["to"]] = new
        back.append({to: new[3] for to, new in best.items()})
        now = _ordered({to: (cost, (order, place)) for to, (cost, order, place, _) in best.items()})
    state, cost, tail = _end(now)
    last, before = len(blocks) - 1, None
    out = []
    for i in range(last, -1, -1):
        enter = back[i][state]
        out.append({"enter": enter, "leave": state, "tail": tail if i == last else "", "cost": cost if i == last else 0})
        state = enter
    for b, made in zip(blocks, reversed(out), strict=True):
        # a border adds a pair of neighbours, and a turn number on both sides was counted twice
        over = {"illegal": 0, "turns": 0}
        if before is not None and b["rows"]:
            over = {"illegal": int((before["last"] or "") + (b["first"] or "") not in _LEGAL), "turns": -int(before["high"] is not None and before["high"] == b["low"])}
        before = b if b["rows"] else before
        yield {"conv_id": row["conv_id"], "part": b["part"], "seq": b["seq"]} | made | {f"over_{k}": v for k, v in over.items()}


def repair(turns: DataFrame, *, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Pieces of repaired conversations: conv_id, part, seq (their order), whole (the only one), cost (with the last piece),
    audit (labels of the edits), roles and texts of the turns that come out, and counts of what came in: rows, blank,
    duplicate, truncated, illegal, turns (distinct numbers), low and high (of them), first and last (initials).

    turns: conv_id, turn, role, text; gone, if there is such a column: the row only says that its conversation exists."""
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    rows = rows.select("*", F.md5("text").alias("mark"), F.monotonically_increasing_id().alias("copy"))
    rows = stored(rows, "turns")
    # nulls first, as in the order of turns
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "copy")
    says = rows.where("NOT gone").groupBy("conv_id", "role", "mark").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1")
    says = broadcast_up_to(stored(says.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"), F.col("first.copy").alias("first")), "turns-said"), 100_000)
    told = rows.join(says, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m")), "left")
    again = F.coalesce(F.col("first") != F.col("copy"), F.lit(False))
    told = told.select("conv_id", "turn", "role", "text", F.when(~F.col("gone"), faults(F.col("text"), again)).alias("fault"), "mark", "copy")
    n = parts or partitions_for(turns)
    keys = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("mark").asc(), F.col("copy").asc())
    told = told.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "fault")
    kind = told.schema["conv_id"].dataType.simpleString()
    blocks = stored(_blocks(told, block), "turns-blocks")
    ddl = PIECES.format(kind=kind)
    whole = _map(blocks.where("whole"), ddl, lambda row: [{k: v for k, v in _solve(row, 0, None, "").items() if k != "kinds"}])
    ways = _map(blocks.where("NOT whole"), f"conv_id {kind}, part int, seq int, whole boolean, {_BLOCK}, ways array<array<struct<to: int, cost: long>>>", _weights)
    entry = F.struct("part", "seq", "rows", "first", "last", "low", "high", "ways")
    path = _map(ways.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("blocks")), f"conv_id {kind}, part int, seq int, enter int, leave int, tail string, cost long, over_illegal long, over_turns long", _compose)
    # part and seq name a block, so a null conv_id needs no care
    cut = blocks.where("NOT whole").join(stored(path, "turns-path").drop("conv_id"), ["part", "seq"])
    cut = cut.select("conv_id", "part", "seq", "whole", "kinds", "roles", "texts", "first", "last", "low", "high", "rows", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("over_illegal")).alias("illegal"), (F.col("turns") + F.col("over_turns")).alias("turns"), "enter", "leave", "tail", F.col("cost").alias("total"))

    def finish(row):
        total = row.pop("total")
        enter, leave, tail = (row.pop(k) for k in ("enter", "leave", "tail"))
        made = _solve(row, enter, leave, tail) | {"cost": total}
        return [{k: v for k, v in made.items() if k != "kinds"}]

    return whole.unionByName(_map(cut, ddl, finish))


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """conv_id, part, seq, place, role, text: the turns that come out, a row each."""
    return pieces.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn")).select("conv_id", "part", "seq", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: some rows dropped, emptied, stripped of sentence ends, repeated or given to the user,
    by the hash of their key; dropped ones stay as rows that are gone."""
    rows = only(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    rows = rows.withColumn("h", F.crc32(key) % 20)
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _hashed(pieces: DataFrame) -> DataFrame:
    """conv_id, hash of `role:text` lines over the pieces of conversations in several pieces, read in order and never held together."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    rows = pieces.repartition(partitions_for(pieces), "conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "roles", "texts")
    schema = pa.schema([("conv_id", to_arrow_schema(rows.schema).field("conv_id").type), ("repaired_sha256", pa.string())])

    def run(batches):
        at, sha, any_row, begun = None, hashlib.sha256(), False, False
        done: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if begun and row["conv_id"] != at:
                    done.append({"conv_id": at, "repaired_sha256": sha.hexdigest()})
                    sha, any_row = hashlib.sha256(), False
                at, begun = row["conv_id"], True
                for role, text in zip(row["roles"], row["texts"], strict=True):
                    sha.update(f"{chr(10) * any_row}{role}:{text}".encode("utf-8", "surrogatepass"))
                    any_row = True
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv_id": at, "repaired_sha256": sha.hexdigest()}], schema=schema)

    return rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def digest(pieces: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    pieces = stored(pieces, "turns-pieces")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    said = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit(":"), t["texts"])), "\n")
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    one = pieces.where("whole").select("*", gaps, F.sha2(said, 256).alias("repaired_sha256")).select(*columns)
    cut = pieces.where("NOT whole")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns")]
    # the labels of a conversation are one value of the result, and that is all that is gathered
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "audit"))), lambda p: p["audit"]), "").alias("audit")
    many = cut.groupBy("conv_id").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), audit).select("*", gaps)
    hashed = _hashed(cut).withColumnRenamed("conv_id", "c")
    return one.unionByName(many.join(hashed, F.col("conv_id").eqNullSafe(F.col("c"))).select(*columns))
