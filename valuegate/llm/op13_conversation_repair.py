"""Conversation structure repair: the cheapest edits that make a conversation's roles ``(s?(ua)+)?``, by divide and conquer.

What a conversation's roles so far allow next is one of four states, so a stretch of rows is known by four costs. As in
Hirschberg's linear-space alignment (1975), a stretch is cut in the middle; four costs forward from its entry and four
backward from its exit meet there, the crossing of least cost is taken (of equal ones the one whose audit is ASCII-least),
and both halves are solved alike. A conversation that crosses partitions is cut at its parts in the same way: each part gives
sixteen costs, the crossings between parts are chosen from these alone, and every part is then solved by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuegate.llm.conversations import batched, by_conversation, in_order, ordered, runs
from valuegate.llm.storage import table, written

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States by what came last: nothing, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: What a row is: its role's initial, upper case if truncated, or ``x`` if it must go.
KINDS = "suaoSUAOx"


def _next(state: int, initial: str) -> int | None:
    """The state after a row of this initial, None where the language has no such row."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _wanted(state: int) -> str:
    """The initial of the only role that an inserted or changed row can have."""
    return "a" if state == USER else "u"


def _moves(kind: str) -> list[dict[int, tuple[int, str]]]:
    """Per state before a row: the states after it, each with the least (cost, edits). Inserted rows stand before the row's own edit.

    Each choice ends with the row's one letter other than I, so no choice begins another, and audits of equal rows compare choice by choice.
    """
    out: list[dict[int, tuple[int, str]]] = []
    for before in range(4):
        found: dict[int, tuple[int, str]] = {}
        state = before
        for inserted in range(3):
            cost, letters, extra = INSERT * inserted, "I" * inserted, TRUNCATED if kind.isupper() else 0
            choices = [(state, cost + DELETE, letters + "D")]
            if kind != "x":
                kept = _next(state, kind.lower())
                choices += [(kept, cost + extra, letters + "K")] if kept is not None else []
                choices += [(_next(state, _wanted(state)), cost + REROLE + extra, letters + "R")]
            for after, c, edits in choices:
                found[after] = min(found.get(after, (FAR, "")), (c, edits))
            state = _next(state, _wanted(state))
        out.append(found)
    return out


MOVES = {kind: _moves(kind) for kind in KINDS}
#: Edits behind the last row, per state.
ENDING = {NONE: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def forward(kinds: str, entry: int) -> tuple[list[int], list[int]]:
    """Per state: the least cost from ``entry`` through all rows, and the place of its least audit among the four."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[entry] = 0
    for kind in kinds:
        best: dict[int, tuple[int, int, str]] = {}
        for before, moves in enumerate(MOVES[kind]):
            if cost[before] < FAR:
                for after, (c, edits) in moves.items():
                    one = (cost[before] + c, rank[before], edits)
                    if after not in best or one < best[after]:
                        best[after] = one
        order = sorted((r, edits, after) for after, (_, r, edits) in best.items())
        cost, rank = [best[s][0] if s in best else FAR for s in range(4)], [0] * 4
        for k, (_, _, after) in enumerate(order):
            rank[after] = k
    return cost, rank


def backward(kinds: str, last: list[int]) -> list[int]:
    """Per state: the least cost from there through all rows, when it costs ``last`` after them."""
    for kind in reversed(kinds):
        last = [min((c + last[after] for after, (c, _) in moves.items()), default=FAR) for moves in MOVES[kind]]
    return last


def crossing(cost: list[int], rank: list[int], rest: list[int]) -> int:
    """Of the states of least whole cost the one whose audit so far is ASCII-least."""
    return min((s for s in range(4) if cost[s] < FAR and rest[s] < FAR), key=lambda s: (cost[s] + rest[s], rank[s]))


def audit_between(kinds: str, entry: int, leave: int) -> str:
    """The least audit of all rows from state ``entry`` to state ``leave``; a few numbers a row at most are held at any time."""
    if len(kinds) < 2:
        return MOVES[kinds][entry][leave][1] if kinds else ""
    half = len(kinds) // 2
    at = crossing(*forward(kinds[:half], entry), backward(kinds[half:], [0 if s == leave else FAR for s in range(4)]))
    return audit_between(kinds[:half], entry, at) + audit_between(kinds[half:], at, leave)


@lru_cache(maxsize=1 << 15)
def audit_of(kinds: str) -> str:
    """The least audit of a whole conversation."""
    leave = crossing(*forward(kinds, NONE), [ENDING[s][0] for s in range(4)])
    return audit_between(kinds, NONE, leave) + ENDING[leave][1]


def audit_cost(audit: str, kinds: str) -> int:
    rows, cost = iter(kinds), 0
    for edit in audit:
        truncated = edit != "I" and next(rows).isupper()
        cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if truncated and edit != "D" else 0)
    return cost


def apply(audit: str, state: int, kinds: str, roles: list[str], texts: list[str]) -> list[dict]:
    """The rows that the edits leave, from ``state`` on."""
    out, k = [], 0
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        kept = edit == "K"
        initial = kinds[k].lower() if kept else _wanted(state)
        role = roles[k] if kept else "assistant" if initial == "a" else "user"
        out.append({"role": role, "text": "" if edit == "I" else texts[k], "edit": edit})
        state = _next(state, initial)
        k += edit != "I"
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of all rows: how often each stands in the damaged conversation, and as what. Null roles and texts are a space."""
    cast = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(cast("conv_id"), F.lit(":"), cast("turn"))) % 20
    text = F.when(what <= 1, "").when(what == 2, F.translate(cast("text"), ".!?", "")).otherwise(cast("text"))
    role = F.when(what == 4, "user").otherwise(cast("role"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("copies"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "array<struct<role: string, text: string, edit: string>>": pa.list_(_ROW)}


def _schema(columns: dict[str, str]) -> tuple[str, pa.Schema]:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items()), pa.schema([(name, _TYPES[kind]) for name, kind in columns.items()])


_PART = {"conv_id": "long", "part": "long", "whole": "boolean"}
_COUNTS = dict.fromkeys(COUNTS, "long")
_REPAIRED = {"audit": "string", "repaired": "array<struct<role: string, text: string, edit: string>>"}
_EDGES = {"low": "long", "high": "long", "turns": "long", "first": "string", "last": "string"}
#: Of a part that is not a whole conversation: its rows.
_OPEN = {"kinds": "string", "initials": "string", "roles": "array<string>", "texts": "array<string>", "digests": "array<binary>"}
CUT, CUT_ARROW = _schema(_PART | _COUNTS | _REPAIRED | _EDGES | _OPEN)
SETTLED, SETTLED_ARROW = _schema({"conv_id": "long", "part": "long"} | _COUNTS | _EDGES | {"kinds": "string", "costs": "array<long>", "ranks": "array<long>"})
ROUTE, ROUTE_ARROW = _schema({"part": "long", "entry": "long", "leave": "long", "ending": "string"} | {k: "long" for k in ("gaps", "illegal")})
OUT, OUT_ARROW = _schema(_PART | _COUNTS | _REPAIRED)


def _legal(initials: str) -> int:
    """Adjacent rows whose roles may not follow each other."""
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))


def _judged(faults: list[str], twice: list[bool]) -> tuple[str, dict[str, int]]:
    """Kinds of rows and counts of faults, of rows as they are alone (``x`` blank) and whether each was seen before."""
    kinds = "".join("x" if again else kind for kind, again in zip(faults, twice, strict=True))
    blank = faults.count("x")
    return kinds, {"blank": blank, "duplicate": sum(again and kind != "x" for kind, again in zip(faults, twice, strict=True)), "truncated": sum(k.isupper() for k in kinds)}


def _cut(rows: DataFrame) -> DataFrame:
    """Parts of conversations: whole ones repaired, the rows of others."""
    end = F.rtrim("text", F.lit(SPACE))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    kind = F.when(end == "", "x").when(F.right(end, F.lit(1)).isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    seen = rows.withColumns({"kind": kind, "initial": initial})

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, starts, names, whole in runs(batches):
            columns = {c: rows.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "kind", "initial")}
            for k, (name, one) in enumerate(zip(names.tolist(), whole.tolist(), strict=True)):
                at = [i for i in range(starts[k], starts[k + 1]) for _ in range(columns["copies"][i])]
                turn, role, text, kind, initial = ([columns[c][i] for i in at] for c in ("turn", "role", "text", "kind", "initial"))
                known = [t for t in turn if t is not None]
                row = {"conv_id": columns["conv_id"][starts[k]], "part": name, "whole": one}
                row |= {"low": known[0], "high": known[-1], "turns": len(set(known))} if known else {"low": None, "high": None, "turns": 0}
                earlier: set[tuple[str, str]] = set()
                twice = [(key in earlier, earlier.add(key))[0] for key in zip(role, text, strict=True)]
                row["illegal"] = _legal(initial)
                if one:
                    kinds, counts = _judged(kind, twice)
                    audit = audit_of(kinds)
                    gaps = row["high"] - row["low"] + 1 - row["turns"] if known else 0
                    row |= counts | {"gaps": gaps, "cost": audit_cost(audit, kinds), "audit": audit, "repaired": apply(audit, NONE, kinds, role, text)}
                else:
                    joined = [hashlib.blake2b(r.encode() + b"\0" + t.encode() + len(r).to_bytes(8), digest_size=16).digest() for r, t in zip(role, text, strict=True)]
                    row |= {"first": initial[0] if at else "", "last": initial[-1] if at else "", "kinds": "".join(kind), "initials": "".join(initial), "roles": role, "texts": text, "digests": joined}
                yield row

    return seen.mapInArrow(lambda batches: batched(parts(batches), CUT_ARROW, 200), CUT)


def _settled(parts: DataFrame) -> DataFrame:
    """Cut parts with the faults of their rows, and the costs and audits' places from each of four states to each of four."""
    # A text that comes again in the part counts there; one that an earlier part holds is told to the part. Each part names a text once.
    digests = parts.select("conv_id", "part", F.explode(F.array_distinct("digests")).alias("digest"))
    again = digests.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("part"))).filter("rank > 1")
    told = again.groupBy("part").agg(F.collect_list("digest").alias("told"))
    joined = parts.select("conv_id", "part", *COUNTS, *_EDGES, "kinds", "digests").join(told, "part", "left")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in (r for b in batches for r in b.to_pylist()):
            earlier, twice = set(row.pop("told") or ()), []
            for d in row.pop("digests"):
                twice.append(d in earlier)
                earlier.add(d)
            kinds, counts = _judged(list(row["kinds"]), twice)
            ways = [forward(kinds, entry) for entry in range(4)]
            yield row | counts | {"kinds": kinds, "costs": [c for cost, _ in ways for c in cost], "ranks": [r for _, rank in ways for r in rank]}

    return joined.mapInArrow(lambda batches: batched(settle(batches), SETTLED_ARROW, 200), SETTLED)


def _routes(settled: DataFrame) -> DataFrame:
    """Per part of a cut conversation the states where it is entered and left; a conversation is some forty numbers a part here."""

    def route(parts: pa.Table) -> pa.Table:
        rows = sorted(parts.to_pylist(), key=lambda r: r["part"])
        rest = [[ENDING[s][0] for s in range(4)]]
        for row in reversed(rows):
            rest.append([min(row["costs"][4 * p + s] + rest[-1][s] for s in range(4)) for p in range(4)])
        rest.reverse()
        out, state, last, high, low, turns = [], NONE, "", None, None, 0
        for row, after in zip(rows, rest[1:], strict=True):
            at = slice(4 * state, 4 * state + 4)
            leave = crossing(row["costs"][at], row["ranks"][at], after)
            illegal = row["illegal"] + (_legal(last + row["first"]) if last and row["first"] else 0)
            out.append({"part": row["part"], "entry": state, "leave": leave, "ending": "", "gaps": 0, "illegal": illegal})
            turns += row["turns"] - (row["low"] is not None and row["low"] == high)
            low, high = row["low"] if low is None else low, high if row["high"] is None else row["high"]
            state, last = leave, row["last"] or last
        out[-1] |= {"ending": ENDING[state][1], "gaps": 0 if low is None else high - low + 1 - turns}
        return pa.Table.from_pylist(out, schema=ROUTE_ARROW)

    return settled.drop("kinds").groupBy("conv_id").applyInArrow(route, ROUTE)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, part, whole, counts, audit, repaired) of rows with ``copies``; the counts and audits of a conversation's parts add up in order.

    ``repaired`` are the rows that are left, each with its edit. Rows go by turn, nulls first, rows of one turn by role and
    text; a row with ``copies`` 2 is followed by itself, one with 0 is gone. A conversation without rows has counts of
    0 and an empty audit. Rows without a conversation id are one conversation of id null; an empty table gives no row.
    Other columns are not read. The parts are written once; the rows of cut conversations are shuffled once more.
    """
    cut = written(_cut(ordered(rows.select("conv_id", "turn", "role", "text", "copies"), "conv_id", "turn", "role", "text")), "conversation-parts")
    opened = cut.filter(~F.col("whole"))
    settled = written(_settled(opened), "conversation-costs")
    routes = _routes(settled)
    known = settled.select("part", "kinds", "blank", "duplicate", "truncated").join(routes, "part")
    joined = opened.select("conv_id", "part", "whole", "roles", "texts").join(known, "part")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in (r for b in batches for r in b.to_pylist()):
            audit = audit_between(row["kinds"], row["entry"], row["leave"]) + row["ending"]
            yield row | {"cost": audit_cost(audit, row["kinds"]), "audit": audit, "repaired": apply(audit, row["entry"], row["kinds"], row["roles"], row["texts"])}

    solved = joined.mapInArrow(lambda batches: batched(solve(batches), OUT_ARROW, 20), OUT)
    return cut.filter("whole").select(solved.columns).unionByName(solved)


DIGEST, DIGEST_ARROW = _schema({"conv_id": "long"} | _COUNTS | {"audit": "string", "repaired_sha256": "string"})
PARTS, PARTS_ARROW = _schema({"conv_id": "long", "part": "long"} | _COUNTS | {"audit": "string", "repaired_sha256": "string", "lines": "binary"})


def digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation: its counts, its audit and the digest of its repaired ``role:text`` lines. Only the lines of cut conversations move."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in (r for b in batches for r in b.to_pylist()):
            lines, whole = "\n".join(f"{r['role']}:{r['text']}" for r in row.pop("repaired")).encode(), row.pop("whole")
            yield row | ({"repaired_sha256": hashlib.sha256(lines).hexdigest()} if whole else {"lines": lines})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, parts in by_conversation(batches):
            out, audit, lines, begun = {"conv_id": conv} | dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), False
            for part in parts:
                out |= {k: out[k] + part[k] for k in COUNTS}
                audit.append(part["audit"])
                if part["lines"]:
                    lines.update(b"\n" * begun + part["lines"])
                    begun = True
                out["repaired_sha256"] = part["repaired_sha256"] or lines.hexdigest()
            yield out | {"audit": "".join(audit)}

    parts = repaired.mapInArrow(lambda batches: batched(narrow(batches), PARTS_ARROW, 200), PARTS)
    return in_order(parts, "conv_id", "part").mapInArrow(lambda batches: batched(joined(batches), DIGEST_ARROW), DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damaged(table(spark, sf_dir, "conversations"))))
