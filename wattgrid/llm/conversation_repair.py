"""Least-cost repair of the structure of conversations.

Rows of a conversation, in order, are kept, given another role, or deleted, and turns are inserted, so that
what remains is an optional system row and then pairs of user and assistant. A cost DP over (row, state)
gives the cheapest way; of equally cheap ones the least audit (the edits' initials) is wanted. The optimal
arcs are ranked by their audits of length 1, 2, 4, ...: the rank of twice the length comes from the pair of
ranks of an arc and of the arc that its pointer of that length leads to. Ranks choose the first arc, doubled pointers the rest.

A conversation may hold any share of the rows. Rows are range partitioned by conversation and order and cut into strips
of a few thousand; a strip's costs from each state to each state are a small min-plus matrix, and the matrices of one
conversation are multiplied from its end. Each strip then writes its least audit for each state it may be entered in, and one
streaming pass, in order, follows the states and reads the repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.llm.common import quoted
from wattgrid.session import checkpointed

STRIP_BITS = 12
PLACE_BITS = 33  # of a partition's own rows in monotonically_increasing_id
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing written, system written, a user's turn last, an assistant's turn last.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 60
#: The state after a user's or assistant's turn is added in each state.
ADDED = (USER, USER, ASSISTANT, USER)
#: The initial that a row must have to be kept, and the state it leads to.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Cheapest end from each state: nothing, or the turns that are still missing.
ENDINGS = (0, 2 * INSERT, INSERT, 0)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LABELS = "DIKR"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

SOLID = r"[^\x20\x09-\x0D]"
FINISHED = r"[.!?][\x20\x09-\x0D]*\z"


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of conv_id, turn, role, text, damaged by a checksum of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it the user's. Null roles and
    texts, and nulls in the checksum, stand as one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(kind == 4, "user").otherwise(said("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


# ---------------------------------------------------------------- one strip


def before_row(base: list[int]) -> list[int]:
    """Least costs before a row, where turns may be inserted, from those of the row's own edits."""
    user, assistant = min(base[USER], base[ASSISTANT] + INSERT), min(base[ASSISTANT], base[USER] + INSERT)
    return [min(base[BEGIN], user + INSERT), min(base[SYSTEM], user + INSERT), user, assistant]


def arcs_of(initial: str, gone: bool, cut: bool) -> list[list[tuple[str, int, int]]]:
    """From each state: the row's edits as (label, cost, next state)."""
    more = TRUNCATED if cut else 0
    out = []
    for state in range(4):
        arcs = [("D", DELETE, state)]
        if not gone:
            if initial in KEPT[state]:
                arcs.append(("K", more, KEPT[state][initial]))
            arcs.append(("R", REROLE + more, ADDED[state]))
        out.append(arcs)
    return out


ARCS: dict[tuple[str, bool, bool], list[list[tuple[str, int, int]]]] = {
    (i, g, c): arcs_of(i, g, c) for i in ("s", "u", "a", "") for g in (False, True) for c in (False, True)}


def costs_back(rows: list[tuple[str, bool, bool]], end: list[int]) -> list[list[int]]:
    """Least cost to the end before each row and after the last, by state."""
    out = [list(end)]
    for row in reversed(rows):
        after = out[-1]
        out.append(before_row([min(cost + after[to] for _, cost, to in arcs) for arcs in ARCS[row]]))
    return out[::-1]


def matrix_of(rows: list[tuple[str, bool, bool]]) -> list[int]:
    """Least costs from each state (rows) to each state (columns)."""
    by_end = [costs_back(rows, [0 if s == e else INF for s in range(4)])[0] for e in range(4)]
    return [min(by_end[e][s], INF) for s in range(4) for e in range(4)]


def optimal_arcs(rows: list[tuple[str, bool, bool]], costs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node (4 x place + state), label and next node of the arcs that a cheapest way may take."""
    node, label, to = [], [], []
    for i, row in enumerate(rows):
        here, after = costs[i], costs[i + 1]
        for state, arcs in enumerate(ARCS[row]):
            if here[state] >= INF:
                continue
            for name, cost, nxt in arcs:
                if here[state] == cost + after[nxt]:
                    node.append(4 * i + state)
                    label.append(name)
                    to.append(4 * (i + 1) + nxt)
            if here[state] == INSERT + here[ADDED[state]]:
                node.append(4 * i + state)
                label.append("I")
                to.append(4 * i + ADDED[state])
    return np.array(node, np.int64), np.array([LABELS.index(x) + 1 for x in label], np.int64), np.array(to, np.int64)


def least_audits(node: np.ndarray, label: np.ndarray, to: np.ndarray, nodes: int, starts: list[int]) -> list[list[tuple[int, int]]]:
    """The least audit from each start as (label, next node), by ranks of doubled lengths.

    Arcs are what is ranked; one more stands for the end and leads to itself. The labels of one node's arcs differ, so
    its least arc by label is the one that its least audit begins with, and each pointer is one arc.
    """
    end = len(node)
    rank = np.r_[label, 0]
    first = np.full(nodes, end, np.int64)
    by_rank = np.lexsort((-label, node))
    first[node[by_rank]] = by_rank  # the last written is the least label
    jump = np.r_[first[to], end]
    jumps = [jump]
    while (jump != end).any():
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        jump = jump[jump]
        jumps.append(jump)
    by_audit = np.lexsort((-rank[:end], node))
    first[node[by_audit]] = by_audit
    out = []
    for start in starts:
        path = np.array([first[start]])
        for k in range(len(jumps) - 1):  # places 0..2^k-1 are known; a pointer of that length gives as many more
            path = np.r_[path, jumps[k][path]]
        path = path[path != end]
        out.append(list(zip(label[path].tolist(), to[path].tolist())))
    return out


def faults_of(initials: list[str], blank: list[bool], cut: list[bool], keys: list[str], seen: set[str]) -> list[str]:
    """Each row's first fault: blank, duplicate or truncated, else nothing. ``seen`` gets the rows' keys."""
    out = []
    for b, c, key in zip(blank, cut, keys):
        out.append("blank" if b else "duplicate" if key in seen else "truncated" if c else "")
        seen.add(key)
    return out


def as_rows(initials: list[str], faults: list[str]) -> list[tuple[str, bool, bool]]:
    return [(i if i in ("s", "u", "a") else "", f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)]


def runs_of(conv: list) -> Iterator[tuple[int, int]]:
    begin = 0
    for k in range(1, len(conv) + 1):
        if k == len(conv) or conv[k] != conv[begin]:
            yield begin, k
            begin = k


# ---------------------------------------------------------------- over all rows


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of conversations and turns, cut into strips; hot conversations and turns lie in many partitions."""
    text, role = F.col("text"), F.col("role")
    marked = rows.select(F.struct("conv_id").alias("conv"), "turn", "role", "text", F.monotonically_increasing_id().alias("uid"))
    order = ("conv", F.col("turn").asc_nulls_first(), "role", "text", "uid")
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    solid = text.rlike(SOLID)
    return checkpointed(ranged.select(
        "conv", "turn", "role", "text", "place", F.shiftright("place", STRIP_BITS).alias("strip"), F.substring(role, 1, 1).alias("initial"), (~solid).alias("blank"),
        (solid & ~text.rlike(FINISHED)).alias("cut"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key")))


def _seen_before(slim: DataFrame) -> DataFrame:
    """``strip``, ``conv``, ``seen``: the keys of a strip that an earlier strip of the same conversation has too."""
    spread = slim.groupBy("conv").agg(F.min("strip").alias("lo"), F.max("strip").alias("hi")).where("lo < hi").select("conv")
    keys = slim.join(spread, "conv", "left_semi").select("conv", "key", "strip").distinct()
    first = keys.groupBy("conv", "key").agg(F.min("strip").alias("first"))
    late = keys.join(first, ["conv", "key"]).where("strip > first")
    return late.groupBy(F.col("strip").alias("strip"), F.col("conv").alias("conv")).agg(F.collect_list("key").alias("seen"))


def _pieces(slim: DataFrame, seen: DataFrame, conv: str) -> DataFrame:
    """One row for each conversation in each strip: its counts, its edges and its matrix of costs."""
    schema = (f"strip bigint, conv {conv}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, "
              "low bigint, high bigint, turns bigint, matrix array<bigint>, seen array<string>")

    def summed(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("place")
        convs, turns, initials, blank, cut, keys = (left.column(c).to_pylist() for c in ("conv", "turn", "initial", "blank", "cut", "key"))
        known = {r["conv"]["conv_id"]: r["seen"] for r in right.to_pylist()}
        out = []
        for a, b in runs_of(convs):
            before = known.get(convs[a]["conv_id"], [])
            found = faults_of(initials[a:b], blank[a:b], cut[a:b], keys[a:b], set(before))
            pairs = [x + y for x, y in zip(initials[a:b], initials[a + 1:b])]
            real = [t for t in turns[a:b] if t is not None]
            out.append({"strip": left.column("strip")[0].as_py(), "conv": convs[a], "blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated"),
                        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "first_initial": initials[a], "last_initial": initials[b - 1], "low": min(real, default=None),
                        "high": max(real, default=None), "turns": len(set(real)), "matrix": matrix_of(as_rows(initials[a:b], found)), "seen": before})
        types = {"strip": pa.int64(), "conv": left.schema.field("conv").type, "first_initial": pa.string(), "last_initial": pa.string(), "matrix": pa.list_(pa.int64()), "seen": pa.list_(pa.string())}
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.table({n: pa.array([r[n] for r in out], types.get(n, pa.int64())) for n in names})

    return slim.groupBy("strip").cogroup(seen.groupBy("strip")).applyInArrow(summed, schema)


def _composed(pieces: DataFrame, conv: str) -> DataFrame:
    """For each piece the least costs after it, by state; the counts of a whole conversation at its first piece.

    A conversation's pieces, one for some thousand rows, are gone through from its end.
    """
    schema = f"strip bigint, conv {conv}, ends array<bigint>, seen array<string>, is_first boolean, " + ", ".join(f"{c} bigint" for c in COUNTS)

    def closed(run: list[dict]) -> Iterator[dict]:
        ends, after = [], list(ENDINGS)
        for piece in reversed(run):
            ends.append(after)
            m = piece["matrix"]
            after = [min(min(m[4 * s + e] + after[e] for e in range(4)), INF) for s in range(4)]
        total = {c: sum(p[c] for p in run) for c in ("blank", "duplicate", "truncated", "illegal")}
        total["illegal"] += sum(x["last_initial"] + y["first_initial"] not in ("su", "ua", "au") for x, y in zip(run, run[1:]))
        timed = [p for p in run if p["low"] is not None]
        distinct = sum(p["turns"] for p in timed) - sum(x["high"] == y["low"] for x, y in zip(timed, timed[1:]))
        total["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - distinct if timed else 0
        total["cost"] = after[BEGIN]
        for k, (piece, end) in enumerate(zip(run, reversed(ends))):
            yield {"strip": piece["strip"], "conv": piece["conv"], "ends": end, "seen": piece["seen"], "is_first": k == 0} | (total if k == 0 else dict.fromkeys(COUNTS))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[dict] = []
        out_schema = None

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, out_schema)

        for batch in batches:
            if out_schema is None:
                fields = [("strip", pa.int64()), ("conv", batch.schema.field("conv").type), ("ends", pa.list_(pa.int64())), ("seen", pa.list_(pa.string())), ("is_first", pa.bool_())]
                out_schema = pa.schema(fields + [(c, pa.int64()) for c in COUNTS])
            rows = []
            for piece in batch.to_pylist():
                if run and run[-1]["conv"] != piece["conv"]:
                    rows += closed(run)
                    run = []
                run.append(piece)
            if rows:
                yield batch_of(rows)
        if run:
            yield batch_of(list(closed(run)))

    return pieces.repartition("conv").sortWithinPartitions("conv", "strip").mapInArrow(follow, schema)


def _audits(slim: DataFrame, plan: DataFrame, conv: str) -> DataFrame:
    """``conv``, ``place`` of the first row, ``audits`` and ``exits``: for each state that a piece may be entered in."""
    schema = f"conv {conv}, place bigint, audits array<string>, exits array<int>"

    def audited(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("place")
        convs, places, initials, blank, cut, keys = (left.column(c).to_pylist() for c in ("conv", "place", "initial", "blank", "cut", "key"))
        known = {r["conv"]["conv_id"]: r for r in right.to_pylist()}
        nodes, labels, targets, starts, spans = [], [], [], [], []
        base = 0
        for a, b in runs_of(convs):  # the pieces of a strip are ranked together
            piece = known[convs[a]["conv_id"]]
            rows = as_rows(initials[a:b], faults_of(initials[a:b], blank[a:b], cut[a:b], keys[a:b], set(piece["seen"])))
            node, label, to = optimal_arcs(rows, costs_back(rows, piece["ends"]))
            nodes.append(node + base)
            labels.append(label)
            targets.append(to + base)
            states = 1 if piece["is_first"] else 4
            spans.append((a, base, len(starts), states))
            starts += [base + s for s in range(states)]
            base += 4 * (b - a + 1)
        ways = least_audits(np.concatenate(nodes), np.concatenate(labels), np.concatenate(targets), base, starts)
        out = []
        for a, base, at, states in spans:
            audits = ["".join([LABELS[x - 1] for x, _ in way]) for way in ways[at:at + states]]
            exits = [int(way[-1][1] - base) % 4 if way else 0 for way in ways[at:at + states]]
            out.append((convs[a], places[a], audits, exits))
        types = (left.schema.field("conv").type, pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
        return pa.table({n: pa.array([r[k] for r in out], kind) for k, (n, kind) in enumerate(zip(("conv", "place", "audits", "exits"), types))})

    return slim.groupBy("strip").cogroup(plan.groupBy("strip")).applyInArrow(audited, schema)


def _told(stream: DataFrame, conv_type: str) -> DataFrame:
    """Each conversation's counts, audit and repaired digest, from its counts, audits and rows in order."""
    schema = f"conv_id {conv_type}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = digest = kind = None
        state, any_turn = BEGIN, False
        audit: list[str] = []
        waiting = iter("")

        def write(role: str, text: str) -> None:
            nonlocal any_turn
            digest.update(("\n" * any_turn + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            any_turn = True

        def insert() -> None:
            nonlocal state
            state = ADDED[state]
            write(ROLES[state], "")

        def close() -> list:
            if state in (SYSTEM, USER):
                for _ in range(ENDINGS[state] // INSERT):
                    audit.append("I")
                    insert()
            return [[now["conv"]["conv_id"], *[now[c] for c in COUNTS], "".join(audit), digest.hexdigest()]]

        def batch_of(rows: list) -> pa.RecordBatch:
            types = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv").type.field(0).type
            rows = []
            for r in batch.to_pylist():
                if r["step"] == 0:
                    if now is not None:
                        rows += close()
                    now, digest, state, any_turn, audit = r, hashlib.sha256(), BEGIN, False, []
                elif r["step"] == 1:
                    chosen = r["audits"][0 if len(r["audits"]) == 1 else state]
                    audit.append(chosen)
                    waiting = iter(chosen)
                else:
                    edit = next(waiting)
                    while edit == "I":
                        insert()
                        edit = next(waiting)
                    if edit == "K":
                        state = KEPT[state][r["role"][:1]]
                        write(r["role"], r["text"])
                    elif edit == "R":
                        state = ADDED[state]
                        write(ROLES[state], r["text"])
            if rows:
                yield batch_of(rows)
        if now is not None:
            yield batch_of(close())

    return stream.repartition("conv").sortWithinPartitions("conv", "place", "step").mapInArrow(tell, schema)


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, the counts ``gaps blank duplicate truncated illegal cost``, ``audit`` and ``repaired_sha256`` of each conversation.

    ``turns``: conv_id, turn, role, text (null roles and texts count as one space; other columns are not looked at). Rows of
    one turn stand by role and text, null turns first; a null conv_id is a conversation too; repeated rows are duplicates.
    ``conversations``: conv_id of those to be told of even without rows (zeros, an empty audit, the digest of nothing).
    Texts are read whole; an empty table gives no rows.
    """
    said = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = _ordered(said)
    conv = rows.select("conv").dtypes[0][1]
    slim = rows.select("strip", "place", "conv", "turn", "initial", "blank", "cut", "key")
    plan = checkpointed(_composed(_pieces(slim, _seen_before(slim), conv), conv))
    audits = _audits(slim.drop("turn"), plan.select("strip", "conv", "ends", "seen", "is_first"), conv)
    all_of = (conversations if conversations is not None else turns).select(F.struct("conv_id").alias("conv")).distinct()
    totals = all_of.join(plan.where("is_first").select("conv", *COUNTS), "conv", "left").select(
        "conv", F.lit(-1).cast("bigint").alias("place"), F.lit(0).alias("step"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])
    stream = totals.unionByName(audits.select("conv", "place", "audits", F.lit(1).alias("step")), allowMissingColumns=True).unionByName(
        rows.select("conv", "place", "role", "text", F.lit(2).alias("step")), allowMissingColumns=True)
    return _told(stream, dict(turns.dtypes)["conv_id"])
