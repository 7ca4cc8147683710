"""Cheapest repair of conversations whose turns are damaged, with the least list of edits.

A repaired conversation is empty or goes user, assistant, user, assistant and so on, after a system
turn or without one. Rows are kept, given another role, deleted, or turns without text are inserted.

The costs are those of a shortest path. A node is a place between rows and the last role so far, the
costs to the end come from the last row backwards, and an arc that lies on a cheapest path is optimal.
Every optimal-arc node is ranked by the first letter of its least list of edits, then by the first two,
four and so on: the rank over twice the length comes from the ranks of a node and of the node its
doubled pointer leads to. The ranks choose the arc at each node, and the doubled pointers spell the path.

Rows are dealt out by ranges of conversation, turn, role and text and cut into blocks of bounded size,
so a conversation of any length is spread over tasks. Nearly all conversations lie within one block and are
repaired where they are. Of the others each block gives its costs between the roles before and after
it; these tables are chained per conversation, and then every block is repaired between the right roles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weektide.llm.common import ASCII_SPACE, written

# Rows and characters of a block; one row may be longer.
BLOCK_ROWS, BLOCK_CHARS = 4096, 2_000_000
# Blocks that are repaired together hold about so many rows.
TOGETHER = 20_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 10**9
# States: nothing yet, system, user, assistant. The turn that each may add, and the state after it.
START, SYSTEM, USER, ASSISTANT = range(4)
ADDED = ["user", "user", "assistant", "user"]
AFTER_ADDED = [USER, USER, ASSISTANT, USER]
AFTER_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# Cost to the end when no rows are left: user needs an answer, system a user and an answer.
AT_END = (0, 2 * INSERT, INSERT, 0)
LETTERS = "DIKR"
STEP = np.array([1, 0, 1, 1])  # rows that each edit takes
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
# Kinds of rows: one that must go, then initial and whether the text is cut off.
MUST_GO, INITIALS = 0, "sua?"


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults planted by a hash of conversation and turn.

    A missing value counts as one space. Of twenty hashes one drops the row, and one each empties its
    text, removes ``.!?`` from it, repeats the row beside itself, or makes its role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hashed = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    read = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), hashed.alias("fault"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return read.where("fault != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def blocks(rows: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """``(conv_id, block, whole, turns, roles, texts)``: rows in order, by turn with missing turns first, then role and text.

    Numbers of blocks rise in that order. ``whole`` blocks are known to hold all rows of their conversation.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    read = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role"), blank("text"))
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, 32), F.col("text")]
    ranged = read.repartitionByRange(*order[:4]).sortWithinPartitions(*order)
    lists = "block bigint, whole boolean, turns array<bigint>, roles array<string>, texts array<string>"
    schema = T.StructType([read.schema["conv_id"], *T.StructType.fromDDL(lists).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_block = TaskContext.get().partitionId() << 32
        done: list[tuple] = []
        held: list[tuple] = []
        conv, n_conv, n_blocks, size, total = None, 0, 0, 0, 0

        def close(ended: bool) -> None:
            nonlocal held, size, total, n_blocks
            whole = ended and n_conv > 1 and n_blocks == 0
            done.append((conv, first_block + closed[0], whole, [r[0] for r in held], [r[1] for r in held], [r[2] for r in held]))
            closed[0] += 1
            n_blocks += 1
            total += size
            held, size = [], 0

        def out(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * 6
            kinds = [kind, pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        closed, kind = [0], None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")]):
                if n_conv == 0 or row[0] != conv:
                    if held:
                        close(True)
                    conv, n_conv, n_blocks = row[0], n_conv + 1, 0
                elif len(held) >= block_rows or size + len(row[3]) > block_chars:
                    close(False)
                held.append(row[1:])
                size += len(row[3])
                if total > block_chars or len(done) > TOGETHER:
                    yield out(kind)
                    done, total = [], 0
        if held:
            close(False)
        if done:
            yield out(kind)

    return ranged.mapInArrow(run, schema)


def row_key(role: str, text: str) -> str:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def key_column(row: Column) -> Column:
    role, text = row.getField("role"), row.getField("text")
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


class Block:
    """Rows with the kind of each, and the faults among them."""

    def __init__(self, turns: list[int | None], roles: list[str], texts: list[str], seen_before: list[str] | None):
        self.turns, self.roles, self.texts = turns, roles, texts
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.kinds: list[int] = []
        self.cut: list[bool] = []
        earlier, seen = set(seen_before or ()), set()
        for role, text in zip(roles, texts):
            rest = text.rstrip(ASCII_SPACE)
            fault = None
            if not rest:
                fault = "blank"
            elif (role, text) in seen or (earlier and row_key(role, text) in earlier):
                fault = "duplicate"
            elif rest[-1] not in ".!?":
                fault = "truncated"
            if rest:
                seen.add((role, text))
            if fault:
                self.faults[fault] += 1
            cut = fault == "truncated"
            self.cut.append(cut)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
            self.kinds.append(MUST_GO if fault in ("blank", "duplicate") else 1 + 2 * INITIALS.index(initial) + cut)


class Costs:
    """Costs to the end before a row, from those after it.

    Only the differences between the four states matter, and few different ones occur, so each pair of
    differences and kind of row is worked out once.
    """

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.steps: dict[int, tuple[int, int, int]] = {}
        self.optimal: list[list[list[bool]]] = []
        self.targets: list[list[list[int]]] = []

    def vector(self, values: tuple) -> tuple[int, int]:
        least = min(values)
        rest = tuple(v - least if v < NEVER else NEVER for v in values)
        if rest not in self.number:
            self.number[rest] = len(self.vectors)
            self.vectors.append(rest)
        return self.number[rest], least

    def before(self, after: int, kind: int) -> tuple[int, int, int]:
        """Number of the arcs, of the differences before the row, and what was taken off them."""
        key = after * 9 + kind
        found = self.steps.get(key)
        if found is None:
            found = self.steps[key] = self.work_out(self.vectors[after], kind)
        return found

    def work_out(self, after: tuple, kind: int) -> tuple[int, int, int]:
        cost, target = [], []
        for q in range(4):
            cost.append([DELETE + after[q], NEVER, NEVER, NEVER])
            target.append([q, AFTER_ADDED[q], q, AFTER_ADDED[q]])
            if kind != MUST_GO:
                initial, cut = INITIALS[(kind - 1) // 2], (kind - 1) % 2 * TRUNCATED
                kept = AFTER_KEPT.get((q, initial))
                if kept is not None:
                    cost[q][2], target[q][2] = KEEP + cut + after[kept], kept
                cost[q][3] = REROLE + cut + after[AFTER_ADDED[q]]
        now = [min(c) for c in cost]
        for _ in range(3):  # an insertion may follow another
            now = [min(now[q], INSERT + now[AFTER_ADDED[q]]) for q in range(4)]
        for q in range(4):
            cost[q][1] = INSERT + now[AFTER_ADDED[q]]
        now = [min(v, NEVER) for v in now]
        self.optimal.append([[now[q] < NEVER and c == now[q] for c in cost[q]] for q in range(4)])
        self.targets.append(target)
        number, taken = self.vector(tuple(now))
        return len(self.optimal) - 1, number, taken

    def arcs(self, kinds: list[int], at_end: tuple) -> tuple[list[int], list[int]]:
        """Numbers of the arcs of each row, and the costs before the first, given those after the last."""
        at, total = self.vector(at_end)
        out = []
        for kind in reversed(kinds):
            arc, at, taken = self.before(at, kind)
            out.append(arc)
            total += taken
        return out[::-1], [v + total if v < NEVER else NEVER for v in self.vectors[at]]


def ranked_paths(costs: Costs, arcs: list[list[int]], last: list[bool]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Doubled pointers of all nodes, the letter of each node's least optimal arc (-1 at the end), and where each block begins.

    Node ``first + 4 i + state`` of a block is the place before its row i.
    """
    rows = np.array([len(a) for a in arcs], np.int64)
    layers = rows + 1
    first = 4 * (np.cumsum(layers) - layers)
    n = int(4 * layers.sum())
    optimal, target = np.zeros((n // 4, 4, 4), bool), np.zeros((n // 4, 4, 4), np.int64)
    inner = np.ones(n // 4, bool)
    ends = first // 4 + rows
    inner[ends] = False
    flat = np.array([x for a in arcs for x in a], np.int64)
    optimal[inner], target[inner] = np.array(costs.optimal, bool)[flat], np.array(costs.targets, np.int64)[flat]
    at_end = ends[np.array(last, bool)]
    for state in (SYSTEM, USER):
        optimal[at_end, state, 1], target[at_end, state, 1] = True, AFTER_ADDED[state]
    node = 4 * (np.arange(n // 4)[:, None, None] + STEP) + target
    optimal, node = optimal.reshape(n, 4), node.reshape(n, 4)
    here = np.arange(n)
    some = optimal.any(axis=1)
    letter = np.where(some, optimal.argmax(axis=1), -1)
    # Ranks by the first letter, then by twice as many in each round; an ended list comes before all others.
    rank, pointer, length = letter + 1, np.where(some, node[here, letter], here), 1
    while True:
        onward = pointer[pointer]
        if (onward == pointer).all():
            break
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)
        pointer, length = onward, 2 * length
    # The least arc of a node: the smallest letter, and of equal ones that which leads to the smaller rank.
    order = np.where(optimal, np.arange(4) * (int(rank.max()) + 1) + rank[np.minimum(node, n - 1)], np.iinfo(np.int64).max)
    chosen = order.argmin(axis=1)
    letter = np.where(some, chosen, -1)
    doubled = [np.where(some, node[here, chosen], here)]
    while (doubled[-1][doubled[-1]] != doubled[-1]).any():
        doubled.append(doubled[-1][doubled[-1]])
    return doubled, letter, first


def spelled(doubled: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Nodes of the paths from ``starts``, a row for each, padded with the node at the end."""
    path = starts[:, None]
    for pointer in reversed(doubled):
        path = np.stack([path, pointer[path]], axis=2).reshape(len(starts), -1)
    return path


def groups_of(sizes: list[int]) -> Iterator[list[int]]:
    """Positions of blocks of like size, about ``TOGETHER`` rows in a group."""
    run, rows = [], 0
    for at in sorted(range(len(sizes)), key=sizes.__getitem__):
        if run and (rows + sizes[at] > TOGETHER or sizes[at] > 2 * sizes[run[0]]):
            yield run
            run, rows = [], 0
        run.append(at)
        rows += sizes[at]
    if run:
        yield run


PIECE = (
    "audit string, repaired array<struct<role: string, text: string>>, cost bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, first_initial string, last_initial string, first_turn bigint, last_turn bigint, n_turns bigint"
)


def repaired_piece(block: Block, letters: list[int], nodes: list[int]) -> tuple:
    """The columns of ``PIECE`` of a block from the edits and the nodes they start at, counted from the block's first."""
    cost, out, at = 0, [], 0
    for letter, node in zip(letters, nodes):
        state = node % 4
        if letter == 1:
            cost += INSERT
            out.append({"role": ADDED[state], "text": ""})
            continue
        if letter == 0:
            cost += DELETE
        else:
            cost += (REROLE if letter == 3 else KEEP) + block.cut[at] * TRUNCATED
            out.append({"role": ADDED[state] if letter == 3 else block.roles[at], "text": block.texts[at]})
        at += 1
    initials = [r[:1] for r in block.roles]
    illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
    turns = [t for t in block.turns if t is not None]
    audit = "".join(LETTERS[x] for x in letters)
    faults = block.faults.values()
    ends = (turns[0], turns[-1]) if turns else (None, None)
    return (audit, out, cost, *faults, illegal, initials[0], initials[-1], *ends, len(set(turns)))


def repaired_pieces(found: list[Block], at_ends: list[tuple], last: list[bool], entries: list[int]) -> list[tuple]:
    """``PIECE`` of each block, entered in the state ``entries`` and left with the costs ``at_ends``."""
    costs, out = Costs(), [None] * len(found)
    for run in groups_of([len(b.kinds) for b in found]):
        arcs = [costs.arcs(found[i].kinds, at_ends[i])[0] for i in run]
        doubled, letter, first = ranked_paths(costs, arcs, [last[i] for i in run])
        path = spelled(doubled, first + np.array([entries[i] for i in run]))
        for i, nodes, base in zip(run, path, first.tolist()):
            letters = letter[nodes]
            n = int((letters >= 0).sum())
            out[i] = repaired_piece(found[i], letters[:n].tolist(), (nodes[:n] - base).tolist())
    return out


def exits(found: list[Block], at_ends: list[tuple], last: list[bool]) -> list[list[int]]:
    """State after each block of the least path from each of the four states before it."""
    costs, out = Costs(), [None] * len(found)
    for run in groups_of([len(b.kinds) for b in found]):
        arcs = [costs.arcs(found[i].kinds, at_ends[i])[0] for i in run]
        doubled, _, first = ranked_paths(costs, arcs, [last[i] for i in run])
        end = first[:, None] + np.arange(4)
        for pointer in doubled:
            end = pointer[end]
        for i, states in zip(run, end % 4):
            out[i] = states.tolist()
    return out


def cost_table(block: Block, costs: Costs) -> list[int]:
    """Costs from each state before the block (slow index) to each state after it."""
    columns = [costs.arcs(block.kinds, tuple(0 if e == q else NEVER for q in range(4)))[1] for e in range(4)]
    return [columns[e][q] for q in range(4) for e in range(4)]


def read_blocks(batch: pa.RecordBatch) -> list[Block]:
    """Blocks of a batch; ``seen`` are the keys of rows that an earlier block of the conversation holds."""
    columns = [batch.column(c).to_pylist() for c in ("turns", "roles", "texts")]
    seen = batch.column("seen").to_pylist() if "seen" in batch.schema.names else [None] * batch.num_rows
    return [Block(*rows) for rows in zip(*columns, seen)]


def some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in runs of blocks with about ``TOGETHER`` rows or ``BLOCK_CHARS`` characters."""
    for batch in batches:
        sizes = batch.column("turns").value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        chars = np.r_[0, np.cumsum(pc.utf8_length(batch.column("texts").flatten()).to_numpy(zero_copy_only=False))]
        run = np.maximum(ends // TOGETHER, chars[ends] // BLOCK_CHARS)
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.empty(0, np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(run)]):
            yield batch.slice(a, b - a)


def with_python(df: DataFrame, keep: list[str], added: str, work) -> DataFrame:
    """``keep`` and the columns that ``work`` makes of each run of blocks, as rows of Python values."""
    new = T.StructType.fromDDL(added)
    schema = T.StructType([*[df.schema[c] for c in keep], *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new.fields]
        for batch in some_rows(batches):
            values = list(zip(*work(batch)))
            arrays = [pa.array(v, k) for v, k in zip(values, kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *arrays], names=schema.names)

    return df.mapInArrow(run, schema)


def chained(tables: DataFrame, added: str, follow) -> DataFrame:
    """``(block, ...)`` from the blocks of one conversation at a time, in order.

    A list of edits is one string, so a conversation has under 2**31 rows and, at 4096 rows a block, at
    most some hundred thousand small rows here.
    """
    schema = T.StructType.fromDDL("block bigint, " + added)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        rows = follow(group.to_pylist())
        return pa.table({"block": group.column("block")} | {f.name: [r[i] for r in rows] for i, f in enumerate(schema.fields[1:])})

    return tables.groupBy("conv_id").applyInArrow(run, schema)


def costs_after(rows: list[dict]) -> list[tuple]:
    """Costs after each block and whether it is the last, from the tables of all."""
    out, after, final = [], list(AT_END), True
    for row in reversed(rows):
        out.append((list(after), final))
        table = np.array(row["table"], np.int64).reshape(4, 4)
        after, final = np.minimum((table + np.array(after)).min(axis=1), NEVER).tolist(), False
    return out[::-1]


def entry_states(rows: list[dict]) -> list[tuple]:
    out, state = [], START
    for row in rows:
        out.append((state,))
        state = row["exits"][state]
    return out


def seen_before(parts: DataFrame) -> DataFrame:
    """``(block, seen)``: keys of rows that an earlier block of the conversation holds."""
    rows = parts.select("conv_id", "block", F.explode(F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))).alias("row"))
    keys = rows.select("conv_id", "block", key_column(F.col("row")).alias("key")).distinct()
    counts = keys.groupBy("conv_id", "key").agg(F.min("block").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = counts.select(F.col("conv_id").alias("of"), F.col("key").alias("same"), "first")
    later = keys.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("same"))).where("block > first")
    return later.groupBy("block").agg(F.collect_list("key").alias("seen"))


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(conv_id, block, whole)`` and the columns of ``PIECE``: the repair of ``(conv_id, turn, role, text)``, block by block.

    Rows of a conversation are taken by turn, missing turns first, ties by role and text. A missing role or
    text is one space; missing ids are one conversation. The first fault of a row counts: ``blank`` without a
    character other than ASCII white space, ``duplicate`` if role and text are those of an earlier row,
    ``truncated`` if it does not end with ``.``, ``!`` or ``?``. Roles other than those with initials s, u, a have to be changed or
    go. ``audit`` has the first letters of the cheapest edits, of equally cheap ones the least list.
    ``repaired`` are the rows that result. Blocks change nothing in the result; all pieces of a conversation
    in order of ``block`` are its repair, and one piece is all if it is ``whole``. Other columns play no part.
    """
    cut = written(blocks(rows, block_rows, block_chars), "blocks")

    def alone(batch: pa.RecordBatch) -> list[tuple]:
        found = read_blocks(batch)
        return repaired_pieces(found, [AT_END] * len(found), [True] * len(found), [START] * len(found))

    whole = with_python(cut.where("whole"), ["conv_id", "block", "whole"], PIECE, alone)
    parts = cut.where("NOT whole")
    parts = written(parts.join(seen_before(parts), "block", "left"), "open-blocks")

    def tables(batch: pa.RecordBatch) -> list[tuple]:
        costs = Costs()
        return [(cost_table(b, costs),) for b in read_blocks(batch)]

    after = chained(with_python(parts, ["conv_id", "block"], "table array<bigint>", tables), "after array<bigint>, last boolean", costs_after)
    parts = written(parts.join(written(after, "costs-after"), "block"), "open-blocks-after")
    at_ends = lambda batch: ([tuple(v) for v in batch.column("after").to_pylist()], batch.column("last").to_pylist())

    def leave(batch: pa.RecordBatch) -> list[tuple]:
        return [(states,) for states in exits(read_blocks(batch), *at_ends(batch))]

    entries = chained(with_python(parts, ["conv_id", "block"], "exits array<bigint>", leave), "entry bigint", entry_states)
    parts = parts.join(written(entries, "entries"), "block")

    def between(batch: pa.RecordBatch) -> list[tuple]:
        return repaired_pieces(read_blocks(batch), *at_ends(batch), batch.column("entry").to_pylist())

    return whole.unionByName(with_python(parts, ["conv_id", "block", "whole"], PIECE, between))


SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def summed(pieces: list[dict]) -> tuple:
    """The columns of ``SUMMARY`` from the pieces of one conversation."""
    total = {n: sum(p[n] for p in pieces) for n in ("blank", "duplicate", "truncated", "illegal", "cost", "n_turns")}
    total["illegal"] += sum((a["last_initial"], b["first_initial"]) not in LEGAL for a, b in zip(pieces, pieces[1:]))
    turned = [p for p in pieces if p["n_turns"]]
    same = sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:]))
    gaps = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - (total["n_turns"] - same) if turned else 0
    gaps = gaps if gaps < 2**63 else None
    faults = (total[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost"))
    return (gaps, *faults, "".join(p["audit"] for p in pieces))


def piece_text() -> Column:
    return F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")


def hashed(pieces: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the whole text of each conversation, its pieces fed one after the other."""
    schema = T.StructType([pieces.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    some = pieces.where(F.size("repaired") > 0).select("conv_id", "block", piece_text().alias("text"))
    dealt = some.repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, kind, out = None, None, None, []
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for key, text in zip(batch.column("conv_id").to_pylist(), batch.column("text")):
                if now is None or key != conv:
                    if now is not None:
                        out.append((conv, now.hexdigest()))
                    now, conv = hashlib.sha256(), key
                else:
                    now.update(b"\n")
                now.update(text.as_py().encode())
        if now is not None:
            out.append((conv, now.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([h for _, h in out])], names=schema.names)

    return dealt.mapInArrow(run, schema)


def summaries(pieces: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``: its id, the columns of ``SUMMARY`` and the hash of its repaired rows."""
    pieces = written(pieces, "repaired")
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    spread = F.when(F.col("n_turns") > 0, F.try_subtract("last_turn", "first_turn")).otherwise(F.lit(0))
    gaps = F.when(F.col("n_turns") > 0, spread + 1 - F.col("n_turns")).otherwise(0)
    one = pieces.where("whole").withColumn("gaps", gaps).select("conv_id", *columns, F.sha2(piece_text(), 256).alias("repaired_sha256"))
    parts = pieces.where("NOT whole")
    small = parts.drop("repaired", "whole")
    schema = T.StructType([pieces.schema["conv_id"], *T.StructType.fromDDL(SUMMARY).fields])

    def add_up(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        row = summed(group.drop_columns(["conv_id"]).to_pylist())
        kinds = [pa.int64()] * 6 + [pa.string()]
        return pa.table([group.column("conv_id").slice(0, 1), *[pa.array([v], k) for v, k in zip(row, kinds)]], names=schema.names)

    sums, hashes = small.groupBy("conv_id").applyInArrow(add_up, schema), hashed(parts).withColumnRenamed("conv_id", "of")
    joined = sums.join(hashes, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    rest = joined.select("conv_id", *columns, F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
    return one.unionByName(rest)


def report(conversations: DataFrame, rows: DataFrame, **bounds: int) -> DataFrame:
    """A row of ``summaries`` for every ``conv_id`` of ``conversations``, repaired from ``rows``.

    A conversation without rows has zeros, an empty ``audit`` and the hash of nothing.
    """
    found = summaries(repair(rows, **bounds)).withColumnRenamed("conv_id", "of")
    joined = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    there = F.col("audit").isNotNull()
    numbers = [F.when(there, F.col(n)).otherwise(0).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
