"""Repair of conversations: the cheapest edits after which roles alternate and no row is faulty.

A conversation's rows, in the order of their turns, are kept, given another role, deleted, or have
an empty row inserted before them. Roles must then read: nothing, or an optional system row and
after it pairs of a user and an assistant row. The edits are found by iterative-deepening A*: a
depth-first search in the ASCII order of the edits under a cost bound that grows until a path is
accepted. What is left to pay at least, by the rows' own faults, cuts branches off; so does a
table of states that failed, with the budget they failed with, kept while the bound grows. The
first accepted path is therefore the cheapest, and of equal ones the least in ASCII order.

A conversation may be larger than a task should hold. Rows are sorted in ranges of conversation
and turn, so a long one lies in several tasks, and is searched in pieces: once for each state
before and each state after a piece. Every piece's edits end with one for its last row, so none is
the beginning of another, and the best edits of two neighbours are the best of both together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalsift.llm.common import Workspace, small_batches

BLANKS = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"
# Costs of the edits; a truncated row that stays costs more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# Rows searched at once, and rows per stored segment; neither changes a result.
PIECE_ROWS, SEGMENT_ROWS = 64, 1024

# What has been read so far: nothing, a system row, up to a user row, up to an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
ACCEPTED = -1
_NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
# The row that fits next when it is made or changed: its role and the state after it.
_FITS = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]
_LEGAL = {"su", "ua", "au"}
# Faults of a row, in the order in which they count.
SOUND, BLANK, DUPLICATE, CUT = range(4)


def _moves(shape: str, at: int, state: int) -> list[tuple[int, str, int, int]]:
    """Edits in ASCII order as (cost, initial, row after it, state after it)."""
    fits = _FITS[state][1]
    if at == len(shape):
        return [(INSERT, "I", at, fits)]
    initial, fault = "suax"[ord(shape[at]) // 4 - 16], ord(shape[at]) % 4
    found = [(DELETE, "D", at + 1, state), (INSERT, "I", at, fits)]
    if fault in (SOUND, CUT):
        extra = TRUNCATED if fault == CUT else 0
        if (state, initial) in _NEXT:
            found.append((extra, "K", at + 1, _NEXT[state, initial]))
        found.append((REROLE + extra, "R", at + 1, fits))
    return found


def shape_of(initials: list[str], faults: list[int]) -> str:
    """One letter per row, of its role and fault; all that the search looks at."""
    kinds = {"s": 16, "u": 17, "a": 18}
    return "".join(chr(4 * kinds.get(i, 19) + f) for i, f in zip(initials, faults, strict=True))


def least_left(shape: str) -> list[int]:
    """What rows from each on cost at least: a faulty one is deleted or costs more."""
    left = [0] * (len(shape) + 1)
    for at in range(len(shape) - 1, -1, -1):
        left[at] = left[at + 1] + (min(DELETE, TRUNCATED) if ord(shape[at]) % 4 else 0)
    return left


def search(shape: str, start: int, goal: int, failed: dict[tuple[int, int], int]) -> tuple[int, str] | None:
    """Cost and edits of the cheapest way from state to state; None where there is none.

    The goal is a state after the last row's edit, or ``ACCEPTED``, where rows may be inserted at
    the end as well. ``failed`` holds, per row and state, the largest budget that led to no goal;
    calls for one shape and goal share it.
    """
    n, left = len(shape), least_left(shape)
    ends = (NOTHING, ASSISTANT) if goal == ACCEPTED else (goal,)
    moves: dict[tuple[int, int], list] = {}
    # Deleting all rows and inserting a pair is the dearest way that can be needed.
    for bound in range(left[0], n * max(DELETE, TRUNCATED + REROLE) + 2 * INSERT + 1):
        if failed.get((0, start), -1) >= bound:
            continue
        path: list[str] = []
        stack: list[tuple] = []
        place, budget = (0, start), bound
        while True:
            if place[0] == n and place[1] in ends:
                return bound - budget, "".join(path)
            if place not in moves:
                moves[place] = [] if place[0] == n and goal != ACCEPTED else _moves(shape, *place)
            stack.append((place, budget, iter(moves[place])))
            # Go back to the last place that has a branch worth trying.
            while stack:
                place, budget, rest = stack[-1]
                for cost, edit, at, state in rest:
                    if budget - cost >= left[at] and budget - cost > failed.get((at, state), -1):
                        break
                else:
                    failed[place] = max(budget, failed.get(place, -1))
                    stack.pop()
                    if path:
                        path.pop()
                    continue
                path.append(edit)
                place, budget = (at, state), budget - cost
                break
            else:
                break
    return None


@lru_cache(maxsize=50_000)
def cheapest(shape: str) -> tuple[int, str]:
    """Cost and edits of a short conversation."""
    return search(shape, NOTHING, ACCEPTED, {})


@lru_cache(maxsize=5_000)
def table_of(shape: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Cost and edits of a piece for every state before and after it that edits can connect."""
    found = {}
    for goal in STATES:
        failed: dict = {}
        for start in STATES:
            # The first two states cannot be entered again.
            if goal in (NOTHING, SYSTEM) and start not in (NOTHING, goal):
                continue
            best = search(shape, start, goal, failed)
            if best:
                found[start, goal] = best
    return found


def joined(tables: list[dict]) -> dict[tuple[int, int], tuple[int, str]]:
    """The table of neighbouring pieces together."""
    whole = tables[0]
    for table in tables[1:]:
        found: dict = {}
        for (start, middle), (cost, edits) in whole.items():
            for (other, goal), (more, after) in table.items():
                if other == middle:
                    way = (cost + more, edits + after)
                    if (start, goal) not in found or way < found[start, goal]:
                        found[start, goal] = way
        whole = found
    return whole


def end_of(state: int) -> tuple[int, str]:
    """Cost and edits after the last row: the pair that was begun is completed."""
    inserts = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
    return INSERT * inserts, "I" * inserts


def table_for(shape: str) -> dict[tuple[int, int], tuple[int, str]]:
    return joined([table_of(shape[k : k + PIECE_ROWS]) for k in range(0, len(shape), PIECE_ROWS)])


def best_edits(shape: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation of any length."""
    if len(shape) <= PIECE_ROWS:
        return cheapest(shape)
    ways = [(c + end_of(goal)[0], e + end_of(goal)[1]) for (start, goal), (c, e) in table_for(shape).items() if start == NOTHING]
    return min(ways)


def apply(edits: str, start: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    state, row = start, 0
    new_roles, new_texts = [], []
    for edit in edits:
        if edit == "D":
            row += 1
            continue
        if edit == "K":
            role, state = roles[row], _NEXT[state, roles[row][:1]]
        else:
            role, state = _FITS[state]
        new_roles.append(role)
        new_texts.append("" if edit == "I" else texts[row])
        row += edit != "I"
    return new_roles, new_texts


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that the CRC-32 of ``conv_id:turn`` modulo 20 calls for.

    0 drops a row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it the
    user's. Missing ids, turns, roles and texts count as one blank. Other columns are left out.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), SENTENCE_ENDS, "")).otherwise(blank("text"))
    return conversations.filter(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(blank("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


_ORDER = ["conv_id", "turn", "role", "digest", "uid"]


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows with a place in their conversation: turn, role, the text's digest, a row number."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.md5(text).alias("digest"),
        F.monotonically_increasing_id().alias("uid"),
        text.alias("text"),
    )


def _faults(prepared: DataFrame) -> DataFrame:
    """Rows with their first fault.

    Groups of equal rows are reduced to their first row inside the tasks before the shuffle, and
    only groups of two rows or more are joined back; that side is unique, so that adaptive
    execution can split the rows of a frequent text.
    """
    first = F.min(F.struct("turn", "uid")).alias("first")
    repeated = (
        prepared.groupBy("conv_id", "role", "digest").agg(first, F.count("*").alias("n")).filter("n > 1")
        .select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")], F.col("first.uid").alias("_uid"))
    )
    same: Column = (
        prepared["conv_id"].eqNullSafe(F.col("_conv_id")) & (prepared["role"] == F.col("_role"))
        & (prepared["digest"] == F.col("_digest"))
    )
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(shown == "", BLANK)
        .when(F.col("_uid") != F.col("uid"), DUPLICATE)
        .when(~F.right(shown, F.lit(1)).isin(*SENTENCE_ENDS), CUT)
        .otherwise(SOUND)
    )
    return prepared.join(repeated, same, "left").select(*_ORDER, "text", fault.alias("fault"))


def _segment_schema(conv_type: T.DataType) -> T.StructType:
    """Segments of conversations. ``whole`` ones are repaired; others have a table of ways."""
    schema = T.StructType().add("conv_id", conv_type).add("turn", "long").add("role", "string").add("digest", "string")
    schema = schema.add("uid", "long").add("whole", "boolean")
    for name in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "cost"):
        schema = schema.add(name, "long")
    for name in ("begins", "ends", "audit"):
        schema = schema.add(name, "string")
    strings, numbers = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
    return (
        schema.add("roles", strings).add("texts", strings)
        .add("costs", numbers).add("ranks", numbers).add("ways", strings)
    )


def _segment(rows: list[tuple], whole: bool) -> tuple:
    """One stored row of consecutive rows of a conversation, in the order of the schema."""
    conv, turns, roles, digests, uids, texts, faults = zip(*rows, strict=True)
    initials = [r[:1] for r in roles]
    shape = shape_of(initials, faults)
    known = [t for t in turns if t is not None]
    head = (
        conv[0], turns[0], roles[0], digests[0], uids[0], whole,
        faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT),
        sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        len(set(known)), known[0] if known else None, known[-1] if known else None,
    )
    if whole:
        cost, audit = best_edits(shape)
        return (*head, cost, initials[0], initials[-1], audit, *apply(audit, NOTHING, roles, texts), None, None, None)
    table = table_for(shape)
    pairs = [(a, b) for a in STATES for b in STATES]
    # Ways that begin alike are ordered by their edits.
    order = {a: sorted(table[a, b][1] for b in STATES if (a, b) in table) for a in STATES}
    costs = [table[p][0] if p in table else -1 for p in pairs]
    ranks = [order[p[0]].index(table[p][1]) if p in table else -1 for p in pairs]
    ways = [table[p][1] if p in table else None for p in pairs]
    return (*head, None, initials[0], initials[-1], None, list(roles), list(texts), costs, ranks, ways)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _segments(ordered: DataFrame, segment_rows: int) -> DataFrame:
    """Segments of sorted ranges. The first and last conversation of a range may go on in another."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _segment_schema(ordered.schema["conv_id"].dataType)
    arrow = to_arrow_schema(schema)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple] = []
        first, out = True, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run and run[0][0] != row[0]:
                    out.append(_segment(run, not first))
                    run, first = [], False
                elif len(run) == segment_rows:
                    # Too long for one segment, so all its segments are open.
                    out.append(_segment(run, False))
                    run, first = [], True
                run.append(row)
            if out:
                yield _batch(out, arrow)
                out = []
        if run:
            yield _batch([_segment(run, False)], arrow)

    return ordered.mapInArrow(parted, schema)


def _chosen_states(group: pd.DataFrame) -> pd.DataFrame:
    """The states before and after each open segment of one conversation, from the last to the first."""
    group = group.sort_values(["turn", "role", "digest", "uid"], na_position="first")
    costs, ranks = group["costs"].tolist(), group["ranks"].tolist()
    left = {s: end_of(s)[0] for s in STATES}
    choice = []
    for cost, rank in zip(reversed(costs), reversed(ranks), strict=True):
        best = {}
        for a in STATES:
            ways = [(cost[4 * a + b] + left[b], rank[4 * a + b], b) for b in left if cost[4 * a + b] >= 0]
            if ways:
                best[a] = min(ways)
        choice.append({a: way[2] for a, way in best.items()})
        left = {a: way[0] for a, way in best.items()}
    before, after, state = [], [], NOTHING
    for goals in reversed(choice):
        before.append(state)
        state = goals[state]
        after.append(state)
    last = [False] * (len(after) - 1) + [True]
    return pd.DataFrame({"_uid": group["uid"].to_numpy(), "_before": before, "_after": after, "_last": last})


def _closed(segments: DataFrame, schema: T.StructType) -> DataFrame:
    """Open segments with the edits that the choice of states asks for."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    names = schema.names

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pair = 4 * row["_before"] + row["_after"]
                more, inserts = end_of(row["_after"]) if row["_last"] else (0, "")
                row["cost"], row["audit"] = row["costs"][pair] + more, row["ways"][pair] + inserts
                row["roles"], row["texts"] = apply(row["audit"], row["_before"], row["roles"], row["texts"])
                row["costs"] = row["ranks"] = row["ways"] = None
                out.append(tuple(row[c] for c in names))
            if out:
                yield _batch(out, arrow)

    return segments.mapInArrow(closed, schema)


def repair(work: Workspace, rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Repaired conversations, as segments of at most ``segment_rows`` rows and their edits.

    A segment has ``conv_id``, the place of its first row (``turn``, ``role``, ``digest``, ``uid``),
    counts of faults, ``cost`` and ``audit`` (one initial per edit), and the repaired ``roles``
    and ``texts``. Conversations marked ``whole`` are one segment; others have all theirs in the
    order of the place. Rows without a conv_id are one conversation. Missing turns come first, rows of
    one turn follow each other by role, then by the MD5 of their text; missing roles and texts
    count as one blank. Repeated rows are duplicates. Other columns are ignored; an empty
    table gives no rows.
    """
    small_batches(work.spark)
    prepared = work.store("rows", _prepared(rows))
    ordered = _faults(prepared).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select(*_ORDER, "text", "fault")
    segments = work.store("segments", _segments(ordered, segment_rows))
    open_ = segments.filter("NOT whole")
    # One narrow row per segment, that is, one in about a thousand rows of a long conversation.
    states = (
        open_.select(*_ORDER, "costs", "ranks").groupBy("conv_id")
        .applyInPandas(_chosen_states, "_uid long, _before int, _after int, _last boolean")
    )
    decided = open_.join(states, F.col("uid") == F.col("_uid")).drop("_uid")
    return segments.filter("whole").unionByName(_closed(decided, segments.schema)).drop("costs", "ranks", "ways")


def summarise(segments: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost, edits and the digest of its repaired rows.

    A whole conversation is finished where it lies. Segments of the others meet in one
    task per conversation and pass through it one by one, as the digest and the edits of a
    conversation are single values; nothing but the edits is held.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType().add("conv_id", segments.schema["conv_id"].dataType)
    for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")
    arrow = to_arrow_schema(schema)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now:
                        out.append(now.result())
                    now = _Summary(row["conv_id"])
                now.add(row)
            if out:
                yield _batch(out, arrow)
        if now:
            yield _batch([now.result()], arrow)

    parts = segments.filter("NOT whole").repartition("conv_id").sortWithinPartitions(*_ORDER)
    return segments.filter("whole").mapInArrow(finished, schema).union(parts.mapInArrow(finished, schema))


class _Summary:
    """Sums over the segments of one conversation, in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.audit: list[str] = []
        self.ends = self.low = self.high = None
        self.turns = self.lines = 0
        self.digest = hashlib.sha256()

    def add(self, row: dict) -> None:
        for name in self.counts:
            self.counts[name] += row[name]
        if self.ends is not None and self.ends + row["begins"] not in _LEGAL:
            self.counts["illegal"] += 1
        self.ends = row["ends"]
        if row["low"] is not None:
            self.turns += row["turns"] - (row["low"] == self.high)
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        self.audit.append(row["audit"])
        for role, text in zip(row["roles"], row["texts"], strict=True):
            self.digest.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
            self.lines += 1

    def result(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        counts = [self.counts[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        return (self.conv_id, gaps, *counts, "".join(self.audit), self.digest.hexdigest())


def with_all(conversations: DataFrame, summary: DataFrame) -> DataFrame:
    """The summary with a row for every conversation, those of which no row is left too."""
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    found = ids.join(summary, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    return found.select(
        F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )
