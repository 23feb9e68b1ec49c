import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pyarrow.parquet as pq
import pytest

from vitalsift.llm import repair
from vitalsift.llm.common import Workspace

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_damage(rows):
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        yield from [row] * (2 if kind == 3 else 1)


def faults(rows):
    seen = set()
    for _, _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        yield "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))


def cheapest(roles, found):
    """Dynamic programming over rows and accepted prefixes of roles, with whole edit strings."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(at, last, inserted):
        ways = []
        if at == len(roles) and last in ("", "a"):
            ways.append((0, ""))
        new = "a" if last == "u" else "u"
        if inserted < 2:
            cost, edits = best(at, new, inserted + 1)
            ways.append((5 + cost, "I" + edits))
        if at < len(roles):
            cost, edits = best(at + 1, last, 0)
            ways.append((2 + cost, "D" + edits))
            if found[at] not in ("blank", "duplicate"):
                extra = 5 if found[at] else 0
                if roles[at][:1] and roles[at][:1] in follow[last]:
                    cost, edits = best(at + 1, roles[at][0], 0)
                    ways.append((extra + cost, "K" + edits))
                cost, edits = best(at + 1, new, 0)
                ways.append((extra + 1 + cost, "R" + edits))
        return min(ways, default=(10**9, ""))

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        return best(0, "", 0)
    finally:
        sys.setrecursionlimit(limit)


def plain_rows(rows):
    """Expected result per conversation of damaged and original rows."""
    damaged = list(plain_damage(rows))
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        found = list(faults(own))
        roles = [r[2] for r in own]
        pairs = [a[:1] + b[:1] for a, b in zip(roles, roles[1:])]
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = cheapest(tuple(roles), tuple(found))
        lines, last, at = [], "", 0
        for edit in audit:
            if edit == "D":
                at += 1
                continue
            role = roles[at] if edit == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{'' if edit == 'I' else own[at][3]}")
            at += edit != "I"
            last = role[0]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = [found.count(k) for k in ("blank", "duplicate", "truncated")]
        yield (conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def run(spark, rows, **options):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, uid string, fault int, digest long")
    segments = repair.repair(Workspace(spark, "repair"), repair.damage(table), **options)
    found = repair.with_all(table, repair.summarise(segments)).select(*COLUMNS).collect()
    return sorted(map(tuple, found), key=lambda r: (r[0] is not None, r[0] or 0))


def check(spark, rows, **options):
    found = run(spark, [(*r, "x", 7, 8) for r in rows], **options)
    assert found == sorted(plain_rows(rows), key=lambda r: (r[0] is not None, r[0] or 0))


def talk(rng, conv, n):
    roles = ["system"] * (rng.random() < 0.3)
    roles += ["user", "assistant"] * n
    say = lambda: rng.choice(["Yes.", "No!", "So?", "and then", "", " \n", f"Word {rng.random()}.", f"cut {rng.random()}"])
    rows = [(conv, t, r if rng.random() < 0.9 else rng.choice(["tool", "user", "assistant", "system", "", None]), say()) for t, r in enumerate(roles[:n])]
    return [r if rng.random() < 0.95 else (conv, None, r[2], None) for r in rows]


def test_search_equals_dynamic_programming():
    rng = random.Random(5)
    for _ in range(3_000):
        n = rng.randint(0, 9)
        initials = [rng.choice(["s", "u", "a", "a", "u", "t", ""]) for _ in range(n)]
        kinds = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        expected = cheapest(tuple(initials), tuple(["", "blank", "duplicate", "truncated"][k] for k in kinds))
        shape = repair.shape_of(initials, kinds)
        assert repair.search(shape, repair.NOTHING, repair.ACCEPTED, {}) == expected


@pytest.mark.parametrize("piece", [1, 2, 5])
def test_pieces_give_the_same_edits(monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    rng = random.Random(6)
    for _ in range(400):
        n = rng.randint(1, 14)
        shape = repair.shape_of([rng.choice("suauat") for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)])
        assert repair.best_edits(shape) == repair.search(shape, repair.NOTHING, repair.ACCEPTED, {})


def test_rows_equal_the_plain_version(spark):
    rng = random.Random(7)
    rows = [r for conv in range(300) for r in talk(rng, conv, rng.randint(1, 9))]
    rows += [(None, t, "user", "no conversation.") for t in range(4)] + [(None, None, None, None)] * 3
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("segment", [1, 7, 1024])
def test_long_conversations_over_many_segments(spark, segment):
    rng = random.Random(8)
    rows = talk(rng, 1, 400) + talk(rng, 2, 150) + [r for c in range(3, 30) for r in talk(rng, c, 4)]
    check(spark, rows, segment_rows=segment)


def test_equal_rows_and_dropped_conversations(spark):
    # conv_id:turn of the second one is dropped whole.
    gone = next(c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "All of it goes.")] + [(5_000, 3, "user", "Same text.")] * 60
    check(spark, rows, segment_rows=16)
    found = run(spark, [(*rows[0], "x", 7, 8)])
    assert found == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_empty_table_and_long_text(spark):
    assert run(spark, []) == []
    check(spark, [(1, 0, "user", "word " * 50_000), (1, 1, "assistant", "x" * 200_000 + ".")])


def test_test_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(path).to_pylist()]
    check(spark, rows)
