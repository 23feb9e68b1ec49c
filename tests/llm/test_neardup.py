import random
from collections import Counter

import numpy as np

from brute import near_duplicates
from tests_llm_support import EDGE_SCHEMA, edge_rows
from vitalsift.llm import neardup
from vitalsift.llm.common import Workspace, components
from vitalsift.llm.shingles import SetSketch, ShingleHasher, estimate

SCHEMA = "doc_id long, text string"


def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(4_000)]
    texts = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(3, 200))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(base if rng.random() < 0.2 else copy))
    # A large group whose members are near the threshold to one another.
    base = [rng.choice(words) for _ in range(150)]
    for _ in range(250):
        copy = list(base)
        for _ in range(rng.randint(3, 9)):
            copy[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += ["", None, "  ", "one", "One", "one two", "A b C d E", "a b c d e", "a  b\tc\nd\x0be", "a b c d é"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def found_in(spark, rows, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema).repartition(6)
    return neardup.find_near_duplicates(Workspace(spark, "neardup"), docs).collect()


def test_components_equal_all_pairs(spark):
    rows = corpus()
    out = found_in(spark, rows)
    expected = near_duplicates(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_blocks_find_what_centres_leave(spark, monkeypatch):
    """Tiny blocks and groups give the same components."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "GROUP_BYTES", 1_000)
    rows = corpus()[::2]
    assert {r["doc_id"]: r["component_id"] for r in found_in(spark, rows)} == {k: v[1] for k, v in near_duplicates(rows).items()}


def test_chains_that_no_centre_sees(spark):
    """Each text is near its neighbours only; the smallest id is at one end."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(40)]
    expected = near_duplicates(rows)
    assert {v[1] for v in expected.values()} == {0}
    assert {r["doc_id"]: r["component_id"] for r in found_in(spark, rows)} == {k: 0 for k in range(40)}


def test_edge_rows(spark):
    out = found_in(spark, edge_rows(), EDGE_SCHEMA)
    assert len(out) == len(edge_rows())
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert by_id[0]["n_shingles"] == by_id[2]["n_shingles"] == 0 and by_id[0]["kept"] and by_id[100]["kept"]
    # The same words in any case, with any rows of another table's columns.
    assert {by_id[k]["component_id"] for k in (6, 7, 8, 106, 107, 108)} == {6}
    assert by_id[104]["component_id"] == 4 and by_id[5]["n_shingles"] == 1
    assert found_in(spark, [], EDGE_SCHEMA) == []


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "five words are all alike"), (1, "Five words are all alike"), (2, "other"), (2, "other"), (None, "x"), (None, "x"), (5, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = neardup.keep_one(Workspace(spark, "neardup"), docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect() if r["text"]) == [
        ("1", "Five words are all alike"), ("2", "other"), ("None", "x"),
    ]
    assert kept.count() == 4


def test_rows_with_one_id_and_different_texts_are_one_document(spark):
    a, b, c, d = ("five words are all alike", "and another five words here now", "a third text of six words", "a last text of other words")
    rows = [(1, a), (5, a), (5, b), (9, b), (12, c), (12, ""), (7, c), (20, d), (20, c), (30, d), (40, None), (40, "")]
    expected = {1: 1, 5: 1, 9: 1, 7: 7, 12: 7, 20: 7, 30: 7, 40: 40}
    out = found_in(spark, rows)
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == sorted((k, expected[k]) for k, _ in rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    kept = neardup.keep_one(Workspace(spark, "neardup"), spark.createDataFrame(rows, SCHEMA))
    # Each text stays once, whatever the ids, and a null or empty one is no copy of another.
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (5, b), (7, c), (20, d), (12, ""), (40, None), (40, "")])


def test_unrelated_texts_of_one_id_stay(spark):
    a, b = "seven words that have nothing in common here", "quite other words are standing in this text"
    rows = [(7, a), (7, b), (8, None), (8, a + " now"), (None, b), (None, b), (None, "only here and without any id at all"), (3, b)]
    kept = neardup.keep_one(Workspace(spark, "neardup"), spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, kept)) == Counter(
        [(7, a), (3, b), (8, None), (None, "only here and without any id at all")])


def test_large_buckets_of_several_components_stay_small(spark):
    """Members that agree in a band without being alike: copies grow with members, not with their square."""
    rng = np.random.default_rng(4)
    work = Workspace(spark, "neardup")
    registers = np.full((20_000, len(SetSketch().factors)), 7, np.uint16)
    registers[:, neardup.ROWS :] = rng.integers(0, 60_000, (20_000, registers.shape[1] - neardup.ROWS))
    # Member 3 is like member 9 of the largest component.
    registers[3] = registers[9]
    reps = work.store("reps", spark.createDataFrame([(k, 100, r.tobytes()) for k, r in enumerate(registers)], "id long, n int, registers binary"))
    members = [(0, 1, k, 10 if k > 5 else k, 10, 20_000, 6) for k in range(20_000)]
    open_ = spark.createDataFrame(members, "band int, key long, id long, comp long, main long, all long, others long")
    hashes = np.arange(100, dtype=np.uint64).tobytes()
    sets = spark.createDataFrame([(k, hashes, registers[k].tobytes()) for k in (3, 9, 700)], "id long, hashes binary, registers binary")
    # All members once, six of them once per block as well; blocks against blocks would be 1.6 million.
    assert neardup._copies(open_, reps).count() == 20_000 + 6 * -(-20_000 // neardup.BLOCK)
    found = neardup._remaining(work, open_, reps, sets, 75, neardup.MARGIN)
    assert [tuple(r) for r in found.collect()] == [(3, 9)]
    assert {r["id"] for r in spark.read.parquet(f"{work.folder}/near").collect()} == {3, 9}


def test_ids_chained_by_texts_and_links(spark):
    """Links that only centres' remainders find are joined with those of repeated ids."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(40)]
    rows += [(39, "quite another text of its own"), (60, "quite another text of its own"), (60, "one more text that stands alone"),
             (55, "one more text that stands alone")]
    assert {r["component_id"] for r in found_in(spark, rows)} == {0}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    sketch = SetSketch()
    for share in (0.0, 0.3, 0.75, 0.9, 1.0):
        union = rng.integers(0, 1 << 63, 2_000, dtype=np.uint64)
        both = int(2_000 * share)
        only = (2_000 - both) // 2
        a, b = union[: both + only], np.concatenate([union[:both], union[both + only :]])
        x, y = sketch.registers(a), sketch.registers(b)
        assert (np.maximum(x, y) == sketch.registers(np.unique(union))).all()
        above, below = (x > y).sum(), (x < y).sum()
        found = estimate(above, below, len(x) - above - below, len(a), len(b))
        assert abs(float(found) - share) < 0.1


def test_hashes_follow_words_only():
    hasher = ShingleHasher()

    def sets(*texts):
        raw = [t.encode() for t in texts]
        return list(hasher.sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))

    a, b, c, d, e, f = sets("A b c d e f", "a  b\nc\td e f ", "", "a b c d", "a b c d e", " ")
    assert (a == b).all() and len(a) == 2 and len(c) == len(f) == 0 and len(d) == len(e) == 1 and d[0] != e[0]
    # The neighbours of a text in its slice do not matter.
    assert (sets("x y", "A b c d e f")[1] == a).all()
    assert len(sets("word " * 300_000)[0]) == 1


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = components(Workspace(spark, "components"), spark.createDataFrame(edges, "a long, b long"))
    got = {r["id"]: r["component_id"] for r in found.collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200, 202: 200}
