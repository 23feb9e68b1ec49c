import hashlib
import random
import re

from tests_llm_support import EDGE_SCHEMA, edge_rows
from vitalsift.llm import fingerprints

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def follow(rows):
    """Each row, its next row's text, and its edited text, by falling id."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for k, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        yield doc_id, text, after, text[: len(text) - half] + after[:half]


def found_in(spark, rows, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema).repartition(5)
    return fingerprints.fingerprint_documents(docs).collect()


def test_edits_and_likeness(spark):
    rng = random.Random(7)
    words = [f"w{k}é" for k in range(300)]
    rows = []
    for k in range(150):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 5, 9, 60, 400])))
        if rows and rng.random() < 0.4:
            # Close to the next document by falling id.
            own = rows[-1][1].split()
            own[rng.randrange(len(own))] = "changed"
            text = " ".join(own)
        rows.append((10 * k, text))
    out = {r["doc_id"]: r for r in found_in(spark, rows)}
    errors = []
    for doc_id, text, after, edited in follow(rows):
        row = out[doc_id]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [row["near_edited"] - jaccard(text, edited), row["near_next"] - jaccard(text, after)]
    assert abs(sum(errors) / len(errors)) < 0.015 and max(map(abs, errors)) < 0.25
    assert all(len(r["fingerprint"]) == 2 * fingerprints.BINS for r in out.values())


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "A  b c\td e f"), (4, "z")]
    out = {r["doc_id"]: r for r in found_in(spark, rows)}
    assert out[1]["fingerprint"] == out[2]["fingerprint"] == out[3]["fingerprint"] != out[4]["fingerprint"]
    assert out[3]["near_next"] == out[2]["near_next"] == 1.0


def test_edge_rows(spark):
    rows = list({r[0]: r for r in edge_rows()}.values())
    out = {r["doc_id"]: r for r in found_in(spark, rows, EDGE_SCHEMA)}
    assert len(out) == len(rows)
    for doc_id, text, _, edited in follow(rows):
        assert out[doc_id]["n_chars"] == len(text)
        assert out[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[doc_id]["near_edited"] <= 1 and 0 <= out[doc_id]["near_next"] <= 1
    assert out[0]["fingerprint"] == out[1]["fingerprint"] == out[2]["fingerprint"] == ""
    assert len(found_in(spark, edge_rows(), EDGE_SCHEMA)) == len(edge_rows())


def test_one_document_and_none(spark):
    (row,) = found_in(spark, [(5, "abcd efgh")])
    assert row["edited_sha256"] == hashlib.sha256(b"abcd abcd").hexdigest() or row["n_chars"] == 9
    assert row["near_next"] == 1.0
    assert found_in(spark, []) == []
    assert len(found_in(spark, [(None, "a"), (None, "a")])) == 2


def test_many_ranges_keep_the_order(spark):
    rows = [(k * k - 50, f"text number {k} with some words {k % 7}") for k in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        out = {r["doc_id"]: r for r in found_in(spark, rows)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 3)
    for doc_id, _, _, edited in follow(rows):
        assert out[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_plan_is_native_and_moves_texts_once(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    plan = fingerprints.fingerprint_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
