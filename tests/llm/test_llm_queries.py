"""The registered queries over whole tables: SQL twins where there are any, else known properties."""

import os

import duckdb
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from brute import private_spans, secret_spans
from vitalsift.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def results(spark):
    """Rows of every query, computed once."""
    found = {}

    def of(name):
        if name not in found:
            found[name] = queries.QUERIES[name](spark, SF_DIR).collect()
        return found[name]

    return of


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_its_sql(results, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.execute(f"create view {table} as select * from read_parquet('{SF_DIR}/{table}.parquet')")
    answer = connection.execute(queries.ORACLES[name])
    columns = [c[0] for c in answer.description]
    found = results(name)
    assert sorted(found[0].asDict()) == sorted(columns)
    assert sorted(repr([r[c] for c in columns]) for r in found) == sorted(repr(list(r)) for r in answer.fetchall())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op2_embedding_near_dedup", "op9_warc", "op10_packing", "op12_conversation_repair")])
def test_one_row_per_document(results, documents, name):
    assert sorted(r["doc_id"] for r in results(name)) == sorted(d["doc_id"] for d in documents)


def test_names_cover_all():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scans", "packing"]


def test_languages_of_held_out_documents(results, documents):
    truth = {d["doc_id"]: d["lang"] for d in documents if d["lang"]}
    held = [r for r in results("op1_language_id") if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.9


def test_counts_of_private_data_and_secrets(results, documents):
    texts = {d["doc_id"]: d["text"] for d in documents}
    for r in results("op7_pii"):
        kinds = [k for _, _, k in private_spans(texts[r["doc_id"]])]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
    for r in results("op8_secret_scans"):
        kinds = [k for _, _, k in secret_spans(texts[r["doc_id"]])]
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [kinds.count(k) for k in ("assign", "access", "hex")]


def test_packing_holds_every_token_once_with_little_padding(results):
    tokens = sum(r["n_tokens"] for r in results("op5_token_id_output"))
    pieces = results("op10_packing")
    assert sum(r["length"] for r in pieces) == tokens
    sizes = {}
    for r in pieces:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert max(sizes.values()) <= 4096
    assert sum(4096 - n for n in sizes.values() if n & (n - 1)) < 0.03 * tokens
