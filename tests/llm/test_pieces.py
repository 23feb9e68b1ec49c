import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from tests_llm_support import EDGE_SCHEMA, edge_rows
from vitalsift.llm import pieces

BITS = [" ", "  ", "a", "b", "ab", "aa", "the", "\n", "\t", "é", "ß", "漢", "😀", "▁", "　", "ing", "aaaa", "//", "....",
        "    ", "0", "12", "--", "\x00", "ñ", "́", "<s>", "</s>", "<0x0A>", "<unk>", "ion", "er", " t"]


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(pieces.default_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def test_ids_and_texts_equal_the_library(coder, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    texts += ["", "a" * 5_000, "ab" * 3_000, " " * 3_000, "abcabc" * 2_000, "-" * 5_000, "x" * 100_000]
    ids, lengths = coder.encode(texts)
    decoded = coder.decode(ids, lengths)
    ends = np.cumsum(lengths)
    for text, end, n, back in zip(texts, ends, lengths, decoded, strict=True):
        expected = library.encode(text)
        assert ids[end - n : end].tolist() == expected, text[:100]
        assert back == library.decode(expected), text[:100]


def test_forgetting_changes_nothing(library):
    small = pieces.PieceCoder(pieces.default_path(), remembered=3)
    for _ in range(3):
        ids, _ = small.encode(["one two three", "four five  six"])
        assert ids.tolist() == library.encode("one two three") + library.encode("four five  six")


def test_rows(spark, library):
    found = pieces.digest_columns(pieces.encode_decode(spark.createDataFrame(edge_rows(), EDGE_SCHEMA))).collect()
    assert len(found) == len(edge_rows())
    texts = {r[0]: r[1] or "" for r in edge_rows()}
    for row in found:
        ids = library.encode(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.digest_columns(pieces.encode_decode(spark.createDataFrame([], EDGE_SCHEMA))).collect() == []
