import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests_llm_support import EDGE_SCHEMA, edge_rows
from vitalsift.llm import bytepairs

BITS = [" ", "  ", "a", "b", "ab", "aa", "the", "\n", "\t", "é", "ß", "漢", "😀", "　", "ing", "aaaa", "//", "....", "    ",
        "0", "12", "--", "\x00", "ñ", "́", "<|endoftext|>", "<|endoftext", "'s", "'ll", "'", "ion", "er", " t", "\r\n", "\x85", "​"]


@pytest.fixture(scope="module")
def coder():
    return bytepairs.BytePairs(bytepairs.default_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bytepairs.default_path())


def texts():
    rng = random.Random(13)
    found = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    return found + ["", "a" * 5_000, "ab" * 3_000, " " * 3_000, "abcabc" * 2_000, "-" * 5_000, "x" * 100_000]


def compare(coder, library, texts):
    ids, lengths = coder.encode(texts)
    decoded = coder.decode(ids, lengths)
    expected = library.encode_batch(texts, add_special_tokens=False)
    for text, end, n, back, one in zip(texts, np.cumsum(lengths), lengths, decoded, expected, strict=True):
        assert ids[end - n : end].tolist() == one.ids, text[:100]
        assert back == library.decode(one.ids, skip_special_tokens=False), text[:100]


def test_ids_and_texts_equal_the_library(coder, library):
    compare(coder, library, texts())


def test_every_character(coder, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    compare(coder, library, ["".join(f"a{c} {c}1" for c in points[k : k + 64]) for k in range(0, len(points), 64)])


def test_special_tokens_as_plain_text(library):
    plain = bytepairs.BytePairs(bytepairs.default_path(), special=False)
    library.encode_special_tokens = True
    try:
        compare(plain, library, texts()[:5_000])
    finally:
        library.encode_special_tokens = False


def test_merges_lowest_rank_first_and_leftmost_of_ties(coder):
    def slowly(word):
        symbols = [coder.first[b] for b in word.encode()]
        while True:
            ranked = [(coder.ranks.get(a * coder.size + b, 1 << 60), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))]
            if not ranked or min(ranked)[0] == 1 << 60:
                return symbols
            rank, at = min(ranked)
            symbols[at : at + 2] = [coder.made[rank]]

    rng = random.Random(4)
    for _ in range(2_000):
        word = "".join(rng.choice("aabcdeeinorst é") for _ in range(rng.randint(0, 60)))
        assert coder.merge([coder.first[b] for b in word.encode()]) == slowly(word)


def test_parts_of_characters_decode_like_the_library(coder, library):
    rng = random.Random(5)
    runs = [[rng.randrange(coder.size) for _ in range(rng.randint(0, 12))] for _ in range(5_000)]
    lengths = np.array([len(r) for r in runs])
    flat = np.array([k for r in runs for k in r], np.uint32)
    assert coder.decode(flat, lengths) == [library.decode(r, skip_special_tokens=False) for r in runs]


def test_forgetting_changes_nothing(library):
    for limits in ({"remembered": 3}, {"remembered_characters": 5}):
        small = bytepairs.BytePairs(bytepairs.default_path(), **limits)
        for _ in range(3):
            compare(small, library, ["one two three", "four<|endoftext|>five  six"])


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bytepairs.BytePairs(str(public_tokenizers.path("word_bpe_49k.json")))


def test_rows(spark, library):
    found = bytepairs.digest_columns(bytepairs.encode_decode(spark.createDataFrame(edge_rows(), EDGE_SCHEMA))).collect()
    assert len(found) == len(edge_rows())
    texts = {r[0]: r[1] or "" for r in edge_rows()}
    for row in found:
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bytepairs.digest_columns(bytepairs.encode_decode(spark.createDataFrame([], EDGE_SCHEMA))).collect() == []
