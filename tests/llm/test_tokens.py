import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests_llm_support import EDGE_SCHEMA, edge_rows
from vitalsift.llm import grammar, packing, words

ODD = ["", "  ", "İstanbul ǅ", "ß.ẞ don't I'LL 'S's", "áb ﬁ", "x<|endoftext|>y z", "\x1c a\x1cb", "a.. b.,! ..",
       "Ω ΣΑΣ ΟΔΟΣ. x", "é É.", "क़ क़", "ª º ÷×", "a b　c d", "ŉ ǰ", "12.3 a1 b2c", "Å K", "word." * 300,
       "Word word, WORD! word", "x" * 20_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(words.default_path())


def expected_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("remembered", [5, 500_000])
def test_ids_equal_the_library(library, remembered):
    coder = words.WordEncoder(words.default_path(), remembered=remembered)
    rng = random.Random(4)
    bits = ["a", "The", "é", " ", "\n", ".", ",", "'s", "12", "ß", "漢", "-", "WORD", "\t", "ing", "!", "İ", "ς", "Σ"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4_000)]
    for at in range(0, len(texts), 500):
        ids, lengths = coder.encode(texts[at : at + 500])
        ends = np.cumsum(lengths)
        for text, end, n in zip(texts[at : at + 500], ends, lengths, strict=True):
            assert ids[end - n : end].tolist() == expected_ids(library, text), text[:80]


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 5_000, 400)
    copies = np.concatenate([np.append(text, rng.integers(0, 5_000, 5)) for _ in range(40)])
    for ids, lengths in (
        (copies, np.full(40, 405)), (np.full(100_000, 7), np.array([100_000])), (rng.integers(0, 40, 200_000), np.full(200, 1_000)),
        (np.tile([1, 1, 2], 20_000), np.array([30_000, 0, 30_000])),
    ):
        shard = grammar.Shard(grammar.compress(ids.astype(np.uint32), lengths, 5_000))
        found, each = shard.ids()
        assert (found == ids).all() and (each == lengths).all()
        ends = np.cumsum(shard.per_document, dtype=np.int64)
        inner = np.ones(len(shard.symbols), bool)
        inner[ends[shard.per_document > 0] - 1] = False
        at = np.flatnonzero(inner)
        pairs, at_pair = np.unique(shard.symbols[at].astype(np.int64) << 32 | shard.symbols[at + 1], return_inverse=True)
        assert not len(pairs) or np.bincount(at_pair).max() < grammar.MIN_COUNT
    assert len(grammar.compress(copies.astype(np.uint32), np.full(40, 405), 5_000)) < 4 * len(copies) / 8


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for n, top in ((0, 9), (1, 9), (50, 2), (30_000, 12), (200_000, 40)):
        lengths = []
        while sum(lengths) < n:
            lengths.append(int(min(rng.integers(0, 60), n - sum(lengths))))
        lengths = np.array(lengths + [0], np.int64)
        ids = rng.integers(0, top, int(lengths.sum())).astype(np.uint32)
        body = grammar.compress(ids, lengths, 50, rounds=8, least=3)
        shard = grammar.Shard(body)
        found, sizes = shard.ids()
        assert (found == ids).all() and (sizes == lengths).all()
        ends = np.cumsum(lengths)
        for k in rng.integers(0, len(lengths), 20):
            assert (shard.document(k) == ids[ends[k] - lengths[k] : ends[k]]).all()
        if n >= 30_000 and top == 12:
            assert len(shard.rules) and len(shard.symbols) < 0.6 * len(ids)
    same = np.zeros(1_001, np.uint32)
    assert (grammar.Shard(grammar.compress(same, np.array([1_001]), 5)).ids()[0] == same).all()
    with pytest.raises(ValueError):
        grammar.Shard(body[:-4])


def test_rules_never_span_documents():
    ids = np.tile(np.array([1, 2], np.uint32), 500)
    shard = grammar.Shard(grammar.compress(ids, np.ones(1_000, np.int64), 5))
    assert len(shard.rules) == 0


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_token_files(spark, library):
    rows = edge_rows()
    found = grammar.token_files(spark.createDataFrame(rows, EDGE_SCHEMA).repartition(5)).collect()
    start, expected = 0, []
    for doc_id, text, *_ in ordered(rows):
        ids = np.array(expected_ids(library, text), "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    assert grammar.token_files(spark.createDataFrame([], EDGE_SCHEMA)).collect() == []


def best_total(place, price, length):
    best = [0.0] + [float("inf")] * (len(place) - 1)
    for j in range(1, len(place)):
        for i in range(j):
            if place[j] - place[i] <= length:
                best[j] = min(best[j], best[i] + length - (place[j] - place[i]) + price[j])
    return best[-1]


def test_cuts_are_optimal():
    rng = np.random.default_rng(6)
    for _ in range(300):
        place = np.concatenate([[0], np.cumsum(rng.integers(1, 9, rng.integers(1, 40)))])
        price = rng.choice([0.0, 3.0, 11.0], len(place))
        cuts, total = packing.choose_cuts(place, price, 16)
        assert total == best_total(place.tolist(), price.tolist(), 16)
        sizes = np.diff(place[cuts])
        assert cuts[0] == 0 and cuts[-1] == len(place) - 1 and sizes.max() <= 16


def test_last_window_is_split_where_that_is_cheaper():
    assert packing.split_rest(4096, 4096, 64) == [4096]
    assert packing.split_rest(2048, 4096, 64) == [2048]
    assert packing.split_rest(2500, 4096, 64) == [2048, 256, 128, 64, 4]
    assert packing.split_rest(4095, 4096, 64) == [4095]
    assert packing.split_rest(0, 4096, 64) == []


def check_pieces(pieces, ids_of, length):
    """Every id in exactly one piece, sequences gapless and within their length."""
    by_document, by_sequence = {}, {}
    for p in pieces:
        by_document.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        own = np.array(ids_of[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert p["length"] > 0 and p["ids_crc32"] == zlib.crc32(own.tobytes())
        assert p["doc_tokens"] == len(ids_of[p["doc_id"]])
    for doc_id, own in by_document.items():
        own.sort(key=lambda p: p["start"])
        at = 0
        for p in own:
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids_of[doc_id])
    assert by_document.keys() == ids_of.keys()
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_blocks_of_ids_are_packed_whole():
    rng = np.random.default_rng(8)
    ends = np.zeros(60, bool)
    ends[[2, 7]] = True
    for block, length in ((64, 16), (1_000, 64), (10**9, 4096)):
        lengths = rng.integers(1, 150, 300)
        ids = rng.integers(3, 60, int(lengths.sum())).astype(np.uint32)
        ids[np.cumsum(lengths) - 1] = 2
        cuts = np.cumsum(lengths)
        ids_of = {k: ids[e - n : e].tolist() for k, (e, n) in enumerate(zip(cuts, lengths, strict=True))}
        blocks = ((list(range(k, k + 10)), ids[cuts[k] - lengths[k] : cuts[k + 9]], lengths[k : k + 10]) for k in range(0, 300, 10))
        pieces = []
        for columns in packing.pack_ids(blocks, ends, length, block_ids=block):
            pieces += [dict(zip(columns, map(int, row), strict=True)) for row in zip(*columns.values(), strict=True)]
        padding = check_pieces(pieces, ids_of, length)
        assert padding <= 0.25 * len(ids)


def test_documents_are_packed(spark, library):
    rows = [r for r in edge_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    pieces = [r.asDict() for r in packing.pack(spark.createDataFrame(rows, EDGE_SCHEMA).repartition(4)).collect()]
    padding = check_pieces(pieces, {r[0]: expected_ids(library, r[1]) for r in rows}, 4096)
    assert padding < 4096
    by_id = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    assert [p["doc_id"] for p in by_id] == sorted(p["doc_id"] for p in by_id)


def test_repeated_and_missing_ids_are_packed(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    pieces = packing.pack(docs).collect()
    assert sum(p["length"] for p in pieces) == 3 + 3 + 2 + 1
    assert packing.pack(spark.createDataFrame([], EDGE_SCHEMA)).collect() == []


def test_no_round_partitions_all_slots(monkeypatch):
    """A late round has few frequent pairs; only counts that can be frequent are searched for the limit."""
    sizes, partition = [], np.partition
    monkeypatch.setattr(grammar.np, "partition", lambda a, *k: sizes.append(len(a)) or partition(a, *k))
    ids = np.random.default_rng(5).integers(0, 300, 60_000).astype(np.uint32)
    lengths = np.array([0, 20_000, 1, 0, 39_999])
    found, each = grammar.Shard(grammar.compress(ids, lengths, 1000, pairs=64, least=4)).ids()
    assert found.tolist() == ids.tolist() and each.tolist() == lengths.tolist()
    assert all(n < 1 << grammar._SLOT_BITS for n in sizes)


class Seen:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode(self, text, **options):
        self.texts.append(text)
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_of_known_pieces_are_not_encoded_again(library):
    """Case and marks make new words, and neither new pieces nor new calls of the library."""
    coder = words.WordEncoder(words.default_path())
    coder.encode(["word *** été $$$ (816)"])
    coder.tokenizer = seen = Seen(coder.tokenizer)
    texts = ["Word*** WORD$$$ word", "", "Été*** ÉTÉ$$$\nétÉ", "(816)"]
    ids, lengths = coder.encode(texts)
    assert ids.tolist() == [k for text in texts for k in expected_ids(library, text)]
    assert lengths.tolist() == [len(expected_ids(library, text)) for text in texts]
    assert seen.texts == []


def test_ids_of_every_letter_and_mark(library):
    """Characters up to U+024F, and some beyond, among letters, alone and before marks."""
    coder = words.WordEncoder(words.default_path())
    odd = [chr(c) for c in (*range(1, 0x250), 0x301, 0x338, 0x3A3, 0x1E9E, 0x212A, 0x4E00, 0x1F600)]
    texts = [f"Ab{c}Cd. {c}{c}! ab{c} {c}'s <|{c}|>" for c in odd] + ["", " \n ", "x<|endoftext|>,"]
    ids, lengths = coder.encode(texts)
    assert lengths.tolist() == [len(expected_ids(library, text)) for text in texts]
    assert ids.tolist() == [k for text in texts for k in expected_ids(library, text)]
    assert [x.tolist() for x in coder.encode([])] == [[], []]


def test_rounds_look_at_changed_pairs_only(monkeypatch):
    """Slots and counts kept from round to round equal fresh ones, and late rounds compute few."""
    computed, fresh, frequent = [], grammar._slots, grammar._frequent

    def checked(symbols, slots, counts, *limits):
        inner = np.flatnonzero(slots < 1 << grammar._SLOT_BITS)
        assert (slots[inner] == fresh(symbols[inner], symbols[inner + 1])).all()
        assert len(symbols) - len(inner) == 4
        assert (counts == np.bincount(slots[inner], minlength=len(counts))).all()
        return frequent(symbols, slots, counts, *limits)

    monkeypatch.setattr(grammar, "_slots", lambda a, b: computed.append(len(a)) or fresh(a, b))
    monkeypatch.setattr(grammar, "_frequent", checked)
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 300, 60_000).astype(np.uint32)
    ids[20_000:20_900] = 7
    lengths = np.array([0, 20_000, 1, 0, 39_000, 999])
    body = grammar.compress(ids, lengths, 1000, pairs=64, least=4)
    found, each = grammar.Shard(body).ids()
    assert found.tolist() == ids.tolist() and each.tolist() == lengths.tolist()
    assert len(computed) > 20 and max(computed[1:]) < 0.5 * len(ids)
