import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests_llm_support import EDGE_SCHEMA, edge_rows
from vitalsift.llm import alignment, bytepairs, pieces
from vitalsift.llm.common import Workspace

BITS = [" ", "  ", "a", "ab", "the", "\n", "\t", "é", "ß", "漢", "😀", "▁", "　", "ing", "....", "0", "12", "\x00", "́",
        "<|endoftext|>", "<s>", "<0x0A>", "ion", "er", " t", "\r\n", "tokenization", "'s"]


class Plain:
    """The same by the libraries, sets of ends and loops over tokens."""

    def __init__(self):
        self.a = Tokenizer.from_file(bytepairs.default_path())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
        self.byte_of = {c: b for b, c in enumerate(bytepairs.byte_letters())}

    def tokens(self, text):
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False)
        left = [(k, bytes(self.byte_of[c] for c in t)) for k, t in zip(a.ids, a.tokens)]
        right = []
        for k in self.b.encode(text):
            piece = self.b.id_to_piece(k)
            right.append((k, bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if any(b"".join(r for _, r in side) != whole for side in (left, right)):
            return [], []
        return left, right

    def groups(self, text):
        left, right = self.tokens(text)
        ends = [np.cumsum([len(r) for _, r in side]).tolist() for side in (left, right)]
        common = set(ends[0]) & set(ends[1])
        sides = []
        for side, at in zip((left, right), ends):
            groups = [[]]
            for (k, _), end in zip(side, at):
                groups[-1].append(k)
                if end in common:
                    groups.append([])
            sides.append(groups[:-1])
        return list(zip(*sides))

    def rows(self, texts):
        groups = [self.groups(t) for t in texts]
        counts = Counter((a[-1], b[-1]) for found in groups for a, b in found)
        most = {}
        for (_, b), n in counts.items():
            most[b] = max(n, most.get(b, 0))
        for found in groups:
            links = [(a[-1], b[-1]) for a, b in found]
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
            yield (
                sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(links),
                sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
                hashlib.sha256(text.encode()).hexdigest() if found else "",
            )


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    return Plain()


def test_cuts_equal_the_common_ends():
    rng = np.random.default_rng(11)
    for _ in range(300):
        # Several texts, some with hardly a common end.
        a_ends, b_ends, spans, base = [], [], [], 0
        for _ in range(rng.integers(1, 6)):
            size = int(rng.integers(1, 200))
            own = [np.union1d(rng.choice(size, rng.integers(0, size + 1), replace=False)[:, None] + 1, [size]) for _ in range(2)]
            spans.append((len(a_ends), len(a_ends) + len(own[0]), len(b_ends), len(b_ends) + len(own[1])))
            a_ends += (own[0] + base).tolist()
            b_ends += (own[1] + base).tolist()
            base += size
        a_ends, b_ends = np.array(a_ends), np.array(b_ends)
        cuts_a, cuts_b = alignment.common_cuts(a_ends, b_ends, *zip(*spans))
        assert a_ends[cuts_a].tolist() == np.intersect1d(a_ends, b_ends).tolist() == b_ends[cuts_b].tolist()


def test_long_intervals_without_a_cut():
    a_ends, b_ends = np.arange(1, 400_001, 2), np.arange(2, 400_002, 2)
    a_ends[-1] = b_ends[-1]
    cuts = alignment.common_cuts(a_ends, b_ends, [0], [len(a_ends)], [0], [len(b_ends)])
    assert [c.tolist() for c in cuts] == [[len(a_ends) - 1], [len(b_ends) - 1]]
    none = np.zeros(0, np.int64)
    assert [len(c) for c in alignment.common_cuts(none, none, [0], [0], [0], [0])] == [0, 0]


def test_rows_equal_the_plain_version(spark, plain):
    rng = random.Random(12)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(1_500)]
    rows = [(k, t) for k, t in enumerate(texts)]
    found = alignment.align_documents(Workspace(spark, "alignment"), spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r["doc_id"]: r for r in found.collect()}
    assert len(found) == len(texts)
    for k, expected in enumerate(plain.rows(texts)):
        assert tuple(found[k][c] for c in COLUMNS) == expected, texts[k]


def test_tokens_of_both_vocabularies(plain):
    own = alignment.aligner(bytepairs.default_path(), pieces.default_path())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    # The second run of blanks is too long for the fast splitter.
    texts += ["", " " * 3_000 + "x", " " * 1_500_000 + "x", "x" * 300_000, "\n" * 300_000]
    ids, lengths = own.a.encode(texts)
    for one, end, n in zip(plain.a.encode_batch(texts, add_special_tokens=False), np.cumsum(lengths), lengths):
        assert ids[end - n : end].tolist() == one.ids


def test_groups_of_texts(spark, plain):
    texts = ["Tokenization of words", "漢字 and é", "a▁b", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in alignment.align(rows).collect():
        groups, a, b = plain.groups(texts[row["doc_id"]]), iter(row["a_ids"]), iter(row["b_ids"])
        found = [([next(a) for _ in range(m)], [next(b) for _ in range(n)]) for m, n in zip(row["a_sizes"], row["b_sizes"])]
        assert found == groups and list(a) == list(b) == []
        assert list(zip(row["a_linked"], row["b_linked"])) == [(x[-1], y[-1]) for x, y in groups]


def test_odd_rows(spark, plain):
    rows = edge_rows()
    work = Workspace(spark, "alignment")
    found = alignment.align_documents(work, spark.createDataFrame(rows, EDGE_SCHEMA)).collect()
    expected = [(row[0], *digest) for row, digest in zip(rows, plain.rows([r[1] or "" for r in rows]))]
    by_row = lambda r: (r[0] is None, r)
    assert sorted([tuple(r) for r in found], key=by_row) == sorted(expected, key=by_row)
    assert alignment.align_documents(Workspace(spark, "alignment"), spark.createDataFrame([], EDGE_SCHEMA)).collect() == []


def test_the_vocabularies_bound_the_pairs(spark):
    bound = alignment.possible_pairs(bytepairs.default_path(), pieces.default_path())
    assert 0 < bound < 1_000_000
    work = Workspace(spark, "alignment")
    aligned = alignment.align(spark.createDataFrame(edge_rows(), EDGE_SCHEMA))
    too_many = spark.range(bound + 1).selectExpr("0 AS a_id", "cast(id AS int) AS b_id", "id AS n_links")
    with pytest.raises(ValueError, match="vocabularies allow"):
        alignment.summarise(work, aligned, too_many)
