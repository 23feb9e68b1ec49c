"""Alignment of two tokenizers' ids over the same bytes, and how often two ids end together.

A text becomes byte-level BPE tokens (A) and pieces (B) over the bytes of a blank and the text.
Byte offsets where tokens of both end are cuts; they part the tokens into groups that cover the
same bytes. Cuts are found by divide and conquer: an interval's middle end of A is looked for among
the ends of B by bisection, then ends ever further from the middle; the first common one parts the
interval, and both halves are treated alike. An interval without a common end inside is one group.
All intervals of one depth, over all texts of a batch, are one step in numpy.

The two tokens that end at a cut are linked. One of them is a suffix of the other in bytes, so the
two vocabularies alone bound the number of linked id pairs, whatever the corpus holds: that makes
the table of their counts small enough to be sent to all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalsift.llm import bytepairs, pieces
from vitalsift.llm.common import Workspace, ragged, small_batches, text_slices

# Text aligned at once inside a task; one document may be longer.
SLICE_BYTES = 1 << 19
# Words that a worker remembers before it starts anew.
REMEMBERED = 150_000

#: What ``align`` can return. Ids of all tokens; tokens of both sides in every group; the linked ids of
#: every group; numbers of tokens; the SHA-256 of the groups written as ``a1,a2|b1;a3|b2``.
COLUMNS = {
    "doc_id": "long", "a_ids": "array<int>", "b_ids": "array<int>", "a_sizes": "array<int>", "b_sizes": "array<int>",
    "a_linked": "array<int>", "b_linked": "array<int>", "n_a": "long", "n_b": "long", "groups_sha256": "string",
}


def _ring(low: np.ndarray, high: np.ndarray, middle: np.ndarray, inner: int, outer: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices at a distance of inner to outer - 1 from the middle within [low, high), and their owners."""
    left_from, left_to = np.maximum(low, middle - outer + 1), middle - inner + 1
    right_from, right_to = middle + max(inner, 1), np.minimum(high, middle + outer)
    lengths = np.stack([left_to - left_from, right_to - right_from], 1).clip(0).ravel()
    starts = np.stack([left_from, right_from], 1).ravel()
    return ragged(starts, lengths), np.repeat(np.arange(len(low)).repeat(2), lengths)


def common_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_from, a_to, b_from, b_to) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of A and of B that end together, by divide and conquer.

    Ends ascend strictly over all texts. Interval k holds the tokens [a_from, a_to) of A and
    [b_from, b_to) of B, which cover the same bytes; the last ones of both therefore end together.
    Returns the indices in A and in B, in order.
    """
    a_from, a_to, b_from, b_to = (np.asarray(x, np.int64) for x in (a_from, a_to, b_from, b_to))
    full = a_to > a_from
    a_from, a_to, b_from, b_to = a_from[full], a_to[full], b_from[full], b_to[full]
    found_a, found_b = [a_to - 1], [b_to - 1]
    while True:
        # A single token on either side leaves no room for a cut inside.
        wide = (a_to - a_from > 1) & (b_to - b_from > 1)
        a_from, a_to, b_from, b_to = a_from[wide], a_to[wide], b_from[wide], b_to[wide]
        if not len(a_from):
            break
        last = a_to - 1
        middle = (a_from + last) // 2
        cut_a = np.full(len(a_from), -1, np.int64)
        cut_b = np.full(len(a_from), -1, np.int64)
        open_, inner, outer = np.arange(len(a_from)), 0, 1
        while len(open_):
            near, owner = _ring(a_from[open_], last[open_], middle[open_], inner, outer)
            at = np.searchsorted(b_ends, a_ends[near])
            hit = b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends[near]
            near, at, owner = near[hit], at[hit], open_[owner[hit]]
            # Of the common ends of a ring the one closest to the middle.
            order = np.lexsort((np.abs(near - middle[owner]), owner))
            owner, near, at = owner[order], near[order], at[order]
            first = np.diff(owner, prepend=-1) != 0
            cut_a[owner[first]], cut_b[owner[first]] = near[first], at[first]
            inside = (middle[open_] - outer >= a_from[open_]) | (middle[open_] + outer < last[open_])
            open_ = open_[(cut_a[open_] < 0) & inside]
            inner, outer = outer, 2 * outer
        parted = cut_a >= 0
        cut_a, cut_b = cut_a[parted], cut_b[parted]
        found_a.append(cut_a)
        found_b.append(cut_b)
        a_from, a_to = np.concatenate([a_from[parted], cut_a + 1]), np.concatenate([cut_a + 1, a_to[parted]])
        b_from, b_to = np.concatenate([b_from[parted], cut_b + 1]), np.concatenate([cut_b + 1, b_to[parted]])
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


class ByteTokens:
    """Byte-level BPE with special tokens as plain text, by the tiktoken library.

    It merges by the order of ids, which is the order of merges in these vocabularies. A run of
    white space too long for its splitting pattern is left to ``bytepairs``.
    """

    def __init__(self, path: str):
        import tiktoken

        self.exact = bytepairs.BytePairs(path, special=False, remembered=REMEMBERED)
        self.raw, self.raw_starts, self.raw_lengths = self.exact.raw, self.exact.raw_starts, self.exact.raw_lengths
        ranks = {word: k for k, word in enumerate(self.exact.strings) if word and k not in self.exact.special_ids}
        if np.any(np.diff(self.exact.made) <= 0):
            raise ValueError(f"{path} has ids that are not in the order of merges")
        self.library = tiktoken.Encoding("tokens", pat_str=bytepairs.WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and the number of ids of each text."""
        found = [np.zeros(0, np.uint32)]
        for text in texts:
            try:
                found.append(self.library.encode_to_numpy(text, disallowed_special=()))
            except ValueError:
                found.append(self.exact.encode([text])[0])
        return np.concatenate(found), np.array([len(x) for x in found[1:]], np.int64)


class Aligner:
    """Tokens and groups of texts under two vocabularies."""

    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED):
        self.a = ByteTokens(a_path)
        self.b = pieces.PieceCoder(b_path, remembered)

    def align(self, texts: list[str]):
        """Ids of A and B, ids of each text, tokens of A and B per group, groups of each text.

        Texts that are empty, or that a vocabulary does not spell exactly, have no tokens.
        """
        spelled = [" " + t for t in texts]
        a, a_counts = self.a.encode(spelled)
        b, b_counts = self.b.encode(texts)
        a_raw, b_raw = self.a.raw_lengths[a], self.b.raw_lengths[b]
        sizes = np.array([len(t.encode()) for t in spelled], np.int64)
        n = len(texts)
        a_owner, b_owner = np.repeat(np.arange(n), a_counts), np.repeat(np.arange(n), b_counts)
        a_bytes = np.bincount(a_owner, weights=a_raw, minlength=n).astype(np.int64)
        b_bytes = np.bincount(b_owner, weights=b_raw, minlength=n).astype(np.int64)
        exact = (sizes > 1) & (a_bytes == sizes) & (b_bytes == sizes)
        data = np.frombuffer("".join([t for t, keep in zip(spelled, exact, strict=True) if keep]).encode(), np.uint8)
        owner = np.repeat(np.flatnonzero(exact), sizes[exact])
        # Byte-level tokens spell any text; pieces do not where a text holds their mark for a blank.
        kept = exact[b_owner]
        wrong = self.b.raw[ragged(self.b.raw_starts[b[kept]], b_raw[kept])] != data
        exact[owner[wrong]] = False
        a_kept, b_kept = exact[a_owner], exact[b_owner]
        a, b, a_counts, b_counts = a[a_kept], b[b_kept], np.where(exact, a_counts, 0), np.where(exact, b_counts, 0)
        a_ends, b_ends = np.cumsum(a_raw[a_kept]), np.cumsum(b_raw[b_kept])
        a_to, b_to = np.cumsum(a_counts), np.cumsum(b_counts)
        cuts_a, cuts_b = common_cuts(a_ends, b_ends, a_to - a_counts, a_to, b_to - b_counts, b_to)
        groups = np.diff(np.searchsorted(cuts_a, a_to), prepend=0)
        return a, a_counts, b, b_counts, np.diff(cuts_a, prepend=-1), np.diff(cuts_b, prepend=-1), groups


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner for two vocabulary files."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def align(
    documents: DataFrame, a_path: str | None = None, b_path: str | None = None, columns: tuple[str, ...] = tuple(COLUMNS)
) -> DataFrame:
    """Per row ``doc_id`` and its alignment, as the ``columns`` that are asked for.

    Group k has ``a_sizes[k]`` tokens of A and ``b_sizes[k]`` of B, the last of which,
    ``a_linked[k]`` and ``b_linked[k]``, are linked. Null and empty texts, and texts that a vocabulary does
    not spell exactly, have empty arrays and an empty digest. Rows are handled one by one, so
    repeated and missing ids and repeated rows stay; other columns are ignored, an empty table
    gives no rows. Nothing is shuffled.
    """
    a_path, b_path = a_path or bytepairs.default_path(), b_path or pieces.default_path()
    small_batches(documents.sparkSession)

    def lists(counts: np.ndarray, flat: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for part, _, _ in text_slices(batches, "text", SLICE_BYTES):
            found = own.align([t or "" for t in part.column(1).to_pylist()])
            a, n_a, b, n_b, a_sizes, b_sizes, groups = found
            make = {
                "doc_id": lambda: part.column(0),
                "a_ids": lambda: lists(n_a, a),
                "b_ids": lambda: lists(n_b, b),
                "a_sizes": lambda: lists(groups, a_sizes),
                "b_sizes": lambda: lists(groups, b_sizes),
                "a_linked": lambda: lists(groups, a[np.cumsum(a_sizes) - 1]),
                "b_linked": lambda: lists(groups, b[np.cumsum(b_sizes) - 1]),
                "n_a": lambda: pa.array(n_a.astype(np.int64)),
                "n_b": lambda: pa.array(n_b.astype(np.int64)),
                "groups_sha256": lambda: pa.array(group_digests(*found), pa.string()),
            }
            yield pa.RecordBatch.from_arrays([make[c]() for c in columns], names=list(columns))

    schema = ", ".join(f"{c} {COLUMNS[c]}" for c in columns)
    return documents.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(aligned, schema)


def group_digests(a, n_a, b, n_b, a_sizes, b_sizes, groups) -> list[str]:
    """SHA-256 of each text's groups as text (``a1,a2|b1;a3|b2``); empty where there are none."""
    # Tokens in the order of the text: those of A, then those of B, group after group.
    a_place = np.arange(len(a)) + np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)
    b_place = np.arange(len(b)) + np.repeat(np.cumsum(a_sizes), b_sizes)
    ids = np.empty(len(a) + len(b), np.int32)
    ids[a_place], ids[b_place] = a, b
    marks = np.full(len(ids), ord(","), np.uint8)
    marks[a_place[np.cumsum(a_sizes) - 1]] = ord("|")
    marks[b_place[np.cumsum(b_sizes) - 1]] = ord(";")
    # Decimal digits in columns of equal width; leading places stay empty.
    width = len(str(int(ids.max(initial=0))))
    cells = np.zeros((len(ids), width + 1), np.uint8)
    cells[:, width] = marks
    rest, shown = ids, np.ones(len(ids), bool)
    for column in range(width - 1, -1, -1):
        rest, digit = np.divmod(rest, 10)
        cells[:, column] = np.where(shown, digit + ord("0"), 0)
        shown = rest > 0
    filled = cells != 0
    ends = np.concatenate([[0], np.cumsum(filled.sum(axis=1))])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
    data = cells[filled].tobytes()
    return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:], strict=False)]


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both ids of every link of a batch in one number, and the links of each row."""
    a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("a_linked", "b_linked"))
    keys = a.flatten().to_numpy(zero_copy_only=False).astype(np.int64) << 32
    return keys | b.flatten().to_numpy(zero_copy_only=False), np.diff(a.offsets.to_numpy())


def link_counts(aligned: DataFrame) -> DataFrame:
    """``a_id``, ``b_id``, ``n_links``: how many links of the corpus hold each pair of ids.

    Each task adds up its own links first; what it holds is bounded by the vocabularies.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new, n = np.unique(_links(batch)[0], return_counts=True)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            sums = np.bincount(place, weights=np.concatenate([sums, n]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)],
            names=["a_id", "b_id", "n"],
        )

    parts = aligned.select("a_linked", "b_linked").mapInArrow(counted, "a_id int, b_id int, n long")
    return parts.groupBy("a_id", "b_id").agg(F.sum("n").alias("n_links"))


def possible_pairs(a_path: str, b_path: str) -> int:
    """How many pairs of ids can ever be linked: those whose bytes end one in the other."""

    def spelled(coder) -> dict[bytes, int]:
        found: dict[bytes, int] = {}
        raw, ends = coder.raw.tobytes(), coder.raw_starts + coder.raw_lengths
        for start, end in zip(coder.raw_starts.tolist(), ends.tolist(), strict=True):
            if end > start:
                found[raw[start:end]] = found.get(raw[start:end], 0) + 1
        return found

    own = aligner(a_path, b_path)
    a, b = spelled(own.a), spelled(own.b)
    return sum(n * b.get(word[k:], 0) for word, n in a.items() for k in range(len(word))) + sum(
        n * a.get(word[k:], 0) for word, n in b.items() for k in range(1, len(word))
    )


def summarise(
    work: Workspace, aligned: DataFrame, counts: DataFrame, a_path: str | None = None, b_path: str | None = None
) -> DataFrame:
    """Digest per row of ``align``: tokens, groups, links, and what ``counts`` says of its links.

    ``n_best`` counts links whose pair is the most frequent one of its B id, ties included, and
    ``count_sum`` adds up the counts of all links. ``counts`` goes to every task; its rows are
    counted first and cannot exceed what the two vocabularies allow.
    """
    a_path, b_path = a_path or bytepairs.default_path(), b_path or pieces.default_path()
    counts = work.store("counts", counts)
    bound, n = possible_pairs(a_path, b_path), counts.count()
    if n > bound:
        raise ValueError(f"{n} linked pairs of ids, but these vocabularies allow {bound}")
    table = counts.toArrow()
    key = table["a_id"].to_numpy().astype(np.int64) << 32 | table["b_id"].to_numpy()
    order = np.argsort(key)
    key, total = key[order], table["n_links"].to_numpy()[order]
    most = np.zeros(int((key & 0xFFFFFFFF).max(initial=0)) + 1, np.int64)
    np.maximum.at(most, key & 0xFFFFFFFF, total)
    shared = work.spark.sparkContext.broadcast((key, total, total == most[key & 0xFFFFFFFF]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, totals, best = shared.value
        for batch in batches:
            links, groups = _links(batch)
            at = np.searchsorted(keys, links)
            ends = np.cumsum(groups)
            sums = [np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (best, totals)]
            sums = [x[ends] - x[ends - groups] for x in sums]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_a", "n_b")]
            columns += [pa.array(x.astype(np.int64)) for x in (groups, groups, *sums)]
            columns.append(batch.column(batch.schema.get_field_index("groups_sha256")))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = ", ".join(f"{c} {COLUMNS.get(c, 'long')}" for c in names)
    return aligned.select("doc_id", "n_a", "n_b", "groups_sha256", "a_linked", "b_linked").mapInArrow(summed, schema)


def align_documents(
    work: Workspace, documents: DataFrame, a_path: str | None = None, b_path: str | None = None
) -> DataFrame:
    """The digest of every document's alignment. What is read twice of it is stored."""
    needed = ("doc_id", "n_a", "n_b", "groups_sha256", "a_linked", "b_linked")
    aligned = work.store("aligned", align(documents, a_path, b_path, needed))
    return summarise(work, aligned, link_counts(aligned), a_path, b_path)
