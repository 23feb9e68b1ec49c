"""Packing of documents into token sequences: order kept, window cuts chosen by dynamic programming.

Ids of consecutive documents form one line of tokens. A window of at most ``length`` tokens
becomes one sequence. Windows end preferably where a document ends, at a price where a sentence
ends, and at a higher price inside a sentence that is longer than ``_STRIDE`` tokens. With P the
positions and c the prices, the best total up to a cut j is

    best[j] = min over i, P[j] - P[i] <= length, of best[i] + (length - (P[j] - P[i])) + c[j]

and as best[i] + P[i] does not depend on j, a queue of rising minima gives each cut its best
predecessor in constant amortised time. Sequences are padded to ``length`` except those with a power of two of tokens, so the last window
of a range may be split into powers of two where that costs less than padding it.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalsift.llm.common import small_batches
from vitalsift.llm.words import END_ID, default_path, encoded_rows, encoder

LENGTH = 4096
SENTENCE_PRICE = 16
INSIDE_PRICE = 64
BLOCK_IDS = 1 << 19
_STRIDE = 256
# Room for the running number of a sequence within its range of documents.
_SEQUENCE_BITS = 40

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_ARROW_PIECES = pa.schema([
    (name, pa.int64()) for name in
    ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
])


def choose_cuts(positions: np.ndarray, prices: np.ndarray, length: int) -> tuple[list[int], float]:
    """Indices of the best cuts from the first to the last position, and their total cost.

    Neighbouring positions must be at most ``length`` apart. Among equal costs the longest
    last window wins.
    """
    place, price = positions.tolist(), prices.tolist()
    best = [0.0] * len(place)
    came = [0] * len(place)
    queue = deque([0])
    for j in range(1, len(place)):
        while place[queue[0]] < place[j] - length:
            queue.popleft()
        i = queue[0]
        best[j] = best[i] + length - (place[j] - place[i]) + price[j]
        came[j] = i
        value = best[j] + place[j]
        while queue and best[queue[-1]] + place[queue[-1]] > value:
            queue.pop()
        queue.append(j)
    cuts = [len(place) - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1], best[-1]


def split_rest(tokens: int, length: int, price: float) -> list[int]:
    """Sequence sizes for a last window: itself, or powers of two before it where that is cheaper."""
    cost: dict[int, tuple[float, list[int]]] = {}

    def solve(n: int) -> tuple[float, list[int]]:
        if n not in cost:
            power = 1 << (n.bit_length() - 1)
            if n == power or n == length:
                cost[n] = (0.0, [n])
            else:
                rest, sizes = solve(n - power)
                padded = (float(length - n), [n])
                cost[n] = min(padded, (price + rest, [power, *sizes]), key=lambda x: x[0])
        return cost[n]

    return solve(tokens)[1] if tokens else []


def cut_positions(ids, lengths, ends_sentence, length, sentence_price, inside_price):
    """Candidate cuts in a run of documents with their prices, 0 and the end included."""
    n = len(ids)
    price = np.full(n + 1, np.inf)
    price[1:][ends_sentence[ids]] = sentence_price
    price[np.cumsum(lengths)] = 0
    price[0] = 0
    at = np.flatnonzero(np.isfinite(price))
    stride = max(1, min(_STRIDE, length // 2))
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > stride)
    if len(wide):
        inside = np.concatenate([np.arange(at[k] + stride, at[k + 1], stride) for k in wide])
        price[inside] = inside_price
        at = np.flatnonzero(np.isfinite(price))
    return at, price[at]


def pack_ids(
    blocks: Iterator[tuple[list, np.ndarray, np.ndarray]], ends_sentence: np.ndarray,
    length: int = LENGTH, sentence_price: float = SENTENCE_PRICE, inside_price: float = INSIDE_PRICE,
    block_ids: int = BLOCK_IDS,
) -> Iterator[dict[str, np.ndarray]]:
    """Columns of pieces for consecutive (doc ids, token ids, ids per document).

    Cuts are chosen over about ``block_ids`` tokens at a time; what the last window of a block
    holds moves on to the next block.
    """
    number = 0
    names: list = []
    ids, lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    # Tokens of the first document that earlier blocks have taken.
    taken = 0

    def pieces(sizes: np.ndarray) -> dict[str, np.ndarray]:
        nonlocal number
        sequence_ends = np.cumsum(sizes)
        used = int(sequence_ends[-1])
        document_ends = np.cumsum(lengths)
        ends = np.unique(np.concatenate([sequence_ends, document_ends[document_ends < used]]))
        starts = np.concatenate([[0], ends[:-1]])
        document = np.searchsorted(document_ends, starts, side="right")
        sequence = np.searchsorted(sequence_ends, starts, side="right")
        before = np.where(document == 0, taken, 0)
        own = ids[:used].astype("<u4")
        columns = {
            "doc_id": [names[k] for k in document],
            "start": starts - (document_ends - lengths)[document] + before,
            "length": ends - starts,
            "ids_crc32": [zlib.crc32(own[a:b].data) for a, b in zip(starts, ends, strict=True)],
            "doc_tokens": lengths[document] + before,
            "sequence_id": number + sequence,
            "offset": starts - (sequence_ends - sizes)[sequence],
        }
        number += len(sizes)
        return columns

    def cut(last: bool) -> dict[str, np.ndarray] | None:
        nonlocal names, ids, lengths, taken
        at, prices = cut_positions(ids, lengths, ends_sentence, length, sentence_price, inside_price)
        cuts, _ = choose_cuts(at, prices, length)
        sizes = np.diff(at[cuts])
        if last:
            sizes = np.concatenate([sizes[:-1], split_rest(int(sizes[-1]), length, inside_price)]).astype(np.int64)
        else:
            sizes = sizes[:-1]
        if not len(sizes):
            return None
        found = pieces(sizes)
        used = int(sizes.sum())
        ends = np.cumsum(lengths)
        done = int(np.searchsorted(ends, used, side="right"))
        begun = used - (int(ends[done - 1]) if done else 0)
        taken = begun + (taken if done == 0 else 0)
        names, ids, lengths = names[done:], ids[used:], lengths[done:].copy()
        if begun:
            lengths[0] -= begun
        return found

    waiting: list[np.ndarray] = []
    held = 0
    for more_names, more_ids, more_lengths in blocks:
        names = names + more_names
        lengths = np.concatenate([lengths, more_lengths])
        waiting.append(more_ids)
        held += len(more_ids)
        if held >= block_ids:
            ids = np.concatenate([ids, *waiting])
            waiting, held = [], 0
            if (found := cut(last=False)) is not None:
                yield found
    ids = np.concatenate([ids, *waiting])
    if len(ids) and (found := cut(last=True)) is not None:
        yield found


def sentence_ends(vocabulary: dict[str, int], size: int, end_id: int) -> np.ndarray:
    """Which ids end a sentence: marks at the end of a word, and the end of a document."""
    flags = np.zeros(size, bool)
    for piece, k in vocabulary.items():
        text = piece.removesuffix("</w>").rstrip("\"')]}»*#$%&_-")
        flags[k] = piece.endswith("</w>") and text.endswith((".", "!", "?"))
    flags[end_id] = True
    return flags


def pack(
    documents: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID,
    sentence_price: float = SENTENCE_PRICE, inside_price: float = INSIDE_PRICE,
) -> DataFrame:
    """Pieces of ``documents`` (doc_id, text) packed into sequences, in ascending doc_id order.

    One shuffle by ranges of doc_id; every range is packed by its own task, which holds one
    block of ids at a time, and ``sequence_id`` is unique over all ranges. A null text counts as empty and has
    only its end id. Null ids come first; rows with one id are documents of their own, in the
    order of their texts. Other columns are ignored; an empty table has no pieces.
    """
    path = path or default_path()
    small_batches(documents.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, end_id)
        ends = sentence_ends(own.tokenizer.get_vocab(with_added_tokens=True), own.size, end_id)
        first = TaskContext.get().partitionId() << _SEQUENCE_BITS
        rows = encoded_rows(batches, path, end_id)
        for columns in pack_ids(rows, ends, length, sentence_price, inside_price):
            columns["sequence_id"] = columns["sequence_id"] + first
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) for f in _ARROW_PIECES], schema=_ARROW_PIECES
            )

    return (
        documents.select(F.col("doc_id").cast("long"), F.col("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(packed, PIECES)
    )
