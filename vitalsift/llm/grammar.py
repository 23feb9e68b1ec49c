"""Token-id files compressed by a Re-Pair grammar per shard, with random access to documents.

A shard holds the ids of consecutive documents. The most frequent pairs of neighbouring ids are
replaced by new symbols, the result again, and so on until no pair is frequent. A round replaces
many pairs at once: where two of them overlap, the more frequent one wins, the left one among
equals. No symbol spans two documents.

Body of a shard, little endian: magic ``RPG1``; five uint32: first new symbol, rules, documents,
symbols, end id; then uint32 arrays: rules (two per rule), expansion length of each rule, symbols
per document, symbols. A document is decoded from its own symbols and the rules alone.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalsift.llm.common import Workspace, ragged, small_batches
from vitalsift.llm.words import END_ID, default_path, encoded_rows, encoder

MAGIC = b"RPG1"
SHARD_IDS = 1 << 20
PAIRS_PER_ROUND = 2048
MIN_COUNT = 16
_SLOT_BITS = 18

SHARD_SCHEMA = "part int, seq int, part_start long, n_ids long, doc_ids array<long>, body binary"


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)
    return (mixed * np.uint32(0xC2B2AE35) >> np.uint32(32 - _SLOT_BITS)).astype(np.intp)


def _rising(*places: np.ndarray) -> np.ndarray:
    """All places of 0 or more, each once and rising; in every row of ``places``, no place exceeds the next row's."""
    every = np.stack(places, axis=1).ravel()
    every = every[np.append(True, every[1:] != every[:-1])]
    return every[int(every[0] < 0) :]


def _frequent(symbols, slots, counts, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs as 64-bit keys, by falling count and rising key; where they may stand.

    A pair stands at its left symbol. ``counts`` are the pairs of each slot.
    """
    full = counts[counts >= least]
    limit = int(np.partition(full, -most)[-most]) if len(full) >= most else least
    # Full slots may hold rare pairs only; then all slots that can hold a frequent one are read.
    for enough in sorted({limit, least}, reverse=True):
        at = np.flatnonzero((counts >= enough)[slots])
        keys, times = np.unique(symbols[at].astype(np.int64) << 32 | symbols[at + 1], return_counts=True)
        keys, times = keys[times >= least], times[times >= least]
        if len(keys):
            break
    return keys[np.lexsort((keys, -times))][:most], at


def compress(
    ids: np.ndarray, lengths: np.ndarray, first_symbol: int, end_id: int = END_ID,
    rounds: int | None = None, pairs: int = PAIRS_PER_ROUND, least: int = MIN_COUNT,
) -> bytes:
    """The body of a shard: documents with ``lengths`` ids each, all below ``first_symbol``.

    Goes on until no pair is seen ``least`` times, or for at most ``rounds`` rounds where given.
    """
    symbols = np.array(ids, np.uint32)
    # Where documents end, rising; few beside the symbols.
    last = np.cumsum(lengths[lengths > 0], dtype=np.int64) - 1
    rules: list[np.ndarray] = []
    sizes = np.ones(first_symbol, np.uint32)
    # Slots of the pairs that begin at each symbol; the last of a document is in a slot that counts none.
    none = 1 << _SLOT_BITS
    slots = np.full(len(symbols), none, np.intp)
    slots[:-1] = _slots(symbols[:-1], symbols[1:])
    slots[last] = none
    counts = np.bincount(slots, minlength=none + 1)
    for _ in itertools.count() if rounds is None else range(rounds):
        counts[none] = 0
        keys, at = _frequent(symbols, slots, counts, pairs, least)
        if not len(keys):
            break
        low, high = (keys >> 32).astype(np.uint32), (keys & 0xFFFFFFFF).astype(np.uint32)
        rule_at = np.full(none + 1, -1, np.int32)
        # Of rules with one slot the most frequent, written last, stays.
        rule_at[_slots(low, high)[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        rule = rule_at[slots[at]]
        hit, own = at[rule >= 0], rule[rule >= 0]
        fits = (low[own] == symbols[hit]) & (high[own] == symbols[hit + 1])
        hit, own = hit[fits], own[fits]
        # In a run of one symbol every second pair overlaps the one before it.
        place = np.arange(len(hit))
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (np.diff(hit) > 1) | (own[1:] != own[:-1])
        even = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
        hit, own = hit[even], own[even]
        meets = np.diff(hit) == 1
        wins = np.ones(len(hit), bool)
        wins[1:] &= ~meets | (own[1:] < own[:-1])
        wins[:-1] &= ~meets | (own[:-1] <= own[1:])
        chosen, own = hit[wins], own[wins]
        if not len(chosen):
            break
        # Only rules that were applied are kept.
        kept = np.unique(own)
        number = np.zeros(len(keys), np.uint32)
        number[kept] = len(sizes) + np.arange(len(kept), dtype=np.uint32)
        # Only the pairs of a replaced symbol and the one before it change their slots.
        np.subtract.at(counts, slots[_rising(chosen - 1, chosen, chosen + 1)], 1)
        symbols[chosen] = number[own]
        stays = np.ones(len(symbols), bool)
        stays[chosen + 1] = False
        symbols, slots = symbols[stays], slots[stays]
        last = last - np.searchsorted(chosen + 1, last, side="right")
        moved = chosen - np.arange(len(chosen))
        moved = _rising(moved - 1, moved)
        slots[moved] = _slots(symbols[moved], symbols[np.minimum(moved + 1, len(symbols) - 1)])
        slots[last] = none
        np.add.at(counts, slots[moved], 1)
        rules.append(np.stack([low[kept], high[kept]], axis=1))
        sizes = np.concatenate([sizes, sizes[low[kept]] + sizes[high[kept]]])
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    per_document = np.zeros(len(lengths), np.uint32)
    per_document[lengths > 0] = np.diff(last + 1, prepend=0)
    head = np.array([first_symbol, len(table), len(lengths), len(symbols), end_id])
    arrays = (head, table.ravel(), sizes[first_symbol:], per_document, symbols)
    return MAGIC + b"".join(a.astype("<u4").tobytes() for a in arrays)


class Shard:
    """A shard's body, opened for reading."""

    def __init__(self, body: bytes):
        if body[:4] != MAGIC:
            raise ValueError("not a token shard")
        words = np.frombuffer(body, "<u4", offset=4)
        self.first, n_rules, n_documents, n_symbols, self.end_id = (int(x) for x in words[:5])
        cuts = np.cumsum([5, 2 * n_rules, n_rules, n_documents, n_symbols])
        if cuts[-1] != len(words):
            raise ValueError("a token shard has been cut short")
        rules, sizes, self.per_document, self.symbols = (
            words[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        )
        self.sizes = np.concatenate([np.ones(self.first, np.int64), sizes.astype(np.int64)])
        self.rules = rules.reshape(-1, 2)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols to ids, one level of rules at a time."""
        while len(at := np.flatnonzero(symbols >= self.first)):
            counts = np.ones(len(symbols), np.int64)
            counts[at] = 2
            starts = np.cumsum(counts) - counts
            wider = np.repeat(symbols, counts)
            pairs = self.rules[symbols[at] - self.first]
            wider[starts[at]], wider[starts[at] + 1] = pairs[:, 0], pairs[:, 1]
            symbols = wider
        return symbols

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the ids per document."""
        every = self._expand(np.arange(self.first, self.first + len(self.rules), dtype=np.uint32))
        flat = np.concatenate([np.arange(self.first, dtype=np.uint32), every])
        starts = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[self.symbols]
        ids = flat[ragged(starts[self.symbols], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[np.concatenate([[0], np.cumsum(self.per_document, dtype=np.int64)])]
        return ids, np.diff(bounds)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, without decoding the others."""
        ends = np.cumsum(self.per_document, dtype=np.int64)
        return self._expand(self.symbols[ends[k] - self.per_document[k] : ends[k]])


def _write_shards(path: str, end_id: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first_symbol = encoder(path, end_id).size
        seq = before = held = 0
        documents: list = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            body = compress(np.concatenate(ids), np.concatenate(lengths), first_symbol, end_id)
            row = {"part": part, "seq": seq, "part_start": before, "n_ids": held, "doc_ids": documents, "body": body}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW_SHARD)

        for names, some, each in encoded_rows(batches, path, end_id):
            documents += names
            ids.append(some)
            lengths.append(each)
            held += len(some)
            if held >= SHARD_IDS:
                yield shard()
                seq, before, held = seq + 1, before + held, 0
                documents, ids, lengths = [], [], []
        if documents:
            yield shard()

    return shards


_ARROW_SHARD = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("body", pa.binary()),
])
_ARROW_DOCUMENT = pa.schema([
    ("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()),
    ("ids_crc32", pa.int64()),
])


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, lengths = Shard(row["body"]).ids()
            ids = ids.astype("<u4")
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[e - n : e].data) for e, n in zip(ends, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * len(crc), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                 pa.array(row["part_start"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                schema=_ARROW_DOCUMENT,
            )


def write_tokens(
    documents: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """Encode ``documents`` (doc_id, text) and write shards in ascending doc_id order.

    One shuffle by ranges of doc_id; a task then encodes and compresses its range shard by
    shard. Spark's writer commits the files, so a task that runs twice leaves one copy. Texts
    that are null count as empty, null ids come first, rows with one id follow their text.
    Other columns are ignored; an empty table gives no shard.
    """
    small_batches(documents.sparkSession)
    ordered = (
        documents.select(F.col("doc_id").cast("long"), F.col("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    shards = ordered.mapInArrow(_write_shards(path or default_path(), end_id), SHARD_SCHEMA)
    # The grammar has compressed the bodies; rows are large, so pages stay small.
    shards.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(folder)
    return documents.sparkSession.read.schema(SHARD_SCHEMA).parquet(folder)


def read_tokens(shards: DataFrame) -> DataFrame:
    """Decode shards: doc_id, start, n_tokens, ids_crc32 of every document.

    ``start`` counts the ids of all earlier documents: the shard knows those of its range, and
    the totals of the ranges, one row per writing task, are added up and broadcast.
    """
    small_batches(shards.sparkSession)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    )
    found = shards.mapInArrow(_read_shards, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(totals), "part").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(documents: DataFrame, path: str | None = None) -> DataFrame:
    work = Workspace(documents.sparkSession, "tokens")
    return read_tokens(write_tokens(documents, f"{work.folder}/shards", path))
