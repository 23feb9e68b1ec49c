"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by joining vocabulary strings.

A text is cut at special tokens and then into words by the vocabulary's splitting pattern, which no merge
crosses. Every distinct word is merged once per Python worker: its symbols form a doubly linked
list, the ranks of neighbouring pairs wait in a heap, the lowest rank merges first and the leftmost
of equal ranks, and an entry whose pair is gone by then is skipped. A word of n bytes costs
n log n at most, so a long run without blanks is no special case.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalsift.llm.common import ragged, small_batches, text_slices
from vitalsift.llm.words import Ragged, Slots

# Fixed value: the splitting pattern that belongs to byte-level vocabularies of this kind.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# What one worker remembers before it starts anew; more memory, fewer merges.
REMEMBERED_WORDS = 400_000
REMEMBERED_CHARACTERS = 16 << 20
_PLACE_BITS = 40


def byte_letters() -> list[str]:
    """The character that stands for each byte in vocabulary strings.

    Printable Latin-1 characters stand for themselves, all other bytes for the code points from
    256 on, in order.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class BytePairs:
    """Encodes as the library does with the same file, without adding special tokens.

    With ``special`` the strings of special tokens inside a text become their ids; otherwise they
    are ordinary text.
    """

    def __init__(
        self,
        path: str,
        special: bool = True,
        remembered: int = REMEMBERED_WORDS,
        remembered_characters: int = REMEMBERED_CHARACTERS,
    ):
        with open(path, encoding="utf-8") as file:
            saved = json.load(file)
        model, split = saved["model"], saved["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or saved["normalizer"]:
            raise ValueError(f"{path} is no byte-level BPE vocabulary without normalizer and prefix")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in saved["added_tokens"]):
            raise ValueError("special tokens that take blanks along are not supported")
        vocabulary: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in saved["added_tokens"]}
        self.size = max([*vocabulary.values(), *added.values()]) + 1
        letters = byte_letters()
        self.first = [vocabulary[c] for c in letters]
        # Rank of a pair of ids, and the id that each rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for left, right in model["merges"]:
            self.ranks[vocabulary[left] * self.size + vocabulary[right]] = len(self.made)
            self.made.append(vocabulary[left + right])
        # Longer strings first, so that none hides another that it begins.
        self.added = added if special else {}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.words_of = regex.compile(WORDS).findall
        byte_of = {c: b for b, c in enumerate(letters)}
        raw = [b""] * self.size
        for word, k in vocabulary.items():
            raw[k] = bytes(map(byte_of.__getitem__, word))
        for word, k in added.items():
            raw[k] = word.encode()
        self.strings = raw
        self.special_ids = set(added.values())
        self.raw_lengths = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.remembered = remembered
        self.remembered_characters = remembered_characters
        self._forget()

    def _forget(self) -> None:
        self.slots, self.words, self.characters = Slots(), Ragged(), 0
        # Words never hold a whole special token where special tokens count.
        for word, k in self.added.items():
            self.slots[word]
            self.words.extend(np.array([k], np.uint32), np.ones(1, np.int64))
        self.slots.new = []

    def merge(self, symbols: list[int]) -> list[int]:
        """Ids of one word, from the ids of its bytes."""
        n, ranks, size = len(symbols), self.ranks, self.size
        if n < 2:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for at in range(n - 1):
            rank = ranks.get(symbols[at] * size + symbols[at + 1])
            if rank is not None:
                queue.append(rank << _PLACE_BITS | at)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            rank, at = entry >> _PLACE_BITS, entry & ((1 << _PLACE_BITS) - 1)
            right = after[at]
            # Stale: the symbol went into its left neighbour, or the pair is another one now.
            if symbols[at] < 0 or right == n or ranks.get(symbols[at] * size + symbols[right]) != rank:
                continue
            symbols[at], symbols[right] = self.made[rank], -1
            following, previous = after[right], before[at]
            after[at] = following
            if following < n:
                before[following] = at
                rank = ranks.get(symbols[at] * size + symbols[following])
                if rank is not None:
                    heappush(queue, rank << _PLACE_BITS | at)
            if previous >= 0:
                rank = ranks.get(symbols[previous] * size + symbols[at])
                if rank is not None:
                    heappush(queue, rank << _PLACE_BITS | previous)
        return [s for s in symbols if s >= 0]

    def _learn(self) -> None:
        new, self.slots.new = self.slots.new, []
        first, ids, lengths = self.first, [], np.zeros(len(new), np.int64)
        for k, word in enumerate(new):
            merged = self.merge([first[b] for b in word.encode()])
            ids += merged
            lengths[k] = len(merged)
            self.characters += len(word)
        self.words.extend(np.array(ids, np.uint32), lengths)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and the number of ids of each text."""
        if len(self.slots) > self.remembered or self.characters > self.remembered_characters:
            self._forget()
        words: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            if self.added and any(token in text for token in self.added):
                for part in self.splitter.split(text):
                    words += [part] if part in self.added else self.words_of(part)
            else:
                words += self.words_of(text)
            ends[k + 1] = len(words)
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        if self.slots.new:
            self._learn()
        ids, lengths = self.words.gather(slots)
        return ids, np.diff(np.concatenate([[0], np.cumsum(lengths)])[ends])

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of runs of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.raw_lengths[ids]
        data = self.raw[ragged(self.raw_starts[ids], sizes)].tobytes()
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


_coders: dict[tuple[str, bool], BytePairs] = {}


def coder(path: str, special: bool = True) -> BytePairs:
    """This worker's coder for a vocabulary file."""
    if (path, special) not in _coders:
        _coders[path, special] = BytePairs(path, special)
    return _coders[path, special]


def encode_decode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit integers, one after another) and the text
    ``decoded`` from those ids, for every row.

    A null text counts as empty and has no ids. Rows are handled one by one, so repeated and
    missing ids and repeated rows stay; other columns are ignored, an empty table gives no rows.
    Nothing is shuffled.
    """
    path = path or default_path()
    small_batches(documents.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for part, _, _ in text_slices(batches, "text"):
            ids, lengths = own.encode([t or "" for t in part.column(1).to_pylist()])
            data = pa.py_buffer(ids.astype("<u4").tobytes())
            offsets = pa.py_buffer((np.concatenate([[0], np.cumsum(lengths)]) * 4).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offsets, data]),
                    pa.array(own.decode(ids, lengths), pa.string()),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        coded, "doc_id long, ids binary, decoded string"
    )


def digest_columns(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
