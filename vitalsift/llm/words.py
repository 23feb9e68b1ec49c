"""Token ids of whole texts through the tokenizers library, which sees each distinct piece once.

The word tokenizer drops white space and never merges across it, so a text's ids are the ids of
its words between blanks and line ends. Other white space stays inside the words and is left to the
library. Words repeat: Arrow lists the distinct ones of a slice of texts, and numpy cuts these into
letters and the marks after them. Each such piece is encoded by the library once per Python worker
and remembered, and texts become one numpy gather.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from vitalsift.llm.common import ragged, text_slices

END_ID = 2
# Half the pieces remembered by one worker before it starts anew; more memory, fewer repeated calls.
REMEMBERED = 500_000

# Marks that may follow letters: ASCII but for the apostrophe, which begins pieces such as 's.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
# Bytes in UTF-8: letters of ASCII, the first and second byte of letters from U+00C0 to U+00FF, marks.
_LETTER, _FIRST, _SECOND, _MARK = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[0xC3] = _FIRST
_KIND[[k for k in range(0x80, 0xC0) if k not in (0x97, 0xB7)]] = _SECOND
_KIND[list(MARKS.encode())] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _strings(data: np.ndarray, starts: np.ndarray) -> pa.DictionaryArray:
    """The distinct strings among those that begin at ``starts`` and end at the next start."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.string(), len(starts), buffers).dictionary_encode()


def _bytes_of(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings, and where each begins."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int32)[: len(strings) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[: offsets[-1]], offsets[:-1]


def _pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts words into pieces that the tokenizer encodes apart, two per word, one maybe empty.

    A word of letters of ASCII or Latin-1, then marks, becomes its letters in lower case and its
    marks: the splitting pattern ends a run of letters at any other character, and lower case and
    normal form of these letters do not depend on their neighbours. Any other word stays whole.
    """
    kind = _KIND[data]
    letter = kind == _LETTER
    wide = (kind[:-1] == _FIRST) & (kind[1:] == _SECOND)
    letter[:-1] |= wide
    letter[1:] |= wide
    mark = kind == _MARK
    odd = ~(letter | mark)
    inner = np.ones(len(data), bool)
    inner[starts] = False
    odd[1:] |= mark[:-1] & letter[1:] & inner[1:]
    whole = np.logical_or.reduceat(odd, starts)
    sizes = np.diff(starts, append=len(data))
    small = _LOWER[data]
    small[1:][wide & (data[1:] < 0x9F)] += 32
    small = np.where(np.repeat(whole, sizes), data, small)
    cuts = np.where(whole, sizes, np.add.reduceat(letter, starts, dtype=np.int64))
    return small, np.stack([starts, starts + cuts], axis=1).ravel()


def _closings(piece: str) -> int:
    """Ids of a piece that close a word, if it is Latin letters and maybe marks after them; else 0."""
    core = piece.rstrip(MARKS)
    if core.isalpha() and max(core) < "\u0250" and core.lower().isalpha():
        return 1 + (len(core) < len(piece))
    return 0


class Slots(dict):
    """Numbers new keys in order of arrival and lists them."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        slot = self[word] = len(self)
        self.new.append(word)
        return slot


class Ragged:
    """A growing list of id sequences in flat arrays.

    A sequence's start and length share one number, so finding it is one access to memory.
    """

    _LENGTH_BITS = 28

    def __init__(self) -> None:
        self.n = self.used = 0
        self.places = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        n, used = self.n + len(lengths), self.used + len(flat)
        if n > len(self.places):
            self.places = np.resize(self.places, 2 * n)
        if used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * used)
        starts = self.used + np.cumsum(lengths) - lengths
        self.places[self.n : n] = starts << self._LENGTH_BITS | lengths
        self.flat[self.used : used] = flat
        self.n, self.used = n, used

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the sequences numbered ``which``, one after another, and their lengths."""
        places = self.places[which]
        lengths = places & ((1 << self._LENGTH_BITS) - 1)
        return self.flat[ragged(places >> self._LENGTH_BITS, lengths)], lengths


class WordEncoder:
    """Encodes lists of texts with ``add_special_tokens=False`` and an end id after each."""

    def __init__(self, path: str, end_id: int = END_ID, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.remembered = remembered
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max([end_id, *vocabulary.values()]) + 1
        self.closing = np.zeros(self.size, bool)
        self.closing[[k for piece, k in vocabulary.items() if piece.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.slots, self.pieces = Slots(), Ragged()

    def _encode_pieces(self, pieces: list[str]) -> None:
        """Remember the ids of pieces; letters, marks after them or not, go to the library many at a time."""
        closings = np.array([1 if p.isascii() and p.isalpha() else _closings(p) for p in pieces], np.int64)
        lengths = np.zeros(len(pieces), np.int64)
        plain, alone = np.flatnonzero(closings), np.flatnonzero(closings == 0).tolist()
        groups = [plain[at : at + 512] for at in range(0, len(plain), 512)]
        texts = [" ".join([pieces[k] for k in group]) for group in groups]
        order, flat = [], []
        for group, each in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(each.ids, np.uint32)
            # Letters end with the only id of theirs that closes a word, and so do marks.
            ends = np.flatnonzero(self.closing[ids]) + 1
            last = np.cumsum(closings[group])
            if len(ends) != last[-1]:
                alone += group.tolist()
                continue
            order.append(group)
            flat.append(ids)
            lengths[group] = np.diff(ends[last - 1], prepend=0)
        for k, each in zip(alone, self.tokenizer.encode_batch_fast([pieces[k] for k in alone], add_special_tokens=False), strict=True):
            flat.append(np.array(each.ids, np.uint32))
            lengths[k] = len(flat[-1])
        order = np.concatenate([*order, np.array(alone, np.int64)])
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        self.pieces.extend(np.concatenate(flat)[ragged(starts, lengths)], lengths)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and the number of ids of each text, end id included."""
        data = [text.encode() for text in texts]
        offsets = np.cumsum([0, *map(len, data)])
        return self.encode_bytes(np.frombuffer(b"".join(data), np.uint8), offsets)

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode`` for texts in UTF-8, one after another from each offset to the next.

        Nothing made here refers back to itself, so the cycle collector, which would walk
        through the remembered pieces again and again, rests meanwhile.
        """
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(data, offsets)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slots) > 2 * self.remembered:
            self._forget()
        inside = (data != 32) & (data != 10)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begins] = inside[begins]
        # Places of words' first bytes among all bytes, and among those of words alone.
        starts = np.flatnonzero(first)
        words = _strings(data[inside], np.flatnonzero(first[inside]))
        parts = np.searchsorted(starts, offsets)
        flat, lengths = self._ids_of(words.dictionary)
        # The end id, after each text, is a word after the last.
        which = np.insert(words.indices.to_numpy(), parts[1:], len(lengths))
        lengths = np.append(lengths, 1)
        flat = np.append(flat, np.uint32(self.end_id))
        each = lengths[which]
        ids = flat[ragged((np.cumsum(lengths) - lengths)[which], each)]
        ends = np.concatenate([[0], np.cumsum(each)])
        return ids, np.diff(ends[parts + np.arange(len(parts))])

    def _ids_of(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and their lengths."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pieces = _strings(*_pieces(*_bytes_of(words)))
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False)
        slots = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))
        if self.slots.new:
            new, self.slots.new = self.slots.new, []
            self._encode_pieces(new)
        flat, lengths = self.pieces.gather(slots[pieces.indices.to_numpy()])
        return flat, lengths.reshape(-1, 2).sum(axis=1)


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, end_id: int = END_ID) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def encoded_rows(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int = END_ID
) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Per slice of the input: document ids, all token ids, ids per document."""
    own = encoder(path, end_id)
    for part, data, offsets in text_slices(batches, "text"):
        ids, lengths = own.encode_bytes(data, offsets)
        yield part.column(part.schema.get_field_index("doc_id")).to_pylist(), ids, lengths
