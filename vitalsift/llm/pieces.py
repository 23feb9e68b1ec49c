"""SentencePiece encoding and decoding of whole texts by vectorised merge rounds.

No piece of the vocabulary has a blank sign after another character, so merges never cross into
the next run of blanks: texts are cut in front of each run, and every distinct part is merged
once per Python worker. All new parts of a batch are merged together, as one flat array of
symbols, cut into runs at neighbours that no piece holds: a round looks up the rank of each neighbouring
pair, takes the smallest rank of each run, merges all its occurrences from the left, and closes
the gaps, until no pair has a rank. A pair that a
merge creates never ranks before the merged pair, because the vocabulary was itself built by merges in
this order, so merging equal pairs together gives what one merge at a time would.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalsift.llm.common import ragged, small_batches, text_slices
from vitalsift.llm.words import Slots

BLANK = "▁"
REMEMBERED = 400_000
RUNS = re.compile(" +[^ ]*")
_NONE = np.iinfo(np.int64).max


class PieceCoder:
    """Encodes as the library does with the same model file, without begin and end ids."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.remembered = remembered
        pieces = [model.id_to_piece(k) for k in range(n)]
        plain = {
            p: k for k, p in enumerate(pieces)
            if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k) or model.is_unused(k))
        }
        if any(BLANK in p.lstrip(BLANK) for p in plain):
            raise ValueError("a piece spans two words; texts cannot be cut at blanks")
        self.byte_ids = np.full(256, -1, np.int64)
        for k, piece in enumerate(pieces):
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces to fall back on")
        # Characters inside pieces that are no pieces themselves get numbers after the ids.
        letters = {c for p in plain for c in p}
        extra = {c: n + k for k, c in enumerate(sorted(letters - plain.keys()))}
        self.base = n + len(extra)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for c in letters:
            self.symbol_of[ord(c)] = plain.get(c, extra.get(c))
        self.n_pieces = n
        self.extra = np.array([ord(c) for c in sorted(extra)], np.int64)
        # Rank of a pair: the order of scores, best first.
        order = sorted(plain.items(), key=lambda item: (-model.get_score(item[1]), item[1]))
        symbols = {**extra, **plain}
        pairs: dict[int, tuple[int, int]] = {}
        for rank, (piece, k) in enumerate(order):
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (rank, k)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[int(k)][0] for k in self.keys], np.int64)
        self.piece_of_rank = np.array([k for _, k in order], np.int32)
        # Neighbouring characters that some piece holds; no merge crosses any others.
        inside = {symbols[a] * self.base + symbols[b] for p in plain for a, b in zip(p, p[1:], strict=False)}
        self.inside = np.array(sorted(inside), np.int64)
        self._build_table()
        # Bytes of every id, for decoding; ids without text are empty.
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        raw = [
            bytes([int(p[3:5], 16)]) if self.is_byte[k] else p.replace(BLANK, " ").encode() if p in plain else b""
            for k, p in enumerate(pieces)
        ]
        raw = [b" \xe2\x81\x87 " if model.is_unknown(k) else r for k, r in enumerate(raw)]
        self.raw_lengths = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self._forget()

    def _build_table(self, bits: int = 20) -> None:
        """Open addressing: a pair lies at most ``probes`` places after its hash."""
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.table_keys = np.full(1 << bits, -1, np.int64)
        self.table_ranks = np.full(1 << bits, _NONE, np.int64)
        rest, probe = np.arange(len(self.keys)), 0
        while len(rest):
            at = (self._hash(self.keys[rest]) + probe) & self.mask
            free = self.table_keys[at] < 0
            _, first = np.unique(at, return_index=True)
            takes = np.zeros(len(rest), bool)
            takes[first] = True
            takes &= free
            self.table_keys[at[takes]] = self.keys[rest[takes]]
            self.table_ranks[at[takes]] = self.ranks[rest[takes]]
            rest, probe = rest[~takes], probe + 1
        self.probes = probe

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._hash(keys)
        seen = self.table_keys[at]
        ranks = np.where(seen == keys, self.table_ranks[at], _NONE)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at_open = (at[open_] + probe) & self.mask
            seen = self.table_keys[at_open]
            hit = seen == keys[open_]
            ranks[open_[hit]] = self.table_ranks[at_open[hit]]
            open_ = open_[~hit & (seen >= 0)]
        return ranks

    def _forget(self) -> None:
        self.slots = Slots()
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, each of which is encoded by itself: all ids, and ids per part."""
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        place = np.arange(len(points))
        symbols = self.symbol_of[points].astype(np.int64)
        owner = self._runs(symbols, owner)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            ranks = np.full(len(symbols), _NONE)
            pair = np.flatnonzero((owner[:-1] == owner[1:]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0))
            ranks[pair] = self._rank(symbols[pair] * self.base + symbols[pair + 1])
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(np.append(first, len(owner)))
            best = np.repeat(np.minimum.reduceat(ranks, first), sizes)
            open_ = best != _NONE
            if not open_.all():
                done.append((place[~open_], symbols[~open_]))
            hits = np.flatnonzero((ranks == best) & open_)
            # Of overlapping equal pairs the first, third, ... merge.
            begins = np.diff(hits, prepend=-2) != 1
            run = np.maximum.accumulate(np.where(begins, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
            symbols[hits] = self.piece_of_rank[ranks[hits]]
            open_[hits + 1] = False
            symbols, owner, place = symbols[open_], owner[open_], place[open_]
        at = np.concatenate([p for p, _ in done]) if done else place
        symbols = np.concatenate([s for _, s in done]) if done else symbols
        order = np.argsort(at, kind="stable")
        at, symbols = at[order], symbols[order]
        owner = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))[at]
        return self._spell(symbols, points[at], owner, len(parts))

    def _runs(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Numbers of the runs of characters inside parts that merges can bring together."""
        if len(symbols) < 2:
            return np.zeros(len(symbols), np.int64)
        keys = symbols[:-1] * self.base + symbols[1:]
        at = np.searchsorted(self.inside, keys)
        at[at == len(self.inside)] = 0
        joined = (self.inside[at] == keys) & (symbols[:-1] >= 0) & (symbols[1:] >= 0) & (owner[:-1] == owner[1:])
        return np.concatenate([[0], np.cumsum(~joined)])

    def _spell(self, symbols, points, owner, n_parts) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters that are no pieces by the ids of their UTF-8 bytes."""
        lone = (symbols < 0) | (symbols >= self.n_pieces)
        width = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        counts = np.where(lone, width, 1)
        ids = np.repeat(symbols, counts)
        starts = np.cumsum(counts) - counts
        at, code, n = starts[lone], points[lone], width[lone]
        mark = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for k in range(4):
            has = n > k
            bits = code[has] >> (6 * (n[has] - 1 - k))
            byte = np.where(n[has] == 1, code[has], mark[n[has]] | bits if k == 0 else 0x80 | bits & 0x3F)
            ids[at[has] + k] = self.byte_ids[byte]
        return ids.astype(np.int32), np.bincount(owner, weights=counts, minlength=n_parts).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (int32), and the number of ids of each text."""
        if len(self.slots) > self.remembered:
            self._forget()
        parts: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            before = len(parts)
            if BLANK in text:
                text = text.replace(BLANK, " ")
            # A blank goes in front of the text; it and each later one opens a part.
            if "  " in text or text[0] == " ":
                parts += [run[1:] for run in RUNS.findall(" " + text)]
            else:
                parts += text.split(" ")
            counts[k] = len(parts) - before
        slots = np.fromiter(map(self.slots.__getitem__, parts), np.int64, len(parts))
        if self.slots.new:
            new, self.slots.new = self.slots.new, []
            ids, lengths = self.merge([BLANK + p.replace(" ", BLANK) for p in new])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, ids])
        lengths = self.lengths[slots]
        ids = self.flat[ragged(self.starts[slots], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of runs of ids, without the blank that encoding puts in front."""
        sizes = self.raw_lengths[ids]
        data = self.raw[ragged(self.raw_starts[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """This worker's coder for a model file."""
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode_decode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and the text ``decoded`` from those ids, for every row.

    A null text counts as empty and has no ids. Rows are handled one by one, so repeated ids and
    rows stay; other columns are ignored. Nothing is shuffled.
    """
    path = path or default_path()
    small_batches(documents.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for part, _, _ in text_slices(batches, "text"):
            ids, lengths = own.encode([t or "" for t in part.column(1).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(own.decode(ids, lengths), pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        coded, "doc_id long, ids array<int>, decoded string"
    )


def digest_columns(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
