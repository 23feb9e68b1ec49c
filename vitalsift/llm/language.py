"""Language of whole texts by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes. A network reads each window from both ends; at every
position the two states give a probability for each language, and a document's probabilities are
the means over all its positions. States are gated: with f the sigmoid and g the tanh of
a byte's column plus a matrix times the last state h, the next state is h + f (g - h).

The network is trained in numpy by backpropagation through time, on the driver, from a bounded
sample: at most ``SAMPLE_DOCUMENTS`` documents per language, picked by hash over all labelled rows, with
``SAMPLE_WINDOWS`` windows spread over each whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalsift.llm.common import small_batches, text_slices

WINDOW = 128
HIDDEN = 8
#: Bounds of the training sample: documents per language, windows per document.
SAMPLE_DOCUMENTS = 400
SAMPLE_WINDOWS = 6
STEPS = 240
BATCH = 192
BATCH_WINDOWS = 2048
UNKNOWN = "und"
PAD = 256
SYMBOLS = 257


def folded_bytes() -> np.ndarray:
    """Bytes with case folded: A-Z, and second bytes of Latin capitals; digits are one symbol."""
    fold = np.arange(SYMBOLS)
    fold[ord("A") : ord("Z") + 1] += 32
    fold[ord("0") : ord("9") + 1] = ord("0")
    fold[0x80:0xA0] += 0x20
    return fold


FOLD = folded_bytes().astype(np.int16)


@dataclass
class Network:
    """Parameters: for each direction byte columns and state matrix, then the output layer."""

    languages: list[str]
    columns: list[np.ndarray]
    matrices: list[np.ndarray]
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        of = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        return cls(
            languages, [of(2 * hidden, SYMBOLS) for _ in range(2)], [of(2 * hidden, hidden) for _ in range(2)],
            of(len(languages), 2 * hidden), np.zeros((len(languages), 1), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.columns, *self.matrices, self.output, self.bias]


def read_states(columns: np.ndarray, matrix: np.ndarray, symbols: np.ndarray, keep: bool):
    """States after each position of windows in columns, and what training needs of them.

    The sigmoid is 0.5 + 0.5 tanh(x / 2), so one tanh serves gate and candidate.
    """
    length, n = symbols.shape
    hidden = matrix.shape[1]
    states = np.zeros((length + 1, hidden, n), np.float32)
    squashed = np.empty((length, 2 * hidden, n), np.float32) if keep else None
    scale = np.ones((2 * hidden, 1), np.float32)
    scale[:hidden] = 0.5
    columns, matrix = columns * scale, matrix * scale
    z = np.empty((2 * hidden, n), np.float32)
    gate = np.empty((hidden, n), np.float32)
    for t in range(length):
        before = states[t]
        np.matmul(matrix, before, out=z)
        z += columns.take(symbols[t], axis=1)
        np.tanh(z, out=z)
        np.multiply(z[:hidden], 0.5, out=gate)
        gate += 0.5
        if keep:
            squashed[t] = z
        step = z[hidden:]
        step -= before
        step *= gate
        np.add(before, step, out=states[t + 1])
    return states, squashed


def position_odds(network: Network, symbols: np.ndarray, keep: bool = False):
    """Probabilities (languages, positions, windows) of windows in columns."""
    forward, f_kept = read_states(network.columns[0], network.matrices[0], symbols, keep)
    backward, b_kept = read_states(network.columns[1], network.matrices[1], symbols[::-1], keep)
    length, n = symbols.shape
    # A position sees the state after it from the left and after it from the right.
    both = np.concatenate([forward[1:], backward[:0:-1]], axis=1)
    logits = np.matmul(network.output, both) + network.bias
    logits -= logits.max(axis=1, keepdims=True)
    odds = np.exp(logits, out=logits)
    odds /= odds.sum(axis=1, keepdims=True)
    return odds, (both, forward, f_kept, backward, b_kept)


def _state_gradients(matrix, states, squashed, symbols, incoming):
    """Gradients of byte columns and matrix, from gradients of the states, last to first."""
    length, n = symbols.shape
    hidden = matrix.shape[1]
    d_columns = np.zeros((2 * hidden, SYMBOLS), np.float32)
    d_matrix = np.zeros_like(matrix)
    d_inputs = np.empty((length, 2 * hidden, n), np.float32)
    flowing = np.zeros((hidden, n), np.float32)
    for t in range(length - 1, -1, -1):
        flowing = flowing + incoming[t]
        gate, candidate, before = 0.5 + 0.5 * squashed[t, :hidden], squashed[t, hidden:], states[t]
        d = d_inputs[t]
        d[:hidden] = flowing * (candidate - before) * gate * (1 - gate)
        d[hidden:] = flowing * gate * (1 - candidate**2)
        d_matrix += d @ before.T
        flowing = flowing * (1 - gate) + matrix.T @ d
    flat = symbols.ravel()
    for k in range(2 * hidden):
        d_columns[k] = np.bincount(flat, d_inputs[:, k].ravel(), SYMBOLS)
    return d_columns, d_matrix


def gradients(network: Network, symbols: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over positions that are no padding, and its gradients."""
    odds, (both, forward, f_kept, backward, b_kept) = position_odds(network, symbols, keep=True)
    hidden = network.matrices[0].shape[1]
    real = (symbols != PAD).astype(np.float32)
    total = max(real.sum(), 1)
    chosen = odds[:, labels, np.arange(len(labels))]
    loss = float(-(np.log(np.maximum(chosen, 1e-9)) * real).sum() / total)
    d = odds
    d[:, labels, np.arange(len(labels))] -= 1
    d *= (real / total)[:, None, :]
    d_output = np.einsum("tcn,thn->ch", d, both, optimize=True)
    d_bias = d.sum(axis=(0, 2))[:, None]
    d_both = np.matmul(network.output.T, d)
    f = _state_gradients(network.matrices[0], forward, f_kept, symbols, d_both[:, :hidden])
    b = _state_gradients(network.matrices[1], backward, b_kept, symbols[::-1], d_both[::-1, hidden:])
    return loss, [f[0], b[0], f[1], b[1], d_output, d_bias]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 9) -> Network:
    """Fit a network to windows (one per row) by Adam with languages in equal shares.

    A third of the windows are cut to a few dozen bytes, as many texts are no longer.
    """
    network = Network.fresh(languages)
    rng = np.random.default_rng(seed)
    by_language = [np.flatnonzero(labels == k) for k in range(len(languages))]
    share = max(1, BATCH // len(languages))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in network.parameters()]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(own, share) for own in by_language])
        batch = windows[rows]
        ends = np.where(rng.random(len(rows)) < 1 / 3, rng.integers(8, WINDOW // 2, len(rows)), WINDOW)
        batch[np.arange(WINDOW) >= ends[:, None]] = PAD
        _, found = gradients(network, batch.T, labels[rows])
        size = np.sqrt(sum(float((g**2).sum()) for g in found))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(network.parameters(), found, moments, strict=True):
            g = g * min(1.0, 1.0 / max(size, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts as rows of symbols, their texts, and their numbers of bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[:-1][text] + inner * WINDOW
    length = np.minimum(WINDOW, offsets[1:][text] - begin)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    symbols = FOLD[padded[begin[:, None] + np.arange(WINDOW)]]
    short = np.flatnonzero(length < WINDOW)
    symbols[short] = np.where(np.arange(WINDOW) < length[short, None], symbols[short], PAD)
    return symbols, text, length


def document_odds(network: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities over all bytes of each text (texts, languages); zeros without bytes."""
    symbols, text, length = cut_windows(data, offsets)
    n_texts, n_languages = len(offsets) - 1, len(network.languages)
    total = np.zeros((n_texts, n_languages))
    for at in range(0, len(symbols), BATCH_WINDOWS):
        part = np.ascontiguousarray(symbols[at : at + BATCH_WINDOWS].T)
        odds, _ = position_odds(network, part)
        short = np.flatnonzero(length[at : at + BATCH_WINDOWS] < WINDOW)
        odds[:, :, short] *= (part[:, short] != PAD)[:, None, :]
        sums = odds.sum(axis=0, dtype=np.float64)
        for k in range(n_languages):
            total[:, k] += np.bincount(text[at : at + BATCH_WINDOWS], sums[k], n_texts)
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def is_held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: CRC-32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


SAMPLE = "lang string, order long, tie long, windows array<binary>"
_ARROW_SAMPLE = pa.schema([
    ("lang", pa.string()), ("order", pa.int64()), ("tie", pa.int64()), ("windows", pa.list_(pa.binary())),
])


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in text_slices(batches, "text"):
        windows = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            spots = np.unique(np.linspace(a, max(a, b - WINDOW), SAMPLE_WINDOWS).astype(int))
            windows.append([data[s : min(s + WINDOW, b)].tobytes() for s in spots])
        yield pa.RecordBatch.from_arrays(
            [part.column(0).cast(pa.string()), *part.columns[1:3], pa.array(windows, _ARROW_SAMPLE.field("windows").type)], schema=_ARROW_SAMPLE
        )


def _sample(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """``lang``, ``order`` and ``windows`` of one text per row of ``picked``."""
    found = rows.join(F.broadcast(picked), ["lang", "order"]).select("lang", "order", F.xxhash64("text").alias("tie"), "text")
    least = F.min(F.struct("tie", "windows"))
    return found.mapInArrow(_sample_windows, SAMPLE).groupBy("lang", "order").agg(least.alias("least")).select(
        "lang", "order", "least.windows"
    )


def fit(documents: DataFrame, seed: int = 9) -> Network | None:
    """A network trained on the labelled documents that are not held out; None without any.

    Over all such rows, one document is picked per language and hash bucket: the one with the
    smallest hash. The buckets bound what is gathered: windows of ``SAMPLE_DOCUMENTS`` per language. Of rows with
    one id, or without any, the text with the smallest hash is taken once.
    """
    rows = documents.select(
        F.col("doc_id").cast("long"), F.col("text"), F.col("lang").cast("string").alias("lang")
    ).filter(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    rows = rows.withColumn("order", F.xxhash64("doc_id")).filter(has_letter(F.col("text")))
    picked = (
        rows.groupBy("lang", F.pmod("order", F.lit(SAMPLE_DOCUMENTS)).alias("bucket")).agg(F.min("order").alias("order"))
        .select("lang", "order")
    )
    found = sorted((r["lang"], r["order"], w) for r in _sample(rows, picked).collect() for w in r["windows"])
    if not found:
        return None
    languages = sorted({r[0] for r in found})
    windows = np.full((len(found), WINDOW), PAD, np.int16)
    for k, (_, _, raw) in enumerate(found):
        windows[k, : len(raw)] = FOLD[np.frombuffer(bytes(raw), np.uint8)]
    labels = np.array([languages.index(r[0]) for r in found])
    return train(windows, labels, languages, seed=seed)


def predict(
    documents: DataFrame, network: Network | None, columns: list[str], names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``columns`` of every row, its language, and the mean probability of that language.

    A text that is null or has no letter is ``und`` with score 0, as is every text when there
    was nothing to learn from. Whole texts are read, window by window, in bounded batches.
    ``names`` are those of the two new columns.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(*columns, F.when(has_letter(F.col("text")), F.col("text")).alias("_read"))
    if "text" in columns:
        # The text travels once; a flag says whether it is to be read.
        rows = documents.select(*columns, has_letter(F.col("text")).alias("_letters"))
    if network is None:
        return documents.select(*columns, F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]))
    source = "text" if "text" in columns else "_read"

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batches, source, 1 << 19):
            odds = document_odds(network, data, offsets)
            best = odds.argmax(axis=1)
            letters = np.diff(offsets) > 0
            if source == "text":
                letters = part.column(len(columns)).to_numpy(zero_copy_only=False).astype(bool)
            langs = [network.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
            scores = np.where(letters, odds[np.arange(len(best)), best], 0.0).clip(0, 1)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(k) for k in range(len(columns))], pa.array(langs, pa.string()), pa.array(scores)],
                names=[*columns, *names],
            )

    schema = documents.select(*columns).schema.add(names[0], "string").add(names[1], "double")
    return rows.mapInArrow(predicted, schema)


def filter_documents(documents: DataFrame) -> DataFrame:
    """``documents`` without those of no language (``und``); a missing lang becomes the predicted one."""
    language = "_language"
    while language in documents.columns or f"{language}_score" in documents.columns:
        language += "_"
    names = (language, f"{language}_score")
    found = predict(documents, fit(documents), documents.columns, names).filter(F.col(language) != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", language)).select(*documents.columns)


def identify(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every document.

    Learns from text and lang of rows that are not held out and predicts from the text alone. A null
    doc_id is not held out. Repeated rows are predicted alike; an empty table gives no rows; columns other than
    doc_id, text and lang are not read.
    """
    rows = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    found = predict(rows, fit(documents), ["doc_id"])
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
