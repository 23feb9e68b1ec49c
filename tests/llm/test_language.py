import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_support import EDGE_SCHEMA, edge_rows
from vitalsift.llm import language

SYLLABLES = {
    "aa": ["ka", "to", "mi", "ra", "su"], "bb": ["str", "eng", "ouf", "lt", "gh"], "cc": ["é", "ñu", "ça", "ü", "öb"],
}


def corpus(n=360, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        text = " ".join(words)
        rows.append((k, text.upper() if k % 9 == 0 else text, lang if k % 10 else None))
    return rows


SCHEMA = "doc_id long, text string, lang string"


def test_sample_is_bounded_where_ids_repeat_or_are_null(spark, monkeypatch):
    given = []
    monkeypatch.setattr(language, "train", lambda windows, labels, languages, seed: given.append(sorted(map(bytes, windows.astype("<i2")))))

    def windows(rows):
        language.fit(spark.createDataFrame(rows, SCHEMA).repartition(5))
        return given[-1]

    unique = [(k, t, lang) for k, t, lang in corpus() if k != 1]
    missing = [(None, t, "aa") for _, t, _ in corpus(300, seed=2)] + [(None, "ka", "aa")] * 50
    repeated = [(1, t, "bb") for _, t, _ in corpus(300, seed=3)] * 2
    alone, more = windows(unique), windows(unique + missing + repeated)
    assert len(alone) <= len(more) + 2 * language.SAMPLE_WINDOWS
    assert len(more) <= len(alone) + 2 * language.SAMPLE_WINDOWS
    assert more == windows((unique + missing + repeated)[::-1])


def test_gradients_equal_differences():
    network = language.Network.fresh(["a", "b", "c"], hidden=3)
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 257, (7, 4))
    symbols[5:, 2] = language.PAD
    labels = np.array([0, 1, 2, 1])
    _, found = language.gradients(network, symbols, labels)
    for place, (p, g) in enumerate(zip(network.parameters(), found, strict=True)):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if place < 2:
                at = (at[0], int(symbols[rng.integers(0, 7), rng.integers(0, 4)]))
            old = p[at]
            p[at] = old + 1e-2
            above, _ = language.gradients(network, symbols, labels)
            p[at] = old - 1e-2
            below, _ = language.gradients(network, symbols, labels)
            p[at] = old
            assert abs((above - below) / 2e-2 - g[at]) < 2e-4


def test_windows_cover_whole_texts():
    texts = [b"", b"a", b"b" * 128, b"c" * 129, b"d" * 1000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    symbols, text, length = language.cut_windows(data, np.cumsum([0, *map(len, texts)]))
    for k, raw in enumerate(texts):
        own = symbols[text == k].ravel()
        assert (own != language.PAD).sum() == len(raw) == length[text == k].sum()
        assert (own[own != language.PAD] == language.FOLD[np.frombuffer(raw, np.uint8)]).all()


def test_document_odds_do_not_depend_on_neighbours():
    network = language.Network.fresh(["a", "b"])
    texts = [b"some text here", b"x" * 5_000, b"", b"another one " * 40]
    data = np.frombuffer(b"".join(texts), np.uint8)
    together = language.document_odds(network, data, np.cumsum([0, *map(len, texts)]))
    for k, raw in enumerate(texts):
        alone = language.document_odds(network, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert np.allclose(alone[0], together[k], atol=1e-5)
    assert together[2].sum() == 0 and np.allclose(together[[0, 1, 3]].sum(axis=1), 1, atol=1e-5)


@pytest.fixture(scope="module")
def identified(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    return {r["doc_id"]: r for r in language.identify(docs).collect()}


def test_held_out_accuracy(identified):
    truth = {k: lang for k, _, lang in corpus() if lang}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(identified[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in identified)
    right = sum(identified[k]["lang_pred"] == truth[k] for k in held)
    assert len(held) > 50 and right / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in identified.values())


def test_labels_of_held_out_rows_are_never_read(spark, identified):
    rows = [(k, t, "zz" if zlib.crc32(str(k).encode()) % 4 == 2 else lang) for k, t, lang in corpus()]
    again = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert again == identified


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_DOCUMENTS", 2)
    monkeypatch.setattr(language, "STEPS", 1)
    seen = {}
    monkeypatch.setattr(language, "train", lambda windows, labels, languages, seed: seen.update(n=len(windows), languages=languages))
    language.fit(spark.createDataFrame(corpus(), SCHEMA))
    assert seen["languages"] == ["aa", "bb", "cc"] and seen["n"] <= 2 * 3 * language.SAMPLE_WINDOWS


def test_edge_rows(spark):
    docs = spark.createDataFrame(edge_rows(), EDGE_SCHEMA)
    out = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert language.identify(docs).count() == len(edge_rows())
    for k in (0, 1, 2, 3, 12, 13, 100, 112):
        assert out[k]["lang_pred"] == "und" and out[k]["score"] == 0
    assert out[4]["lang_pred"] == out[9]["lang_pred"] == "en" and out[None]["held_out"] is False
    kept = language.filter_documents(docs)
    assert kept.dtypes == docs.dtypes and kept.count() == len(edge_rows()) - 12
    assert kept.filter(F.col("lang").isNull()).count() == 0


def test_nothing_to_learn_from(spark):
    assert language.identify(spark.createDataFrame([], EDGE_SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en")], SCHEMA)
    assert {r["lang_pred"] for r in language.identify(docs).collect()} == {"und"}
    assert language.filter_documents(docs).count() == 0


def plain_odds(network, raw):
    """Mean probabilities over a text's bytes, one byte and one unit at a time."""
    columns, matrices, output, bias = network.columns, network.matrices, network.output, network.bias
    hidden, total = matrices[0].shape[1], [0.0] * len(network.languages)
    symbols = [int(language.FOLD[b]) for b in raw]

    def states(side, window):
        """The state after each symbol, from zero."""
        state, found = [0.0] * hidden, []
        for symbol in window:
            row = [float(columns[side][k, symbol]) + sum(float(matrices[side][k, j]) * state[j] for j in range(hidden)) for k in range(2 * hidden)]
            gate = [1 / (1 + math.exp(-row[k])) for k in range(hidden)]
            state = [state[k] + gate[k] * (math.tanh(row[hidden + k]) - state[k]) for k in range(hidden)]
            found.append(state)
        return found

    for at in range(0, len(symbols), language.WINDOW):
        window = symbols[at : at + language.WINDOW]
        # The last window of a text is filled up, and the filling is read from the right first.
        filled = window + [language.PAD] * (language.WINDOW - len(window))
        left, right = states(0, window), states(1, filled[::-1])[::-1]
        for k in range(len(window)):
            both = [*left[k], *right[k]]
            logits = [float(bias[c, 0]) + sum(float(output[c, j]) * both[j] for j in range(2 * hidden)) for c in range(len(total))]
            odds = [math.exp(x - max(logits)) for x in logits]
            total = [t + o / sum(odds) for t, o in zip(total, odds)]
    return [t / len(symbols) for t in total]


def test_rows_equal_the_plain_network(spark):
    """The query's predictions against loops over bytes, with the network that it has learned."""
    docs = spark.createDataFrame(corpus(), SCHEMA)
    network = language.fit(docs)
    texts = {k: t for k, t, _ in corpus()[:12]} | {1_000: "Ka" * 200, 1_001: "é", 1_002: "ñu ça " * 40 + "1"}
    found = language.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), network, ["doc_id"])
    for row in found.collect():
        odds = plain_odds(network, texts[row["doc_id"]].encode())
        best = max(range(len(odds)), key=odds.__getitem__)
        assert row["lang_pred"] == network.languages[best] and abs(row["score"] - odds[best]) < 1e-3
    own = {r["doc_id"]: r for r in language.identify(docs).collect()}
    again = {r["doc_id"]: r for r in language.predict(docs, network, ["doc_id"]).collect()}
    assert {k: (r["lang_pred"], r["score"]) for k, r in own.items()} == {k: (r["lang_pred"], r["score"]) for k, r in again.items()}
