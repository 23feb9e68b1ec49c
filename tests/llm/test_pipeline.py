import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from brute import near_duplicates, secret_spans
from vitalsift.llm import words
from vitalsift.llm.common import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    vocabulary = {"en": ["the", "of", "and", "ing", "word"], "de": ["der", "und", "ung", "schön", "für"]}
    texts = []
    for _ in range(60):
        lang = rng.choice(["en", "de"])
        base = [rng.choice(vocabulary[lang]) + rng.choice("abcdefgh") for _ in range(rng.randint(6, 80))]
        texts.append((" ".join(base), lang))
        if rng.random() < 0.4:
            copy = list(base)
            copy[-1] = "changed"
            texts.append((" ".join(copy), lang))
    texts += [(None, "en"), ("", "en"), ("12 34 !!", None), ("token = abcdef123456 is what these words hide today", "en"),
              ("a clean text with the word token in it", None), ("0123456789abcdef0123456789abcdef and other words", "en")]
    return [(k, t, lang, "s", len(t or "")) for k, (t, lang) in enumerate(texts)]


def redacted(text):
    out, done = "", 0
    for a, b, _ in secret_spans(text):
        if a >= done:
            out += text[done:a] + "[SECRET]"
        done = max(done, b)
    return out + text[done:]


@pytest.fixture(scope="module")
def stages(spark):
    """The documents after each stage, written and read again."""
    work = Workspace(spark, "stages")
    docs = work.store("documents", spark.createDataFrame(corpus(), SCHEMA))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = work.store(name, stage(spark, docs, work.folder))
        out.append(docs)
    return work, out


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_stages_equal_the_plain_versions(stages):
    _, (documents, with_language, without_copies, without_secrets, packed) = stages
    rows = corpus()
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    found = rows_of(with_language)
    assert [r[:2] + r[3:] for r in found] == [r[:2] + r[3:] for r in kept]
    assert all(r[2] in ("en", "de") for r in found) and all(a[2] == b[2] for a, b in zip(found, kept, strict=True) if b[2])
    groups = near_duplicates([r[:2] for r in kept])
    expected = [r for r in found if groups[r[0]][1] == r[0]]
    assert rows_of(without_copies) == expected and len(expected) < len(kept)
    clean = [(r[0], redacted(r[1]), *r[2:4], len(redacted(r[1])) if redacted(r[1]) != r[1] else r[4]) for r in expected]
    assert rows_of(without_secrets) == clean and clean != expected
    for a, b in zip((documents,) * 3, (with_language, without_copies, without_secrets), strict=True):
        assert b.dtypes == a.dtypes
    library = Tokenizer.from_file(words.default_path())
    ids_of = {r[0]: library.encode(r[1], add_special_tokens=False).ids + [2] for r in clean}
    taken = dict.fromkeys(ids_of, 0)
    for p in sorted(packed.collect(), key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == taken[p["doc_id"]]
        own = np.array(ids_of[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert p["ids_crc32"] == zlib.crc32(own.tobytes())
        taken[p["doc_id"]] += p["length"]
    assert taken == {k: len(v) for k, v in ids_of.items()}


def test_run_applies_all_stages(spark, stages, tmp_path):
    work, out = stages
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path))) == rows_of(out[-1])


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
