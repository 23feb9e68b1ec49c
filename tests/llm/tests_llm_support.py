"""Rows that every operator on documents must take: nulls, empty and long texts, ties, extra columns."""

from __future__ import annotations

# Columns beyond doc_id and text have names that operators use inside.
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, spans string, key string, id long, comp long, _range int, score double"


def edge_rows() -> list[tuple]:
    texts = [
        None, "", " ", "\n\t ", "word", "Two words", "the same five words here again", "the same five words here again",
        "THE SAME FIVE WORDS HERE AGAIN", "é ü 漢字 😀", "x" * 50_000, "many words in a long text " * 8_000,
        "1234567890 " * 2_000, "!!! ... ???", "\x00 control \x1f marks", "password: hunter2hunter2",
    ]
    rows = [(k, t, None, None, None, None, None, None, None, None, None, None) for k, t in enumerate(texts)]
    filled = lambda k, t: (k, t, "en", "src", 3, "d", "s", "k", 1, 2, 3, 0.5)
    rows += [filled(100 + k, t) for k, t in enumerate(texts)]
    # A repeated row and a row without an id.
    return [*rows, rows[6], filled(None, "no id but some words in it")]
