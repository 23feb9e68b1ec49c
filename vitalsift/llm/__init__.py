"""Operations of a training-data pipeline: language, duplicates, private data, tokens, archives.

Nothing outside this package, its tests and ``corpus_pipeline`` imports it.
"""
