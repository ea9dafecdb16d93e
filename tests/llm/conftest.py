from __future__ import annotations

import pytest
from made import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def source():
    import public_tokenizers

    from flowrhythm.llm.tokens import read_source

    return read_source(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, equal ids, and columns whose names operators use inside."""
    rows = [(1, None), (2, ""), (3, "   "), (4, "One."), (None, "No id here, but some words are."), (5, "x" * 30_000), (6, prose(1, 8000)), (7, prose(2, 80)), (7, prose(2, 80)), (7, prose(3, 60)), (8, prose(2, 80)), (None, None)]
    schema = DOCS + ", shard int, slot int, score double, `range` int, id string, of string, fingerprint string, spans string, kept_id int, length int, `rank` int, k1 long, band long"
    return spark.createDataFrame([(i, t, None, "s", None, 9, 9, 0.5, 1, "a", "b", "c", "d", 3, 4, 5, 6, 7) for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
