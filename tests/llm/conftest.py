import string

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, cls string, label int, block int, _row int, n long, word string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]) with further columns whose names operators use themselves."""
    def build(rows):
        filled = []
        for r in rows:
            doc_id, text, lang, source = (*r, *("en", "src")[len(r) - 2:])
            filled.append((doc_id, text, lang, source, None if text is None else len(text), 1, "k", "c", 2, 3, 4, 5, "w"))
        return spark.createDataFrame(filled, DOCS)
    return build


@pytest.fixture(scope="session")
def prose():
    """Prose of made-up words: prose(n, seed) has n words, different for each seed."""
    import random

    def build(n, seed=0):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 7))) for _ in range(n))
    return build
