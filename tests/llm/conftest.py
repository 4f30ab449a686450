import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def vocabulary():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]


@pytest.fixture
def prose(vocabulary):
    def make(n, seed, per_line=12):
        r = random.Random(seed)
        words = [r.choice(vocabulary) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))

    return make


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) or (doc_id, text, source) as a documents table with columns that clash with operators' own."""
    clashing = ["size", "kept", "gone", "fp", "label", "h", "n", "d", "key", "spans", "starts", "start", "body", "v", "c", "component_id", "n_words", "rank", "at"]

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None, *clashing) for r in rows]
        return spark.createDataFrame(full, DOCS + "".join(f", {c} string" for c in clashing))

    return make
