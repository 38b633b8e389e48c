import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, bytes string, rid string, token string, score string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of (doc_id, text) with further columns whose names the operators use inside."""

    def make(rows):
        rows = [(d, t, "en" if i % 2 else None, None if i % 3 else "s", None if t is None else len(t), "h", None, "r", "t", "s") for i, (d, t) in enumerate(rows)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, ties, repeated rows, a very long text, other scripts, null ids."""
    long = " ".join(f"word{i % 9973} other{i % 577}" for i in range(200_000))
    base = "The quick brown fox jumps over the lazy dog and then some more words follow here in this line. " * 8
    return [
        (1, base), (2, base), (2, base), (3, base + " with an ending"), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "one"), (9, "ONE two"), (10, long),
        (11, "Привет мир это текст " * 40), (12, "日本語のテキスト"), (13, "a b c d e"), (None, "a b c d e"), (None, base), (14, "x" * 3000), (15, "%%% ### !!!"), (16, "\x00\x1f odd \x7f bytes"),
    ]


def pytest_collection_modifyitems(items):
    items.sort(key=lambda i: "pipeline" in i.nodeid)
