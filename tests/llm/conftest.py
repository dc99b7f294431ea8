import pytest

#: Columns whose names operators use inside.
CLASHING = ("row", "fp", "own", "k", "score", "bin", "range", "guest", "template", "size", "target", "part", "c0", "source_size", "stays")


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text, source) rows, with columns that clash with names inside operators."""

    def build(rows, extra=CLASHING):
        kind = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
        full = [(i, t, None, s, len(t or ""), *["x"] * len(extra)) for i, t, s in rows]
        return spark.createDataFrame(full, kind)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, ties, repeated rows and a very long text."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    text = "the quick brown fox jumps over the lazy dog and runs away"
    return [
        (1, text, "a"), (2, text, "a"), (2, text, "a"), (3, None, "b"), (4, "", "b"), (None, "one two three", None), (None, None, None),
        (5, "  \n\t ", "a"), (6, long, "c"), (7, "émigré ß 中文 text\r\nwith lines\n\n\nand more", "c"), (7, "another text of the same id", "c"),
        (8, "<|endoftext|> is plain text", ""),
    ]
