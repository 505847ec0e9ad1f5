import pytest

PASSAGE = "Cold rain fell on the harbour all night and the boats pulled hard at their lines while the watch slept below, dreaming of warm bread, dry socks and a fair wind for the morning tide, " * 2


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long_text = " ".join(f"word{i % 5000}x{i}" for i in range(60_000))
    rows = [
        (1, PASSAGE + "\nAnother line of the first text here.\n\nEnd of it."),
        (2, None),
        (3, ""),
        (4, "word"),
        (5, long_text),
        (6, PASSAGE + "\nAnother line of the first text here.\n\nEnd of it."),
        (None, PASSAGE),
        (7, " \n \t\n"),
        (8, "one two three"),
        (8, "one two three"),
        (9, "ÄÖ ß 日本語 \u0000 x y " * 30),
        (None, None),
    ]
    # Names that the operators use themselves.
    extra = ["uid", "score", "ids", "spans", "root", "doc", "rid", "no_id", "dead", "kept", "rejected", "_score", "_doc", "_rid", "_spans", "_dead", "_text", "salt", "n", "anchor"]
    full = [(i, t, "en", "s", len(t or ""), *extra) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in extra))


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
