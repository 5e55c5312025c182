import pytest

LONG = " ".join(f"w{i % 977} the of" for i in range(30_000))


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing columns."""
    text = "The quick brown fox and the lazy dog went to the market in the morning of that day."
    rows = [
        (1, text, "en", "a", 1, "x"), (2, text, "en", "a", 1, "x"), (2, text, "en", "a", 1, "x"),
        (3, None, None, None, None, None), (4, "", "en", "b", 0, "x"), (5, LONG, "en", "a", 9, "x"),
        (None, "No key at all, yet the words of this text are read.", "en", "b", 5, None),
        (6, " \n\t ", "de", "b", 3, "x"), (7, "ÀÉ été l'œuvre <|endoftext|> 你好 ́x", "fr", "c", 2, "x"),
        (8, "!!! ### $$$", None, "c", 2, "x"),
        (9, "Der Hund und die Katze sind in dem Haus mit der Maus.\n" * 3, "de", "c", 2, "x"),
    ]
    frame = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score string"
    )
    for name in ("kept", "size", "node", "row", "_key", "_hash", "slot", "block", "n_words", "c0", "bits", "_text"):
        frame = frame.withColumn(name, frame["score"])
    return frame


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
