import pytest

LONG = "word " * 30_000
PASSAGE = " ".join(f"p{i}x" for i in range(60)) + " shared by many."


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, blanks, repeats, a long text, extra columns whose names clash with the operators' own."""
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, "b", 4),
        (4, "The cat sat on the mat and looked at the dog for a while.", "en", None, 57),
        (4, "The cat sat on the mat and looked at the dog for a while.", "en", None, 57),
        (5, "the CAT sat on the mat and looked at the dog for a while.", "en", "b", 57),
        (6, LONG, "en", "a", len(LONG)),
        (7, "one two", "xx", "c", 7),
        (8, "one two", "xx", "c", 7),
        (9, "übergroße Straße und schöne Häuser, auf der Straße", "de", "c", 50),
        (None, "no id here", "en", "a", 10),
        (10, "first line\n" + PASSAGE + "\nlast words of ten", "en", "a", 1),
        (11, PASSAGE + "\nlast words of eleven", "en", "b", 1),
        (12, "🙂🙂 123 !!! ||| \x00 end", None, "", 20),
    ]
    clash = ("n_words", "spans", "items", "quality_score", "size", "taken", "target", "source_size", "key", "score", "n_lines", "n_dropped", "n_tokens", "held", "node", "label")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame([(*r, *(["z"] * len(clash))) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
