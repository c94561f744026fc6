import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "the cat sat on the mat and looked at the dog " * 12, "en"), (2, "the cat sat on the mat and looked at the dog " * 12, "en"), (2, "the cat sat on the mat and looked at the dog " * 12, "en"),
        (3, None, None), (4, "", "en"), (5, " \n\t ", None), (6, "one two", "en"), (None, "one two", "en"), (7, "<|endoftext|> it's   done▁x é 日本 ", "fr"),
        (8, "x" * 5000, None), (9, " ".join(f"w{i}" for i in range(3000)), "en"), (10, " ".join(f"w{i}" for i in range(3000)) + " tail", "en"), (None, None, None),
    ]
    full = [(i, t, lang, None if i is None else f"s{i % 2}", i, "a", "b", 1, None) for i, t, lang in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, id long, row string, gone_id string, tag long, node string")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.limit(0)
