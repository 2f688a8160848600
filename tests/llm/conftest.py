import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, bucket int, spans string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "naïve", "straße", "中文", "x1"]
    long_text = " ".join(words[(i * i + i // 7) % len(words)] + str(i % 97) for i in range(30_000))
    texts = [None, "", " \n\t ", "1234 !!", "A", long_text, "one two three four five six seven", "one two three four five six seven", "É" * 500]
    rows = [(i, t, "en" if i % 2 else None, None, None if t is None else len(t), 0.5, "f", 1, "s") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "one two three four five six seven", "fr", "a", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
