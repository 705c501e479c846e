"""Rows for the tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, fp long, cid long, carried string, starts string, word string"


def make_docs(spark, texts, first=0, lang=None):
    """Rows with columns whose names clash with the operators' own."""
    rows = [(first + k, t, lang[k] if lang else None, f"src{k % 3}", None if t is None else len(t), 1, 2, 3, "x", "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", ".", "é"]) for _ in range(n)]
