import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["the", "of", "and", "Zebra", "naïve", "straße", "日本", "x1", "42", "end.", "foo\tbar", "😀"]
    texts = [None, "", " ", "\n\n", "a", "A", "a b", "a b c", "A B C", "▁x  y", "\x00 z", "word " * 3000, "z" * 900]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [t + " more" for t in texts[-20:] if t] + texts[-10:]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, "a b c", None, None, 5), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def clashing(awkward):
    """Extra columns whose names an operator may use inside."""
    extra = ["digest", "fp", "node", "bucket", "text_sha256", "keep_id", "kept", "size", "target", "line", "pos", "n_tokens", "spans", "_found", "score"]
    return awkward.selectExpr("*", *[f"'clash' AS {c}" for c in extra])


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], DOCS)
