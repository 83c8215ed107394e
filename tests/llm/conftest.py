import pytest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, fp long, bucket string, chunk int, score string, pos int, shard int, hashes string"


def rows_of(pairs, lang="en"):
    return [(i, t, lang, "s", len(t or ""), 1, "b", 2, "x", 3, 4, "h") for i, t in pairs]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with further columns whose names clash with those used inside."""

    def build(pairs, parts=3, lang="en"):
        return spark.createDataFrame(rows_of(pairs, lang), EXTRA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls, empties, white space, one very long text, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "one two"), (6, long), (7, long), (7, long), (8, "É é ▁ \U0001f600 ß"), (None, "no id here at all"), (9, "a b c d e f g " * 30), (10, "x" * 200_000)]
