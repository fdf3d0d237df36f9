import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(90)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and blank texts, ties, repeated rows, a very long text, and columns with clashing names."""
    long = prose(1, 30_000)
    texts = [None, "", "   \n\t", "one", "one two three", prose(2, 60), prose(2, 60), prose(2, 58) + " changed words", long, long + " tail", "é ß Ñ 😀 日本語 text", prose(3, 40)]
    rows = [(i, t, "en" if i % 2 else None, "src0", i, "x", 7, 1.5) for i, t in enumerate(texts)] + [(5, texts[5], "en", "src0", 5, "x", 7, 1.5), (None, texts[11], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, rank long, score double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
