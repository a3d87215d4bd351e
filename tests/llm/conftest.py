import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "nu", "xi", "omi", "pi"]


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x % len(WORDS)] + str(x % 97))
    return " ".join(out)


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    base = prose(1, 300)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " tail", "en", "b", 2), (4, prose(2, 300), None, None, None), (5, None, "en", "a", 0),
        (6, "", "de", "b", 0), (7, "  \n\t ", "de", "b", 0), (8, "one two three", "fr", None, 3), (9, prose(3, 20000), "en", "a", 9),
        (None, prose(4, 120), "en", "a", 1), (10, prose(5, 80), "en", "c", 1), (10, prose(5, 80), "en", "c", 1), (11, "é\x1cß <|endoftext|>\n\n日本 " + prose(6, 90), "en", "a", 1),
        (12, "spam " * 300, "en", "a", 1), (13, prose(7, 60) + " " + base[:900] + " " + prose(8, 60), "en", "a", 1),
    ]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, stats string, size string, digest string")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.where("false")
