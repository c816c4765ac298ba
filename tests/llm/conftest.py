import pytest

LONG = " ".join(f"w{k}" for k in range(30_000))
PASSAGE = " ".join(f"passage{k}" for k in range(60))
TAIL = " ".join(f"tail{k}" for k in range(60))
NEAR = " ".join(f"near{k}" for k in range(100))

#: Nulls, empty and very long texts, ties, repeated rows, a null id, and control characters.
ROWS = [
    (1, "", "en", "a"),
    (2, None, "en", "a"),
    (3, LONG, "en", "a"),
    (4, LONG, "en", "a"),
    (5, "same words", None, None),
    (6, "same words", None, None),
    (7, f"before {PASSAGE} after that", "en", "b"),
    (8, f"other {PASSAGE} words\n\n  end {TAIL}", "en", "b"),
    (9, NEAR, "en", "b"),
    (10, NEAR.replace("near50 ", ""), "en", "b"),
    (11, "the " * 400, "en", "c"),
    (12, " \t\n", "en", "c"),
    (13, "é x\x00\x1cy 'S <|endoftext|> 日本語  \r\n+1 (603) 555-8791 a.b@c.example.com 10.0.0.1 4111 1111 1111 1111", "fr", "c"),
    (14, "aaaa" * 200, "en", "c"),
    (15, "x" * 70_000, "en", "c"),
    (16, "b1 b2 b3 b4 b5", "en", "d"),
    (17, "B1 b2\tb3 b4 b5", "en", "d"),
    (18, "a b c", "en", "d"),
    (18, "a b c", "en", "d"),
    (None, "a null id with words", "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string, key string, spans int, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above, with further columns whose names the operators use inside."""
    rows = [(*r, "k", 7, None if r[1] is None else len(r[1])) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(text):
    return (text or "").encode().lower()
