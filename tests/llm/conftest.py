import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(9000))
BASE = " ".join(f"base{i}" for i in range(120))
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "two words",
    "same words here again " * 40,
    "same words here again " * 40,
    BASE,
    BASE,
    BASE.replace("base60", "other"),
    "Intro line first.\n" + BASE + "\nlast line",
    LONG,
    LONG[: len(LONG) // 2] + " changed " + LONG[len(LONG) // 2 :],
    "ünïcödé   text\xa0with 漢字かな and 😀 emoji \u0085 end",
    "a b a b a",
    "line one\nline one\n\nline two\nline one",
    "| # | % <b> &&& $$$ " * 20,
    "x" * 5000,
    "<|endoftext|> in a text</s>[INST] \\l \\b \\\\",
]


@pytest.fixture(scope="session")
def corner(spark):
    """Nulls in every column, repeated rows, ties and columns with clashing names."""
    rows = [
        (i, text, ["b", "a", None][i % 3], 1, "n", 2.0, [1], 3) for i, text in enumerate(TEXTS)
    ]
    rows += [rows[7], rows[7], (None, BASE, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None)]
    schema = (
        "doc_id long, text string, source string, n int, node string, size double, "
        "tokens array<int>, component_id int"
    )
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def empty(corner):
    return corner.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
