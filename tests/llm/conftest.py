import pytest

LONG = "wordy text of some length " * 4000
TEXTS = [
    "The quick brown fox jumps over the lazy dog near the river bank.",
    "The quick brown fox jumps over the lazy dog near the river bank.",
    "",
    None,
    "   \t\n ",
    "!!! ??? 12345",
    "Ünïcödé wörds çà et là, ß und Ä; ĸ K İ ſ",
    "one",
    LONG,
    LONG + " tail",
    "mail a.b@c.example.org or +1 (456) 555-2186; token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\"",
    "Released under the MIT License. mit license MIT-License",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeats, repeated and null ids, and extra columns whose names clash with results."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i != 4 else None, len(t or ""), 7, "x") for i, t in enumerate(TEXTS)]
    rows += [(0, TEXTS[0], "en", "s0", 1, 7, "x"), (None, "no id at all here", None, None, None, 7, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens int, component_id string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id < 0")
