import pytest

#: Rows that every operator must take: empty, null, long, repeated and tied ones.
ODD_TEXTS = ["", None, " ", "\n", "a", "A b", "x" * 5000, "word " * 4000, "émoji 🙂 ça va", "tab\tand  two", "  lead", "trail ",
             "same text", "same text", "don't we'll I'd\n\n\nnew", "1234 5678", "\x1c odd \x85 space", "\0 nul", "<|endoftext|>"]


@pytest.fixture()
def odd_docs(spark):
    rows = [(k, t, "x", "y", 7) for k, t in enumerate(ODD_TEXTS)]
    rows += [(None, "null id", None, None, None), (3, "again id", "x", "y", 1), (3, "again id", "x", "y", 1)]
    # clashing names: what operators call their own columns
    return spark.createDataFrame(rows, "doc_id bigint, text string, fp string, part string, n bigint")


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
