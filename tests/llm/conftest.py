import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, ids string, spans string, items string, fp string, base string, score string, n_bytes string, sequence string, decoded string"


def rows(texts):
    """(doc_id, text) pairs as rows with extra columns under the names of outputs."""
    return [(d, t, None if t is None or k % 4 == 3 else ("en", "fr")[k % 2], None, None, *["extra"] * 10) for k, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge_texts():
    """Null, empty, blank, long, repeated and tied rows, special strings, other scripts."""
    long = " ".join(f"word{k % 977} tail" for k in range(40_000))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "Hello world, it's 2024!"), (4, "Hello world, it's 2024!"), (5, long), (6, "a" * 30_000), (7, "<|endoftext|> and <|ENDOFTEXT|> <|startoftext|>x"),
        (None, "no id here at all"), (8, "Übergrößenträger naïve café 東京都 🙂🙂    end"), (9, "x\x1cy  z　w ...!!!  ,,;"), (10, "one two three"), (11, "one two three"), (11, "another text under the same id"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    return spark.createDataFrame(rows(edge_texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
