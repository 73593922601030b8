import pytest

SCHEMA = "doc_id bigint, raw_text string, language string, size int, shard string, code int, n int, row string"


@pytest.fixture(scope="session")
def odd_jobs(spark):
    """Nulls, empty and very long texts, equal and repeated rows, and columns named like inner ones."""
    words = "the meeting of the board was opened by the chair and every member heard the report".split()
    texts = [None, "", "   ", "\n", "word", "é ñ ß", "a b", "12 34", "it's <|endoftext|> done", " ".join(words), " ".join(words), " ".join(words).upper(),
             " ".join(words[i % 15] + str(i) for i in range(60_000)), "spam " * 4000, "日本語 テキスト", "x" * 30_000]
    rows = [(i, t, "en" if i % 2 else None, 1, "s", 2, 3, "r") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "null id one", "en", None, None, None, None, None), (None, " ".join(words), None, 0, "", 0, 0, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_jobs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
