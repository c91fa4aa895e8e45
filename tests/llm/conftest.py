import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows with nulls in every column, empty and long texts, repeated rows and ids, and columns whose names clash with results'."""
    texts = ["The cat sat on the mat and looked at the dog. " * 30, "", None, "   \n\t ", "one", "le chat est sur la table et regarde le chien " * 12, "x" * 5000, "🙂 é ü <|endoftext|> don't  stop\n\n1234 ", "word " * 20_000]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], i) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[0], "en", "a", 1), (20, texts[0], None, None, None), (21, texts[0] + "extra", "en", "a", 3)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({"score": F.lit("mine"), "fp": F.lit(7), "_text": F.lit("t"), "kept": F.lit(1), "shard": F.lit(2), "weird `name`": F.lit(0)})


@pytest.fixture
def nothing(documents):
    return documents.limit(0)


@pytest.fixture(scope="session")
def bpe_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
