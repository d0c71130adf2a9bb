import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

A = "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing softly in the tall green trees above them all day long."
B = A.replace("seven", "eight")
LONG = " ".join(f"word{i % 977} other{i % 31}." for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    rows = [
        (1, A, "en", "s0", len(A)), (2, A, "en", "s0", len(A)), (2, A, "en", "s0", len(A)), (3, B, None, "s1", None), (4, "", "en", "s0", 0), (5, None, None, None, None), (None, A, "en", None, 3),
        (6, LONG, "en", "s0", len(LONG)), (7, "  \n\t\n ", "en", "s1", 6), (8, "<|endoftext|> ünïcödé 中文字符 🙂 \u0085 x y", "de", "s1", 10), (9, "one two", "en", "s1", 7), (10, "one two", "en", "s1", 7), (11, "12345 !!! ???", "en", "s2", 13),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def store(tmp_path):
    """Writes tables the way the driver lays them out."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture(scope="session")
def clashing():
    """Adds columns named like those that operators add."""

    def add(df):
        from pyspark.sql import functions as F

        names = ("score", "sid", "n", "rate", "copy", "media", "held_out", "predicted", "fingerprint", "component_id", "sequence_id", "bucket", "gid", "tokens")
        return df.withColumns({c: F.lit("clash") for c in names})

    return add
