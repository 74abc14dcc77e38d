import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed=0, shift=1):
    return " ".join(WORD[(seed + k * shift + k * k // 7) % len(WORD)] + str((seed + k) % 13) for k in range(n))


def odd_rows():
    """Nulls, empty, blank, short, very long, tied, repeated and near-copied texts; null and repeated ids."""
    long = prose(60_000, 3)
    base = prose(120, 5)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", "fr", None, 4), (4, "one two", "en", "s", 7), (5, "one two", "en", "s", 7), (6, "One  TWO", "de", "s", 8),
        (7, long, "en", "s", len(long)), (8, base, "en", "hot", 1), (9, base, "en", "hot", 1), (9, base, "en", "hot", 1), (10, " ".join(near), None, "hot", 1),
        (11, "ligne é è à MIT License\nLicensed under the Apache License, Version 2.0", "fr", "hot", 1), (12, "1234 5678 !!! ???", "en", "s", 1), (13, "<|endoftext|> x <|startoftext|>", "en", "s", 1),
        (14, "日本語 テキスト Σας İ ﬁ   x", "ja", "s", 1), (None, base + " tail", "en", "s", 1), (15, "repeat this line of eight words right now\n" * 40, "en", "s", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names clash with results."""
    from pyspark.sql import functions as F

    extra = {c: F.lit("clash") for c in ("n_words", "score", "key", "kept", "n_tokens", "component_id", "line", "start", "labels", "_key")}
    return spark.createDataFrame(odd_rows(), DOCS).withColumns(extra)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
