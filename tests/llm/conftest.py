import os

import pytest

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables not present")
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, blanks, repeated rows and ids, one very long text, and columns with the operators' own names."""
    words = [f"word{i % 700}x{i}" for i in range(30_000)]
    plain = " ".join(f"plain{i}" for i in range(80))
    rows = [
        (1, None), (2, ""), (3, " \t\n \x0b"), (4, "one two"), (4, "one two"), (4, "another text"), (None, plain),
        (None, None), (5, plain), (6, plain + " more"), (7, " ".join(words)), (8, "Ünïcödé ça \U0001f600 " * 30), (9, "1 2 3 !!"),
    ]
    rows = [(i, t, "en", "s", 0, "clash", 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(rows, SCHEMA + ", fingerprint string, shard int, words int, doc int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)
