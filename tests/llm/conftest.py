from __future__ import annotations

import pytest

#: Rows every text operator has to take: null, empty, blank, ties, repeats, very long.
ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "Ünïcode wörter — and ASCII"),
    (6, "same text twice"),
    (6, "same text twice"),
    (7, "same text twice"),
    (None, "no id"),
    (8, "word " * 30_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with columns whose names clash with those operators add."""
    rows = [(i, t, "row", 1, "x", [2]) for i, t in ODD_TEXTS]
    kind = "doc_id long, text string, row string, n_words int, id string, hits array<int>"
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Write DataFrames as the tables of a folder that a registered query can read."""

    def write(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(str(path / f"{name}.parquet"))
        return str(path)

    return write
