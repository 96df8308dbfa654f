import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from brute import SF, prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality int, words string, ids string, node long, bucket long"


@pytest.fixture(scope="session")
def corner_rows():
    """Ids and texts: nulls, blanks, one word, ties, repeated rows, exact and near copies, a very long text."""
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base),
        (2, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \t\n\v\f\r "),
        (7, "one"),
        (8, "one"),
        (9, prose(3, 40) + " " + passage + " " + prose(4, 40)),
        (10, prose(5, 30) + "\n" + passage.upper()),
        (11, prose(6, 30_000)),
        (12, "!!! ### 123 日本 ééé"),
        (None, prose(7, 30)),
        (None, None),
        (13, "a b c d"),
    ]


@pytest.fixture(scope="session")
def corner(spark, corner_rows):
    """The same as a table in which other columns are null and bear names that operators use inside."""
    rows = [(i, t, None, None, None, None, "x", "y", 1, 2) for i, t in corner_rows]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
