import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_rows import ROWS  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows with columns whose names clash with those the operators make."""
    rows = [(d, t, "en", "s", 0, "a", 1, 2.0, True) for d, t in ROWS]
    names = "doc_id long, text string, lang string, source string, n_chars long, ids string, node int, score double, kept boolean"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
