import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def odd_docs(spark):
    """Null, empty, blank, repeated, very long rows and extra columns with names the operators use."""
    rows = [
        (1, None, "src1", 5), (2, "", None, 6), (3, " \t\n ", "src1", 7), (4, "One two THREE four five six seven eight", "src2", 8),
        (4, "One two THREE four five six seven eight", "src2", 8), (5, "one two three four five six seven eight!", None, 9),
        (6, " ".join(f"w{i % 977}x{i}" for i in range(60_000)), "src1", 1), (7, "x" * 300_000, "src2", 2), (None, "no id here", "src3", 3),
    ]
    return spark.createDataFrame([(*r, "k", 1.5, True) for r in rows],
                                 "doc_id long, text string, source string, n_words long, hits string, score double, contaminated boolean")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
