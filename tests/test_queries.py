import sys
from pathlib import Path

import pytest

pytest.importorskip("duckdb")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from voxtree.plans import growing_queries, problem_queries, reference_queries  # noqa: E402

NAMES = [*problem_queries.QUERIES, *reference_queries.QUERIES, *growing_queries.QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, name):
    import compare

    rows, wrong = compare.differences(spark, data, name, compare.connect(data))
    assert not wrong
    assert rows > 0 or name in ("chain_filter", "chain_connect")
