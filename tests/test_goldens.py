"""Every hand-made case gives its results."""

import duckdb
import pytest
from goldens import CASES
from test_queries import cell


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    case, sql = CASES[name]
    frame = case(spark, "")
    found = duckdb.sql(sql)
    assert sorted(found.columns) == sorted(frame.columns)
    want = sorted(tuple(cell(v) for v in r) for r in found.fetchall())
    assert want and sorted(tuple(cell(r[c]) for c in found.columns) for r in frame.collect()) == want
