"""Every registered query with SQL gives the rows that DuckDB gives; the others run and have rows."""

import math
from pathlib import Path

import duckdb
import pytest

from lectern.functions import cleaning
from lectern.plans import catalog, imports, pages, prepared  # noqa: F401

SF = "/root/testdata/sf0.001"
ALLOWED_EMPTY = {"mark_coverage"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 9))
    return str(int(v)) if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    frame = catalog.QUERIES[name](spark, SF)
    rows = frame.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    found = db.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(tuple(cell(v) for v in r) for r in found.fetchall())
    assert sorted(tuple(cell(r[c]) for c in columns) for r in rows) == want
    assert want or name in ALLOWED_EMPTY


def test_chunks_are_made_once(spark):
    plan = catalog.QUERIES["prepared_chunks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_turns_without_text_have_no_blocks(spark, tmp_path):
    texts = ["Hi there.", None, "", "  \n ", "- one\n\n- two"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = catalog.QUERIES["resegmented_documents"](spark, str(tmp_path)).orderBy("turn").collect()
    want = [cleaning.prepare(t or "")[1] for t in texts]
    assert [(r["blocks"], r["first_kind"]) for r in rows] == [(len(bs), bs[0].kind if bs else None) for bs in want]
    assert [len(bs) for bs in want] == [1, 0, 0, 0, 2]
