"""Every query with SQL gives what a second engine gives, on the smallest tables; the rest runs."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from inkloom.plans import catalog, pipelines  # noqa: F401


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def value(v):
    if v is None or v != v:
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, db, name):
    got = catalog.QUERIES[name](spark, small)
    want = db.sql(catalog.ORACLE[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    mine = sorted((tuple(value(r[c]) for c in names) for r in got.collect()), key=repr)
    assert mine == sorted((tuple(value(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_core_does_not_import_llm():
    import ast
    from pathlib import Path

    import inkloom

    root = Path(inkloom.__file__).parent
    for f in root.rglob("*.py"):
        if root / "llm" in f.parents:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            if isinstance(node, ast.ImportFrom):
                assert not (node.module or "").startswith("inkloom.llm"), f
