"""Registered queries against their SQL on the smallest tables, and independence of the parts."""

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import queries as core

D = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.skipif(not Path(D).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    mine, sql = entry.queries()[name](spark, D).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    cell = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(list(v)) if hasattr(v, "tolist") else str(v)
    norm = lambda df: sorted(str([cell(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert norm(mine) == norm(sql)


@pytest.mark.skipif(not Path(D).exists(), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "weftline").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("weftline.llm") for n in names), p
