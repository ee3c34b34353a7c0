import ast
import datetime
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from portolan.plans import catalogue
from portolan.session import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{sf}/{f}'")
    return c


def cell(v):
    if isinstance(v, (datetime.date, pd.Timestamp)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, float):
        return "-" if pd.isna(v) else f"{v:.6f}"
    return "-" if v is None or v is pd.NaT or v is pd.NA else str(v)


def sorted_rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(map(cell, r)) for r in pdf[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_same_as_sql(spark, sf, db, name):
    mine, theirs = catalogue.queries()[name](spark, sf).toPandas(), db.execute(catalogue.oracle_sql()[name]).df()
    a, b = sorted_rows(mine), sorted_rows(theirs)
    assert a[0] == b[0]
    assert [len(a[1]), *a[1][:3]] == [len(b[1]), *b[1][:3]]
    assert a[1] == b[1]


def test_entry(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and os.path.isabs(shared_dir(spark).removeprefix("file://"))


def test_works_without_the_subpackage(tmp_path):
    """The entry module imports, and lists the library's own queries, where the llm folders are gone."""
    import shutil

    shutil.copytree(f"{ROOT}/portolan", tmp_path / "portolan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q, any(k.startswith('op') for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(catalogue.queries())), str(len(catalogue.oracle_sql())), "False", "False"], out.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(f"{ROOT}/portolan"):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                for n in ast.walk(ast.parse(open(f"{folder}/{f}").read())):
                    names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
                    assert not any("portolan.llm" in x for x in names), f"{folder}/{f}"
