"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from quill import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0 or name == "secret_hits"


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["pricing_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "l_comment" not in plan and "l_orderkey" not in plan.split("ReadSchema")[1]


def test_entry_works_without_the_training_subpackage(tmp_path):
    """The driver contract imports and lists the other queries where the training-data folders are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("quill", "__spark_entry__.py"):
        src = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "quill" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n[:2] == 'op' and n[2:3].isdigit() or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_queries_run_from_any_folder(tmp_path):
    """Python workers get the sources from the session, wherever the driver was started and without a path of their own."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; from quill.session import local_session; s = local_session('far', cores=2); assert e.queries()['html_to_text'](s, {SF!r}).count() > 0; e.entry(s).show(1)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
