"""Every registered core query against its SQL, on the smallest tables; and the entry module without its optional part."""

import glob
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from circuitscope import queries as core

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(core.ORACLE_SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name, tmp_path):
    core.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    got, want = duck.execute(f"select * from read_parquet('{tmp_path}/out/*.parquet')").df(), duck.execute(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    frames = [f[columns].astype(object).where(f[columns].notna(), None).sort_values(columns, key=lambda c: c.astype(str)).reset_index(drop=True) for f in (got, want)]
    assert len(frames[0]) == len(frames[1]) and frames[0].equals(frames[1])


def test_nearest_rows_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("nearest_rows", "nearest_rows_each"):
        assert core.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("missing", ["circuitscope.llm", "circuitscope.llm.queries", "corpus_pipeline", "zstandard"])
def test_imports_without_the_optional_part(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None  # importing it fails\n"
            "import __spark_entry__ as e; from circuitscope import queries as core\n"
            "assert set(core.QUERIES) <= set(e.queries()) and set(core.ORACLE_SQL) <= set(e.oracle_sql())\n"
            f"assert 'pipeline' not in e.queries() and (not any(n.startswith('op1_') for n in e.queries()) or {missing == 'corpus_pipeline'})")
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
