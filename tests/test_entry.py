"""The driver's contract: names, columns that match the SQL, and independence from the optional subpackage."""

import os
import pathlib
import re
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "lexmill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "lexmill").parts:
            assert not re.search(r"^\s*(from|import)\s+lexmill\.llm", path.read_text(), re.M), path


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['lexmill.llm'] = None; import __spark_entry__ as e; q = e.queries(); print('p1_found' in q, 'p2_found' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.stdout.split() == ["True", "False"], out.stderr[-500:]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["ir_metrics_at_k", "citation_prf", "clause_split", "article_canonical", "cooccurrence_edges", "cohen_kappa_k", "histogram_capped"])
def test_query_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for path in pathlib.Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want, got = con.sql(entry.oracle_sql()[name]), entry.queries()[name](spark, DATA)
    assert sorted(want.columns) == sorted(got.columns)

    def flat(x):
        return [flat(i) for i in x] if isinstance(x, (list, tuple)) else round(x, 6) if isinstance(x, float) else x

    rows = lambda got_rows, columns: sorted(str([flat(r[columns.index(c)]) for c in sorted(columns)]) for r in got_rows)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_streams(spark):
    import __spark_entry__ as entry

    for name in ("stream_clause_upsert", "stream_windowed_counts"):
        assert entry.queries()[name](spark, DATA).count() > 0


def test_ordered_events_and_resume(spark):
    from lexmill.streaming import clauses as s

    batch = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "clause_index int, text string")
    got = s.ordered_events(batch, "clause_index").collect()
    assert [(r["event"], r["position"]) for r in got] == [("clause", 0), ("clause", 1), ("clause", 2), ("done", 3)]
    assert [r["clause_index"] for r in s.resume(batch, batch.where("clause_index = 0"), ["clause_index"], 1).collect()] == [1]
    last = s.latest_by_key(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, at int, v string"), ["k"], ["at"])
    assert sorted((r["k"], r["v"]) for r in last.collect()) == [(1, "b"), (2, None)]
