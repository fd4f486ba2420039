"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = Path("/root/testdata/sf0.001")

import mnemos.plans as plans  # noqa: E402


@pytest.mark.skipif(not SF.is_dir(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_oracle(spark, name):
    df = plans.QUERIES[name](spark, str(SF))
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    want = con.execute(plans.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    show = lambda rows: sorted(repr([x if not isinstance(x, float) else round(x, 5) + 0.0 for x in r]) for r in rows)
    assert show(df.select(*columns).collect()) == show(want.fetchall())


def test_entry_imports_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "mnemos"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "mnemos"
    package.mkdir()
    for p in (ROOT / "mnemos").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'recall_hybrid' in q and not any(k.startswith('op') for k in q if k[2:3].isdigit())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.skipif(not SF.is_dir(), reason="no test tables here")
def test_python_functions_are_taken_out_of_every_plan(spark):
    """Spark missed a Python function over nested lambdas, seemingly by the numbers of their variables, mostly from a session's second plan on."""
    for _ in range(6):
        plan = plans.QUERIES["lexical_hit_scores"](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan


def test_core_imports_nothing_of_the_subpackage():
    """Imports within functions, too, which the copy without the subpackage doesn't run."""
    core = [p for p in (ROOT / "mnemos").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert core and not [p for p in core if any(line.split()[:1] in (["import"], ["from"]) and "mnemos.llm" in line for line in p.read_text().splitlines())]
