"""The driver's contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["px", "py", "n", "as_points", "as_triangles"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)
    for path in (tmp_path / "r").rglob("*.py"):
        assert "geolode.llm" not in path.read_text() or path.name in ("__spark_entry__.py", "test_entry.py")
