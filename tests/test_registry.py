"""The driver's contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("textmatch/llm", "tests/llm"), ("textmatch/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_loads_without_the_training_data_operators(tmp_path, gone):
    ignored = lambda folder, names: [n for n in names if n == "__pycache__" or str((Path(folder) / n).relative_to(ROOT)) in gone]
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "textmatch", tmp_path / "textmatch", ignore=ignored)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in q))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert ran.returncode == 0, ran.stderr
    n, n_sql, training = ran.stdout.split()
    assert int(n) > 100 and int(n_sql) > 90 and training == "False"


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="no test tables")
def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"doc_id", "file_id", "hits", "percent"}
