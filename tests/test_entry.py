"""The driver's contract holds with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"


@pytest.mark.parametrize("gone", [("dendra/llm",), ("dendra/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        p = copy / name
        shutil.rmtree(p, ignore_errors=True) if p.is_dir() else p.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    names = subprocess.run([sys.executable, "-W", "ignore", "-c", SHOW], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    from dendra.plans import registry

    assert set(registry.QUERIES) <= set(names) and "pipeline" not in names
    assert any(n.startswith("op") and n[2:3].isdigit() for n in names) == (copy / "dendra" / "llm").is_dir()
