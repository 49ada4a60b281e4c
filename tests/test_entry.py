"""The driver's entry points, with and without the optional parts."""
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("without_pipeline", [True, False])
def test_queries_without_the_optional_folders(tmpdir_path, without_pipeline):
    away = {"llm", ".git", "__pycache__"} | ({"corpus_pipeline.py"} if without_pipeline else set())
    copy = os.path.join(tmpdir_path, "copy")
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in away])
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), any(n[:2] == 'op' or n == 'pipeline' for n in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    count, covered, optional = out.stdout.split()
    assert int(count) >= 150 and covered == "True" and optional == "False"
