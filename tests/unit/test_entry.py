"""The entry module imports without a session, and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SAY = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), *q)"


def run(folder):
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)}, check=True).stdout.split()


def test_imports_without_a_session():
    assert int(run(ROOT)[0]) > 100


def test_imports_without_the_optional_subpackage(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    names = run(tmp_path)
    assert int(names[0]) > 90 and "pipeline" not in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names)
