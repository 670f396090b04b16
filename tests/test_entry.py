"""The driver's contract, with and without the llm subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("needs the driver's tables")
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["l_returnflag", "c", "s"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_llm(tmp_path):
    shutil.copytree(ROOT / "tesserae", tmp_path / "tesserae", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert "group_sum_count" in said.stdout and not [n for n in said.stdout.split() if re.match(r"op\d+_|pipeline", n)]
