"""The entry module with and without the training-data package."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LEFT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), len(set(e.oracle_sql()) - set(q)))"


@pytest.mark.parametrize("gone", [["skyloom/llm", "tests/llm"], ["skyloom/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_import_without_parts(tmp_path, gone):
    for name in ("skyloom", "jobs", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    for name in gone:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        elif (tmp_path / name).exists():
            (tmp_path / name).unlink()
    out = subprocess.run([sys.executable, "-c", LEFT], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, more, loose = map(int, out.stdout.split())
    assert n - more >= 46 and loose == 0
    assert more == 0 if "skyloom/llm" in gone else more in (0, 12)
