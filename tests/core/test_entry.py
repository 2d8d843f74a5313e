"""The entry module, with the text operators and without them."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parents[2]
ASK = "import __spark_entry__ as e; from fieldcanon.plans import queries as q; assert set(q.QUERIES) <= set(e.queries()); print(sorted(set(e.queries()) - set(q.QUERIES)))"


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_without_the_text_operators(tmp_path, left):
    for name in ("fieldcanon", "tests"):
        shutil.copytree(HERE / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(n for n in left if (HERE / n).exists())):
        shutil.copy(HERE / name, tmp_path / name)
    ran = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    assert ran.stdout.strip() == "[]"
