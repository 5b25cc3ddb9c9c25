"""The entry without the training-data subpackage: it imports and registers the other queries."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), any(n.startswith('op') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("left", ["nothing", "caches", "pipeline", "broken"])
def test_entry_without_the_subpackage(tmp_path, left):
    shutil.copytree(ROOT / "lodeworks", tmp_path / "lodeworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left == "caches":
        (tmp_path / "lodeworks/llm/__pycache__").mkdir(parents=True)
    if left == "pipeline":
        (tmp_path / "corpus_pipeline.py").write_text("from lodeworks.llm import packing\n")
    if left == "broken":
        (tmp_path / "lodeworks/llm").mkdir()
        (tmp_path / "lodeworks/llm/queries.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, *rest = out.stdout.split()
    assert int(n) > 60 and rest == ["True", "False", "False"]
