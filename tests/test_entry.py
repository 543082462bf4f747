"""The driver contract without the optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert names >= set(e.oracle_sql()) and "experiment_metrics" in names
assert not [n for n in names if n == "pipeline" or n[:2] == "op" and n[2].isdigit()], names
"""


def test_entry_without_training_data_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO / "flowmark", copy / "flowmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", copy)
    subprocess.run([sys.executable, "-B", "-c", SCRIPT], cwd=copy, check=True, timeout=120)


def test_nothing_else_imports_the_optional_part():
    for path in (REPO / "flowmark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "flowmark.llm" not in path.read_text(), path
