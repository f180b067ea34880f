"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(__file__).resolve().parent.parent


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_subpackage(tmp_path):
    code = "import sys\nsys.modules['corvine.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not [n for n in e.queries() if n.startswith('op') and n[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=HERE)
