"""The driver's contract."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_without_the_training_data_operators(tmp_path):
    """Queries are there where the subpackage is gone, and where a library that it needs is."""
    code = "import sys; sys.modules[sys.argv[1]] = None; import __spark_entry__ as e; q = e.queries(); assert 'minimal_absent' in q and not any(n.startswith('op') for n in q), sorted(q)"
    for missing in ("strandframe.llm", "public_tokenizers"):
        subprocess.run([sys.executable, "-c", code, missing], cwd=ROOT, check=True, timeout=120)


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["doc_id", "qs", "l"] and frame.limit(5).count() == 5


def test_nothing_else_needs_the_training_data_operators():
    for path in (ROOT / "strandframe").rglob("*.py"):
        if "llm" not in path.parts:
            text = path.read_text()
            assert "strandframe.llm" not in text and "from .llm" not in text and "from ..llm" not in text, path
