"""The driver's contract, with and without the training-data operators."""

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_every_library_query_has_sql():
    from quotelens.queries import NAMES

    assert set(NAMES) <= set(__spark_entry__.queries())
    assert set(NAMES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["request_id", "claim_no", "quote", "reason", "path", "location"] and rows.count() > 0


def test_library_stands_without_llm():
    """As if the folder and the pipeline were deleted."""
    block = "import sys; sys.modules['corpus_pipeline'] = sys.modules['quotelens.llm'] = None; import __spark_entry__ as e; assert e.llm is None; print(*e.queries())"
    out = subprocess.run([sys.executable, "-c", block], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    names = out.stdout.split()
    assert "verify_claims" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_nothing_else_imports_llm():
    for path in (REPO / "quotelens").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(?:from|import)\b.*\bllm\b", path.read_text(), re.M), path
