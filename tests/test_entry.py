"""The driver's contract, with and without the training-data operators."""

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_registries(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["segment", "orders", "max_o_totalprice"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    """A copy without them still imports and registers its queries."""
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" in rel.parts or rel.name == "corpus_pipeline.py" or rel.parts[0] == "tests":
            continue
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); import pipespark.plans.cli, pipespark.streaming"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})


def test_nothing_else_imports_the_llm_package():
    for p in (ROOT / "pipespark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
