"""The core stands without the llm subpackage and keeps to the rules of scale."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CORE = [p for p in (ROOT / "plumbline").rglob("*.py") if "llm" not in p.relative_to(ROOT / "plumbline").parts]


def test_core_does_not_import_llm():
    for p in CORE:
        assert not re.search(r"\bimport llm|\.llm\b|from \.+llm", p.read_text()), p


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_no_shortcuts():
    for p in (ROOT / "plumbline").rglob("*.py"):
        text = p.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text, p


def test_workers_get_the_package(tmp_path, small):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
assert e.queries()['p5_found'](spark, {small!r}).count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=240)
