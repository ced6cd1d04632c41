"""The driver's contract, and queries that SQL can't express against brute force."""

import importlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 15


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 70


def test_entry_imports_without_the_training_data_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "skein"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "skein").mkdir()
    for part in (ROOT / "skein").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "skein" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert out.stdout.split()[-1:] == ["False"], out.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "skein").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_chunk_ids_are_in_order(spark):
    rows = entry.queries()["chunk_ids"](spark, DATA).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(len(rows))) and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert importlib.import_module("skein").__version__
