"""The entry module stands without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_agree(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "rank", "chunk_id", "score"]


def test_imports_without_the_subpackage(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 20 and not any(n.startswith('op') for n in e.queries()); print('ok')"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True).stdout.strip() == "ok"


def test_imports_where_a_module_of_the_subpackage_is_missing(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("__pycache__"))
    (tmp_path / "quarry" / "llm").mkdir(exist_ok=True)
    (tmp_path / "quarry" / "llm" / "__init__.py").write_text("import a_module_that_is_not_installed")
    code = "import __spark_entry__ as e; assert len(e.queries()) > 20 and not any(n.startswith('op') for n in e.queries()); print('ok')"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True).stdout.strip() == "ok"
