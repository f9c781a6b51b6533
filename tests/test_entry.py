"""The registry: names, SQL for registered names only, and a working import without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_optional_parts(tmp_path):
    shutil.copytree(ROOT / "kobza", tmp_path / "kobza", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), not any(k.startswith('op') for k in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=60)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip().endswith("True")
