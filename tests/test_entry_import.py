"""The entry module is imported before any session exists."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
