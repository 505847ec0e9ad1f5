import subprocess
import sys
from pathlib import Path


def test_queries_are_listed_without_a_session():
    """The driver reads the names before it starts Spark."""
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
