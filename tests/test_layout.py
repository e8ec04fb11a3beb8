"""The library stands without the corpus operators."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_imports_the_corpus_operators():
    for f in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"millrace\.llm|from \.+llm|corpus_pipeline", f.read_text()), f


def test_entry_imports_without_them():
    code = "import sys; sys.modules['millrace.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 150 and 'pipeline' not in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
