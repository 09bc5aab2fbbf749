"""The entry works without the subpackage, and without a library that only the subpackage needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("absent", ["corpus_pipeline", "tripwise.llm", "ahocorasick", "public_tokenizers"])
def test_entry_without(absent):
    code = (
        "import sys; sys.modules[%r] = None; import __spark_entry__ as e; q = e.queries(); "
        "assert 'hourly_profile' in q and set(e.oracle_sql()) <= set(q); "
        "assert not [n for n in q if n.startswith('op')]" % absent
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert "Without the queries" in done.stderr
