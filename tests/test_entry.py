"""The entry works without the optional part, whatever of it is missing."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["zstandard", "corpus_pipeline", "slopeline.llm", "tokenizers"])
def test_engine_queries_stay_when_a_package_is_missing(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(set(e.oracle_sql()) - set(q)), 'svrg_wide' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-500:]
    assert out.stdout.split(maxsplit=1)[1].strip() == "[] True" and int(out.stdout.split()[0]) > 80
