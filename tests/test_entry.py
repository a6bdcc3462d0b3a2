"""The registry without the optional packages of the training-data operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
CODE = """
import sys
sys.modules.update(dict.fromkeys(sys.argv[1:]))
import __spark_entry__ as e
from veilsight.plans.queries import QUERIES
assert set(QUERIES) == set(e.queries()), sorted(set(QUERIES) ^ set(e.queries()))
assert set(e.oracle_sql()) <= set(QUERIES) and callable(e.entry)
"""


@pytest.mark.parametrize("missing", ["zstandard", "tokenizers", "veilsight.llm"])
def test_main_queries_need_no_optional_package(missing):
    done = subprocess.run([sys.executable, "-c", CODE, missing], cwd=ROOT, capture_output=True, text=True, timeout=100)
    assert done.returncode == 0, done.stderr
