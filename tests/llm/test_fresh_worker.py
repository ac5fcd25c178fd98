"""Each module of the subpackage runs in an interpreter that has loaded nothing else."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("code", [
    "from tillwise.llm import bwt_dedup as m; import pyarrow as pa; "
    "m._flat(pa.array([[{'at': 1, 'content': 2, 'ranges': [0, 1]}]]))",
    "from tillwise.llm import fixity; import inspect; assert 'import pyarrow.compute' in inspect.getsource(fixity)",
])
def test_no_hidden_import(code):
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
