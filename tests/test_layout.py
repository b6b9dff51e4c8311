"""The library stands without its training-data subpackage."""

import os
import re
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_outside_imports_the_subpackage():
    for where, _, names in os.walk(os.path.join(ROOT, "siltstone")):
        if os.path.basename(where) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(where, name)) as f:
                    assert not re.search(r"(import|from)\s+siltstone\.llm", f.read()), name


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_it(tmp_path, with_pipeline):
    """A copy of the repository without the subpackage and its tests still imports and answers."""
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "siltstone"), copy / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * with_pipeline]:
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), copy)
    code = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
names = entry.queries()
assert "hybrid_search" in names and "pipeline" not in names and not any(k[:2] == "op" and k[2].isdigit() for k in names), list(names)
assert set(entry.oracle_sql()) <= set(names)
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert names["source_counts"](spark, entry.SMOKE).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
