"""Executors that have no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parents[2])
# The driver finds the package by a path of its own, which workers do not take over.
RUN = """
import sys
sys.path.insert(0, {repo!r})
from wattgrid.session import build_session
spark = build_session("far", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}})
from pyspark.sql import functions as F

@F.udf("boolean")
def there(x):
    import importlib.util
    return importlib.util.find_spec("wattgrid") is not None

assert not any(r[0] for r in spark.range(8).select(there("id")).collect())
from wattgrid.llm.queries import QUERIES
for name in {names!r}:
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
"""


@pytest.mark.parametrize("names", [("op1_sentencepiece", "op4_chat_format", "op5_html_extract", "op6_url_filter"), ("op7_language_id", "op8_ngram_join"), ("op11_structure_repair", "op12_exact_search", "op13_alignment")])
def test_functions_travel_by_value(tmp_path, names):
    done = subprocess.run([sys.executable, "-c", RUN.format(repo=REPO, names=names)], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
                          capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
