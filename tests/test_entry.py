"""The entry point: imported without a session, and filters that stay where they are cheap."""

import subprocess
import sys
from pathlib import Path

from lexigrain.operators.fields import Field
from lexigrain.operators.index import build_index

ROOT = Path(__file__).resolve().parents[1]


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=300)


def test_plan_of_an_index_is_short(spark):
    """The filter of empty tokens isn't pushed below the normaliser, which would repeat its steps within each other."""
    index = build_index(spark.createDataFrame([(1, "a cat"), (2, "- +")], "id int, t string"), "id", [Field("t")])
    assert len(index.entries._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert {r["token"] for r in index.entries.collect()} == {"a~", "cat~"}
