"""Operators run where the workers can't import the package."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
def there(batches):
    import importlib.util
    import pandas as pd
    yield pd.DataFrame({"n": [importlib.util.find_spec("strideframe") is not None]})
assert not any(r.n for r in spark.range(1).mapInPandas(there, "n boolean").collect()), "workers see the package"
sys.path.insert(0, ROOT)
import __spark_entry__ as entry
for name in NAMES:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""
NAMES = ["op1_simhash_dedup", "op2_quality_classifier", "op4_html_extract", "op5_suffix_dedup", "op6_token_counts", "op8_byte_bpe", "op10_nearest", "op11_whitening", "op12_toxicity", "op13_vector_codes", "dives_filtered", "track_segments", "streamed_tracks", "long_low_pass", "kit_samples", "homography_fit"]


def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", f"ROOT, NAMES = {ROOT!r}, {NAMES!r}\n{CODE}"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [x.split()[0] for x in done.stdout.splitlines() if x.split() and x.split()[0] in NAMES] == NAMES
