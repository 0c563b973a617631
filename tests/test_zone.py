"""Results don't depend on the time zone of the machine."""

import os
import subprocess
import sys

NAMES = ["recent_articles", "articles_created_since", "fresh_entries", "collected_entries"]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
from __spark_entry__ import queries
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("COUNTS", *(queries()[n](spark, sys.argv[1]).count() for n in sys.argv[2:]))
"""


def test_other_time_zone(spark, sf_dir):
    from __spark_entry__ import queries

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"TZ": "America/New_York", "PYTHONPATH": root}
    run = subprocess.run([sys.executable, "-c", SCRIPT, sf_dir, *NAMES], env=env, cwd=root, capture_output=True, text=True, timeout=240)
    counts = [int(x) for x in run.stdout.rpartition("COUNTS")[2].split()]
    assert counts == [queries()[n](spark, sf_dir).count() for n in NAMES], run.stderr[-500:]
