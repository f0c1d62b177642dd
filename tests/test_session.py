import os
import subprocess
import sys

from pyspark.sql import functions as F

from veilspark.session import scratch, store

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# A session as Spark ships it: no settings file, nothing set but the master.
STOCK = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
for name in {names!r}:
    print(name, __spark_entry__.queries()[name](spark, {sf!r}).count())
"""


def run_stock(tmp_path, sf, *names):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", STOCK.format(root=ROOT, names=list(names), sf=sf)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_stock_session_stores_its_stages(tmp_path, sf):
    assert "texts_anonymized" in run_stock(tmp_path, sf, "texts_anonymized")


def test_scratch_removes_what_was_stored_inside(spark):
    kept = store(spark.range(3), "kept")
    with scratch(spark):
        table = store(spark.range(5), "gone")
        files = table.inputFiles()
        assert table.agg(F.sum("id")).first()[0] == 10
    assert kept.count() == 3 and files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
