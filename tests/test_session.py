"""The package as an archive for executors that have no copy of it."""

import os
import subprocess
import sys
import zipfile

PROBE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from barwright.session import ship_package
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
if sys.argv[2] == "ship":
    ship_package(spark)
def use(batches):
    from barwright.functions import windows
    for b in batches:
        yield b
print("ROWS", spark.range(5).mapInArrow(use, "id long").count())
"""


def run(mode):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13"}
    return subprocess.run([sys.executable, "-c", PROBE, repo, mode], env=env, cwd="/", capture_output=True, text=True, timeout=170, check=False)


def test_workers_import_the_shipped_package():
    shipped = run("ship")
    assert "ROWS 5" in shipped.stdout, shipped.stderr[-800:]
    assert "ROWS" not in run("leave").stdout


def test_archive_holds_the_whole_package(spark):
    from barwright.session import ship_package

    names = zipfile.ZipFile(ship_package(spark)).namelist()
    assert "barwright/session.py" in names and "barwright/operators/backtest.py" in names and all(n.startswith("barwright/") for n in names)
