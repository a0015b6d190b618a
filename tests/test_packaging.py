"""Workers that can't see the repository get the package shipped."""

import os
import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, {top!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tapeloom.sources.shared import ship_package
from tapeloom.functions.codecs import decode_f32
spark = SparkSession.builder.config(map={{"spark.master": "local-cluster[1,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.checkpoint.dir": {shared!r}, "spark.driver.host": "127.0.0.1"}}).getOrCreate()
assert ship_package(spark).endswith(".zip")
print("found", spark.range(1).select(decode_f32(F.unhex(F.lit("0000803f"))).alias("x")).first().x)
spark.stop()
"""


def test_the_package_is_shipped(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_WORKER_DIR": str(tmp_path / "work")}
    (tmp_path / "shared").mkdir()
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(top=str(TOP), shared=f"file://{tmp_path}/shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "found [1.0]" in run.stdout, run.stderr[-1500:]
