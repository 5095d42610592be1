"""Between stages, every executor of a cluster gives back the heap it doesn't need."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent.parent
CLUSTER = """
import sys
from pyspark.sql import SparkSession
import corpus_pipeline as P

at = sys.argv[1]
spark = (
    SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false")
    .config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", f"{at}/shared").config("spark.executor.extraJavaOptions", f"-Xlog:gc:file={at}/gc-%p.log")
    .getOrCreate()
)
spark.range(0, 8, 1, 8).foreach(lambda r: None)  # both have begun
docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
stages = dict(P.STAGES)
for name in ("line_dedup", "packing"):  # these run nothing of their own before rows are asked for
    stages[name](spark, docs, at)
spark.stop()
"""


def test_executors_rest_before_a_stage(tmp_path):
    import pyspark

    home = tmp_path / "home"  # executors leave their logs there
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(REPO), "PYSPARK_PYTHON": sys.executable}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert not done.returncode, done.stderr[-2000:]
    logs = [p.read_text() for p in tmp_path.glob("gc-*.log")]
    assert [x.count("Full (System.gc())") for x in logs] == [2, 2]
