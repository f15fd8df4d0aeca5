"""The package is on the driver's path only, as on a cluster where nothing was installed."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = f"""
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
sys.path.insert(0, {ROOT!r})
from tidegauge.llm import langid, toxicity
docs = spark.createDataFrame([(k, ("you awful stupid lot " if k % 2 else "ein ruhiger schoener Tag ") * 3, "en" if k % 2 else "de") for k in range(60)],
                             "doc_id bigint, text string, lang string").repartition(2)
print(langid.predict(docs, langid.fit(docs)).where("lang_pred = 'de'").count())
labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")
print(toxicity.score(docs, toxicity.fit(docs, labels)).where("score >= 0.5").count())
spark.stop()
"""


def test_models_reach_executors_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.split() == ["30", "30"], done.stderr[-2000:]
