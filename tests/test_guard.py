import os
import shutil
import subprocess
import sys

from places import DATA, ROOT


def test_everything_else_works_without_the_corpus_operators(tmp_path):
    for name in ("halyard", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "halyard" / "llm", ignore_errors=True)
    code = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession

q = e.queries()
assert len(q) > 30 and not any(n.startswith("op") for n in q) and "pipeline" not in q
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
for name in ("coverage_counts", "every_toggle_vote", "status_run_of_pages", "mail_run"):
    assert q[name](spark, "{DATA}/sf0.001").count() > 0, name
assert e.entry(spark).count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
