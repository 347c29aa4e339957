import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from sheafwork.llm.common import discard, work_dir, written


def test_tables_are_written_below_the_shared_folder(spark):
    df = written(spark.range(5), "some")
    assert work_dir(spark).removeprefix("file://") in df.inputFiles()[0]
    assert df.count() == 5
    discard(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_a_cluster_must_share_a_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://somewhere", getConf=lambda: conf, applicationId="x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(session)


ALONE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from sheafwork.llm import queries
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
for name, query in queries.queries().items():
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name)
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_workers_need_no_copy_of_the_package(tmp_path):
    """The driver finds the package by its own path, which workers don't get."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ALONE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.stdout.count("ran op") == 10, done.stderr[-3000:]
