"""Where intermediate tables go."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from stratalake.session import CHECKPOINT_DIR, new_path, shared_root


class FakeContext:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder


class FakeSession:
    def __init__(self, master, **conf):
        self.conf, self.sparkContext = conf, FakeContext(master)


def test_the_session_names_the_folder():
    session = FakeSession("spark://x", **{CHECKPOINT_DIR: "hdfs://shared/dir/"})
    assert shared_root(session) == "hdfs://shared/dir"
    first, second = new_path(session, "t"), new_path(session, "t")
    assert first.startswith("hdfs://shared/dir/stratalake/t-") and first != second


def test_the_context_may_name_it():
    session = FakeSession("spark://x")
    session.sparkContext.folder = "hdfs://shared/other"
    assert shared_root(session) == "hdfs://shared/other"


def test_a_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError):
        shared_root(FakeSession("spark://x"))


def test_a_local_session_gets_one_folder(tmp_path):
    """On a Spark session of its own, whose defaults name no folder."""
    code = """
from pyspark.sql import SparkSession
from stratalake.session import new_path, shared_root
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
root = shared_root(spark)
assert root == shared_root(spark)
path = new_path(spark, "t")
spark.range(3).write.parquet(path)
assert path.startswith(root) and spark.read.parquet(path).count() == 3
"""
    (tmp_path / "spark-defaults.conf").write_text("")
    repo = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=180,
                          env={**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(repo)})
    assert done.returncode == 0, done.stderr[-2000:]
