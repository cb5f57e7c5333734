"""What the operators share: the folder of intermediates, broadcasts of a counted size, names that do not clash."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from axonframe.llm.shared import fresh, sent_if_small, shared_dir


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None))


def test_a_folder_of_our_own_in_local_mode_only():
    assert shared_dir(session("yarn", "hdfs://shared/")) == "hdfs://shared"
    for master in ("local", "local[4]", "local[*]"):
        assert shared_dir(session(master)).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))


def test_broadcast_hints_are_counted_by_rows_or_by_weight(spark):
    df = spark.createDataFrame([(i, [1] * i) for i in range(10)], "id int, many array<int>")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(sent_if_small(df, 10)) and not hinted(sent_if_small(df, 9))
    assert hinted(sent_if_small(df, 45, F.size("many"))) and not hinted(sent_if_small(df, 44, F.size("many")))
    assert hinted(sent_if_small(df.limit(0), 5, F.size("many")))


def test_tables_beyond_the_bound_are_not_sent_however_small_spark_takes_them_to_be(spark):
    df = spark.range(10)
    plan = lambda rows: df.join(sent_if_small(df, rows), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(10) and "Broadcast" not in plan(9)


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_KEY int, _key1 int, id int")
    assert fresh(df, "key", "id") == ["_key2", "_id"]
