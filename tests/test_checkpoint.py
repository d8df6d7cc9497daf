from types import SimpleNamespace

import pytest

from kinweave import checkpoint


def session(master, where=None):
    conf = SimpleNamespace(get=lambda key, default=None: where)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_a_cluster_must_name_a_shared_folder():
    assert checkpoint.shared_dir(session("local[4]")).startswith(checkpoint.LOCAL)
    assert checkpoint.shared_dir(session("yarn", "hdfs:///x/")).startswith("hdfs:///x/kinweave-")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            checkpoint.shared_dir(session(master))


def test_tables_can_be_dropped(spark):
    t = checkpoint.written(spark.range(5).toDF("x"))
    assert t.count() == 5
    path = t._scratch.removeprefix("file://")
    checkpoint.drop(t)
    import os

    assert not os.path.exists(os.path.dirname(path))
