from types import SimpleNamespace

import pytest

from doclattice.llm import common


def session(master, folder=None):
    made = []
    folders = SimpleNamespace(isEmpty=lambda: not made)
    sc = SimpleNamespace(environment={}, master=master, setCheckpointDir=made.append, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: folders)))
    settings = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "/w"}
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: settings.get(k) or d, set=lambda k, v: None)), made


def test_a_cluster_must_name_a_shared_folder():
    spark, made = session("spark://host:7077")
    with pytest.raises(ValueError):
        common.prepare(spark)
    assert made == []


@pytest.mark.parametrize("master, folder, want", [("spark://host:7077", "hdfs:///shared", "hdfs:///shared"), ("local[4]", "/shared", "/shared"), ("local[4]", None, "/w/checkpoints")])
def test_the_folder_that_is_named_is_used(master, folder, want):
    spark, made = session(master, folder)
    common.prepare(spark)
    assert made == [want]
