"""The closure is whole or an error, and so is the folder of its tables."""

from types import SimpleNamespace

import pytest

from credence import tables
from credence.operators import lineage


def test_a_longer_chain_is_an_error(spark):
    edges = spark.createDataFrame([(f"c{i + 1}", f"c{i}", "depends_on") for i in range(4)], "from_id string, to_id string, kind string")
    seeds = spark.createDataFrame([("c0",)], "claim_id string")
    assert {r.claim_id: r.level for r in lineage.reach(edges, seeds, max_levels=4).collect()} == {f"c{i}": i for i in range(1, 5)}
    with pytest.raises(RuntimeError):
        lineage.reach(edges, seeds, max_levels=3)


def test_many_levels_and_a_cycle(spark):
    edges = spark.createDataFrame([(f"c{i + 1:02}", f"c{i:02}", "depends_on") for i in range(20)] + [("c05", "c20", "depends_on"), ("c00", "c20", "depends_on")], "from_id string, to_id string, kind string")
    seeds = spark.createDataFrame([("c00",), ("c00",)], "claim_id string")
    assert sorted((r.level, r.claim_id, r.via) for r in lineage.reach(edges, seeds).collect()) == [(i, f"c{i:02}", f"c{i - 1:02}") for i in range(1, 21)]


def test_a_cluster_needs_a_shared_folder(spark, tmp_path):
    def session(master, folder=None):
        settings = {}
        conf = SimpleNamespace(get=lambda k, d=None: settings.get(k, d), set=settings.__setitem__)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: folder)))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(RuntimeError):
            tables.shared_dir(session(master))
        assert tables.shared_dir(session(master, "hdfs://host/x/")) == "hdfs://host/x"
    assert tables.shared_dir(session("local[4]")).startswith("file://")


def test_tables_are_deleted_on_request(spark):
    one, two = (tables.cut(spark.range(3), "t") for _ in range(2))
    tables.drop(one)
    assert one._credence_path not in tables.written() and two._credence_path in tables.written()
    tables.clear(spark, [two._credence_path])
    assert two._credence_path not in tables.written()
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        two.collect()
