from types import SimpleNamespace

import pytest

from lexitide import runtime


def test_tables_last_while_a_plan_reads_them(spark):
    runtime.sweep(spark, collect=True)
    table = runtime.materialize(spark.range(100), "numbers")
    path = next(reversed(runtime._TABLES))
    derived = table.where("id > 5").groupBy((table.id % 2).alias("k")).count()
    del table
    runtime.sweep(spark, collect=True)
    assert path in runtime._TABLES and {r["count"] for r in derived.collect()} == {47}
    del derived
    for _ in range(20):
        runtime.sweep(spark, collect=True)
        if path not in runtime._TABLES:
            break
    place, files = runtime._hadoop(spark, path)
    assert path not in runtime._TABLES and not files.exists(place)


def session(master, **conf):
    get = lambda name, default=None: conf.get(name, default)
    return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get)))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://a:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            runtime.shared_dir(session(master))
        assert runtime.shared_dir(session(master, **{"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    assert runtime.shared_dir(session("local[4]")).startswith("file://")
