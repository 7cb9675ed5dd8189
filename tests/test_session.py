from types import SimpleNamespace

import pytest

from tidemark.session import CHECKPOINT_CONF, cut_lineage, shared_dir, width_for


def fake(master, conf=None, set_already=None):
    said = []
    context = SimpleNamespace(
        master=master,
        getConf=lambda: {CHECKPOINT_CONF: conf} if conf else {},
        getCheckpointDir=lambda: set_already,
        setCheckpointDir=said.append,
    )
    return SimpleNamespace(sparkContext=context), said


def test_the_named_folder_is_used():
    session, said = fake("spark://x", "hdfs://a/b/")
    assert shared_dir(session) == "hdfs://a/b" and said == ["hdfs://a/b/"]
    session, said = fake("spark://x", "hdfs://a/b", "hdfs://a/b/123")
    assert shared_dir(session) == "hdfs://a/b" and not said


@pytest.mark.parametrize("master", ["spark://x", "yarn", "local-cluster[2,1,1024]"])
def test_no_temporary_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        shared_dir(fake(master)[0])


def test_lineage_is_cut_by_a_table_in_the_shared_folder(spark):
    cut = cut_lineage(spark.range(5).selectExpr("id", "id * 2 AS twice"))
    assert cut.count() == 5
    plan = cut.select("id")._jdf.queryExecution().executedPlan().toString()
    assert shared_dir(spark) in plan and "twice" not in plan


def test_width_follows_from_the_files(spark, tmp_path):
    spark.range(10_000).write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert width_for(read) == 4 and width_for(read.groupBy("id").count(), size // 50) in (50, 51)
    assert width_for(spark.createDataFrame([(1,)], "a int")) == 4 and width_for(read.crossJoin(read), size // 50) in (100, 101)
