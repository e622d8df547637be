"""Where intermediate results go, how large partitions get, and joins by counted size."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from understory import session as S


def test_a_cluster_needs_a_shared_folder():
    def stub(master, named):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: named))

    made: list = []
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="every executor"):
            S.ensure_checkpoint_dir(stub(master, None))
    assert made == []
    S.ensure_checkpoint_dir(stub("yarn", "hdfs:///shared"))
    S.ensure_checkpoint_dir(stub("local[4]", None))
    assert made[0] == "hdfs:///shared" and "understory-" in made[1]


def test_intermediates_are_written_and_removed(spark):
    df = S.cut_table(spark.range(10))
    kept = S.cut(spark.range(5))
    assert df.count() == 10 and kept.count() == 5 and S.exists(spark, spark.sparkContext.getCheckpointDir())
    S.drop_intermediates(spark)
    with pytest.raises(Exception):  # noqa: B017
        df.count()
    assert S.cut_table(spark.range(3)).count() == 3  # the folder goes on being used


def test_partitions_follow_the_size(spark, tmp_path):
    spark.range(200_000).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    least = S.width(t)
    assert S.width(t, 1000) > 64 * least > 0  # no cap on their number
    wild = t.alias("a").join(t.alias("b"), F.col("a.id") == F.col("b.id")).join(t.alias("c"), F.col("a.id") == F.col("c.id"))
    assert S.width(wild, 1000) <= 8 * 3 * S.width(t, 1000)  # estimates behind joins don't run away


@pytest.mark.parametrize("how", ["inner", "left_semi", "left"])
def test_lookups_agree(spark, how):
    left = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 1, id % 50) as k")
    right = S.cut_table(spark.range(1, 40).selectExpr("id as k", "id * 2 as v"))
    rows = lambda limit: sorted(map(tuple, S.lookup(left, right, ["k"], "id", how, limit).collect()), key=str)
    assert rows(100) == rows(0) and len(rows(0)) > 1000


@pytest.mark.parametrize("how", ["inner", "left_semi", "left"])
def test_beyond_the_limit_both_sides_are_shuffled(spark, how):
    """A file of a few KB is below Spark's own threshold; the counted rows decide, and the salted rows are 16 times as many."""
    left = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 1, id % 50) as k")
    right = S.cut_table(spark.range(1, 40).selectExpr("id as k", "id * 2 as v"))
    for joined in (S.lookup(left, right, ["k"], "id", how, 0), left.join(S.if_small(right, 0), "k", how)):
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()  # as it ran
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
