from pyspark.sql import functions as F

from promptbook.plans.lineage import cut, cut_table, ensure_checkpoint_dir
from promptbook.plans.sampling import bounded_sample
from promptbook.plans.shipping import ship
from promptbook.sources.tables import optional


def test_cuts_keep_rows_and_end_the_plan(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    for f in (cut, cut_table):
        got = f(df.groupBy("x").count())
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.groupBy("x").count().collect()))
        assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_checkpoints_on_a_cluster_need_a_shared_folder():
    from types import SimpleNamespace as N

    import pytest

    unset = N(isDefined=lambda: False)
    sc = N(_jsc=N(sc=lambda: N(getCheckpointDir=lambda: unset)), getConf=lambda: N(get=lambda k: None), master="spark://host:7077")
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(N(sparkContext=sc, conf=N(get=lambda k, d: d)))


def test_sample_is_bounded_and_the_same_every_time(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("v"), F.lit(1).alias("_h2"))
    one, two = bounded_sample(df, "v", 50), bounded_sample(df.repartition(7), "v", 50)
    assert one == two and len(one) == 50
    assert len(bounded_sample(df.limit(3), "v", 50)) == 3 and bounded_sample(df.where("false"), "v", 5) == []


def test_optional_column(spark):
    df = spark.range(1)
    assert df.select(optional(df, "id", "long"), optional(df, "nothing", "string", "x").alias("n")).first() == (0, "x")


def test_package_is_shipped_once(spark):
    ship(spark)
    ship(spark)
    assert sum("promptbook.zip" in f for f in spark.sparkContext.listFiles) == 1


def test_reduction_is_of_the_characters(spark, small):
    from promptbook.plans import catalog

    have = {r.id for r in catalog.QUERIES["l2_normalize"](spark, small).collect()}
    graph = catalog.QUERIES["fuzzy_graph"](spark, small).collect()
    assert {r.a for r in graph} | {r.b for r in graph} == have
    assert {r.id for r in catalog.QUERIES["umap_2d"](spark, small).collect()} == have
