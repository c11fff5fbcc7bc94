import types

import helpers
import pytest
from pyspark.sql import functions as F
from tokenloom.llm import common, ngramjoin, sstable, suffixdedup
from test_sstable import PATH


def test_ids_must_be_whole_numbers(spark):
    df = helpers.docs(spark, ["a b c d e f", "x"])
    text_ids = df.withColumn("doc_id", F.col("doc_id").cast("string"))
    for run in (ngramjoin.classes, ngramjoin.deduplicate, suffixdedup.remove_repeats, lambda d: sstable.write(d, PATH)):
        with pytest.raises(TypeError, match="whole numbers"):
            run(text_ids)
    small = df.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert ngramjoin.classes(small).count() == suffixdedup.remove_repeats(small).count() == sstable.digest(sstable.write(small, PATH)).count() == 2


def session(master):
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_a_cluster_needs_a_shared_folder():
    for master in ("local", "local[4]", "local[*]"):
        assert common.shared_dir(session(master)).startswith("file:///")
    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            common.shared_dir(session(master))


def test_scratch_is_freed(spark):
    df = spark.range(5)
    outer = common.materialise(df, "outer")
    with common.freeing(spark):
        inner = common.materialise(df, "inner")
        assert inner.count() == 5
    assert outer.count() == 5
    with pytest.raises(Exception, match="[Pp]ath|exist|FAILED_READ"):
        inner.count()
    common.drop(outer)
    with pytest.raises(Exception, match="[Pp]ath|exist|FAILED_READ"):
        outer.count()


def test_settled_keeps_its_table_and_nothing_else(spark, tmp_path):
    inner = []

    def make():
        inner.append(common.materialise(spark.range(7), "inner"))
        return inner[0].filter("id > 2")

    kept = common.settled(spark, "kept", make)
    assert kept.count() == 4
    with pytest.raises(Exception, match="[Pp]ath|exist|FAILED_READ"):
        inner[0].count()
    # a table that is not scratch is never deleted, whatever its folder is called
    spark.range(3).write.parquet(f"{tmp_path}/tokenloom/mine")
    mine = spark.read.parquet(f"{tmp_path}/tokenloom/mine")
    common.drop(mine, kept)
    assert mine.count() == 3
