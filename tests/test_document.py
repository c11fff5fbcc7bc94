"""The contract's file as executors write it: the bytes of the assembled document, whole or not at all."""

import json

import pytest
from pyspark.sql import functions as F

from tokenloom import model as m
from tokenloom.plans import contract as contracts
from tokenloom.plans import registry
from tokenloom.sources import document

SF = "/root/testdata/sf0.001"
NOW = "2024-05-02T00:00:00.000Z"


def parts_of(spark, tokens=True, components=True):
    t, c = registry._tokens(spark, SF), registry._components(spark, SF)
    t, c = (t if tokens else t.limit(0)), (c if components else c.limit(0))
    strange = F.when(F.length("name") % 3 == 0, F.concat("name", F.lit(' "ü"\n \\'))).otherwise(F.col("name"))
    of = lambda rows, name: rows.filter(F.col("source_name") == name).drop("source_name", "source_ord")
    props = F.map_from_arrays(F.array(F.lit("z"), F.lit("a")), F.array(*[F.struct(F.lit(x).alias("type"), F.lit(x == "t").alias("required")) for x in "tu"]))
    return contracts.build([(n, of(t.withColumn("value", strange), n), of(c.withColumn("props", F.when(F.length("name") % 2 == 0, props)).withColumn("variants", F.when(F.length("name") % 5 == 0, F.array(F.lit("v")))), n)) for n in m.ADAPTERS], "figma")


@pytest.mark.parametrize(("tokens", "components", "tasks"), [(True, True, "7"), (False, True, "1"), (False, False, "3")])
def test_the_file_is_the_assembled_document(spark, tmp_path, tokens, components, tasks):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = parts_of(spark, tokens, components)
        path = str(tmp_path / "c.json")
        contracts.write(parts, ["figma", "codebase"], "/p", "/p/ö.json", path, NOW)
        contracts.save(want := contracts.assemble(parts, ["figma", "codebase"], "/p", "/p/ö.json", NOW), str(tmp_path / "want.json"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert (tmp_path / "c.json").read_bytes() == (tmp_path / "want.json").read_bytes()
    assert bool(want["tokens"]["colors"]) == tokens and bool(want["components"]) == components
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c.json", "want.json"]


def test_a_failed_task_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "c.json")
    (tmp_path / "c.json").write_text("old")
    spark.dataSource.register(document.ContractDocument)
    rows = spark.range(0, 2000, 1, 4).select(F.lit(1).alias("section"), F.lit(None).cast("string").alias("category"), F.col("id").cast("string").alias("key"), F.when(F.col("id") == 1999, F.lit("{")).otherwise(F.lit("{}")).alias("body"))
    with pytest.raises(Exception, match="JSON|Expecting"):
        rows.write.format(document.FORMAT).option("head", "{}").mode("overwrite").save(path)
    assert (tmp_path / "c.json").read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["c.json"]
    with pytest.raises(Exception, match="overwrite"):
        rows.write.format(document.FORMAT).option("head", "{}").mode("append").save(path)
    rows.filter("id < 1999").write.format(document.FORMAT).option("head", '{"version": "1", "generatedAt": "t"}').mode("overwrite").save(path)
    assert list(json.loads((tmp_path / "c.json").read_text())["components"]) == [str(k) for k in range(1999)]
