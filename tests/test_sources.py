import json

import pytest
from pyspark.sql import functions as F

from arealis.sources import explode_json_objects, from_json_rows, load, stats_table, to_json_rows, write_json_rows
from arealis.streaming import stream_json


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, s string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.write.orc(str(tmp_path / "t.orc"))
    df.write.json(str(tmp_path / "t.json"))
    df.write.csv(str(tmp_path / "t.csv"), header=True)
    want = sorted(map(tuple, df.collect()))
    schema = "id int, s string"
    assert sorted(map(tuple, load(spark, str(tmp_path), "t").collect())) == want
    assert sorted(map(tuple, load(spark, f"{tmp_path}/", "t", format="orc").collect())) == want
    assert sorted(map(tuple, load(spark, str(tmp_path), "t", format="json", schema=schema).collect())) == want
    csv = load(spark, str(tmp_path), "t", format="csv", schema=schema, options={"header": "true"})
    assert sorted(map(tuple, csv.collect())) == want
    for format in ("json", "csv"):
        with pytest.raises(ValueError):
            load(spark, str(tmp_path), "t", format=format)


def test_only_needed_columns_are_read(spark):
    from tests.plans import plan_of

    df = load(spark, "/root/testdata/sf0.001", "lineitem").where(F.col("l_suppkey").isin(1, 2)).select("l_quantity")
    plan = plan_of(df)
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in plan and "In(l_suppkey, [1,2])" in plan


def test_stats_tables(spark):
    tables = {"county_stats": spark.range(1), "state_stats": spark.range(2)}
    assert stats_table("County", tables) is tables["county_stats"]
    assert stats_table("STATE", tables) is tables["state_stats"]
    for name in ("Galaxy", "Tract"):
        with pytest.raises(ValueError):
            stats_table(name, tables)


def test_json_rows(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, 3)], "id int, s string, n int")
    assert [r["json"] for r in to_json_rows(df).collect()] == ['{"id":1,"s":"x"}', '{"id":2,"n":3}']
    full = [r["json"] for r in to_json_rows(df, drop_nulls=False, defaults={"n": 0}).collect()]
    assert full == ['{"id":1,"s":"x","n":0}', '{"id":2,"s":null,"n":3}']
    with pytest.raises(ValueError):
        to_json_rows(df, defaults={"q": 1})


def test_json_documents(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "s": {"t": "x"}}'), (2, "{}"), (3, "oops")], "id int, body string")
    rows = from_json_rows(df, "body", "a int, s struct<t:string>").orderBy("id").collect()
    assert [(r["id"], r["a"], r["s"] and r["s"]["t"]) for r in rows] == [(1, 1, "x"), (2, None, None), (3, None, None)]


def test_json_delivery(spark, tmp_path):
    df = spark.range(20).withColumn("s", F.when(F.col("id") > 3, F.lit("x"))).repartition(3)
    assert sorted(json.loads(t)["id"] for t in stream_json(df)) == list(range(20))
    write_json_rows(df, str(tmp_path / "out"), drop_nulls=False)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 20 and all('"s":' in line for line in lines)


def test_json_bodies(spark):
    bodies = [
        (1, '[{"a": 1}, {"a": 2}]'),
        (2, '[{"a": 3}, 7, "x", null, [1]]'),
        (3, '{"a": 4, "b": [1, {"a": 9}]}'),
        (4, "[]"),
        (5, "{broken"),
        (6, None),
        (7, ' \n [ {"a": 5} ] '),
        (8, "17"),
        (9, "[1, 2"),
    ]
    df = spark.createDataFrame(bodies, "id int, body string")
    rows = explode_json_objects(df, "body").select("id", F.variant_get("value", "$.a", "int").alias("a")).collect()
    assert sorted(map(tuple, rows)) == [(1, 1), (1, 2), (2, 3), (3, 4), (7, 5)]
