from pyspark.sql import functions as F

from clauseforge import session


def test_salted_join_keeps_all_rows_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(session, "hot_keys", lambda df, key: ["hot"])
    many = spark.range(300).select(F.when(F.col("id") < 200, "hot").when(F.col("id") < 290, "cold").otherwise(None).alias("k"), "id")
    one = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "k string, v int")
    assert session.salted_join(many, one, "k").count() == 290
    assert session.salted_join(many, one, "k", "left").count() == 300
    assert session.salted_join(many, one, "k").select("id").distinct().count() == 290


def test_hot_keys_are_found_and_bounded(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, "a").when(F.col("id") < 500, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    assert session.hot_keys(df, "k", rows=100, tasks=10) == ["a"]
    assert session.hot_keys(df.limit(0), "k") == []


def test_materialise_keeps_schema_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b array<string>")
    assert session.materialise(df).schema == df.schema


def test_drop_scratch(spark):
    session.materialise(spark.range(3).toDF("a")).count()
    assert session.drop_scratch(spark) >= 1 and session.drop_scratch(spark) == 0
