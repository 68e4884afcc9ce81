from pyspark.sql import functions as F

from millrace.operators.skew import lookup


def test_hot_and_other_keys_are_joined_alike(spark):
    rows = [("hot", None, i) for i in range(50)] + [(f"k{i % 20}", f"v{i}", i) for i in range(60)] + [(None, "n", 0), ("gone", "g", 1)]
    df = spark.createDataFrame(rows, "key string, v string, code int")
    table = df.where("key <> 'gone'").groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("mark", F.concat("key", F.lit("!")))
    for slots in (1, 3, 1000):
        got = lookup(df, table, ["key"], "n", slots).select("key", "v", "code", "mark").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, df.join(table, "key").select("key", "v", "code", "mark").collect()))
    assert lookup(df.limit(0), table, ["key"], "n").count() == lookup(df, table.limit(0), ["key"], "n").count() == 0
