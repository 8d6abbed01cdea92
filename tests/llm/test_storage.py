"""Row numbers that stay the same however a table is read."""

from pyspark.sql import functions as F

from loomtrace.llm import storage


def numbers(df):
    return {r["id"]: r["n"] for r in storage.numbered(df, "n").select("id", "n").collect()}


def test_numbers_do_not_depend_on_splits(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("text"), F.lit(1).alias("row")).repartition(8).write.parquet(path)
    df = spark.read.parquet(path).select("id", "text")
    keyed = storage.numbered(df, "n")
    key = "spark.sql.leafNodeDefaultParallelism"
    found = []
    for cores in (4, 16, 1):
        spark.conf.set(key, cores)
        found.append({r["id"]: r["n"] for r in keyed.select("id", "n").collect()})
        found.append(numbers(df))
    spark.conf.unset(key)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    found.append({r["id"]: r["n"] for r in keyed.where("id % 3 = 0").select("id", "n").collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(set(found[0].values())) == 20_000
    assert all(f == found[0] for f in found[:-1])
    assert all(found[0][i] == n for i, n in found[-1].items())


def test_other_plans_are_written(spark):
    df = spark.range(100).repartition(7).select("id")
    assert len(set(numbers(df).values())) == 100
    csv = spark.createDataFrame([(1,), (2,)], "id long").where("id > 0")
    assert len(numbers(csv)) == 2


def test_colliding_file_names_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "FILE_BITS", 0)
    path = f"file://{tmp_path}/rows"
    spark.range(100).repartition(4).write.parquet(path)
    assert len(set(numbers(spark.read.parquet(path)).values())) == 100
