from gleanmill.streaming import feed


def test_first_offers_with_missing_places(spark, tmp_path):
    rows = [(1, 5, "b"), (1, None, "a"), (2, None, "d"), (2, None, "c"), (3, 1, "e"), (None, 0, "f")]
    spark.createDataFrame(rows, "k long, at long, t string").coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(3,)], "k long").write.parquet(f"{tmp_path}/stored")
    stream = spark.readStream.schema("k long, at long, t string").parquet(f"{tmp_path}/in")
    offers = feed.first_offers(stream, feed.stored_keys(spark, f"{tmp_path}/stored", "k", "long"), "k", ["at"])
    offers.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(
        lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    ).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("k", "t", "again").collect()
    assert sorted(tuple(r) for r in got) == [(1, "b", False), (2, "c", False)]
