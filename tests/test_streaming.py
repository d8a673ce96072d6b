from clearveil.streaming import rolling


def test_values_across_batches(spark, tmp_path):
    batches = [[(1, 0, "xxab"), (2, 1, "zz"), (3, 0, "q")], [(1, 1, "cdyy"), (2, 0, "abcd"), (3, 2, "abcd")], [(1, 2, "abcd"), (3, 3, None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "d long, p int, norm string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={i}"))
    schema = "d long, p int, norm string, b int"
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = rolling.rolling_scan(pages, [("v", "abcd"), ("w", "zzz")], "d", "p")
    got = rolling.finished(out, str(tmp_path / "out"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(1, 1, "v", None), (2, 0, "v", None), (2, 0, None, "PAGE_OUT_OF_ORDER"), (3, 2, "v", None), (3, 2, None, "PAGE_GAP")]
