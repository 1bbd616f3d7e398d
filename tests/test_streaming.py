from readlake.operators import cells
from readlake.streaming.cells import reads_per_cell


def test_running_counts_end_at_the_batch_result(spark, tmp_path):
    heads = [f"@c{i % 4}_u{i}#x" for i in range(50)] + ["@r CB:Z:c1 UB:Z:g"]
    rows = spark.createDataFrame(enumerate(heads), "read_id int, header string")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = reads_per_cell(stream).writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = cells.reads_per_cell(cells.parse_headers(rows)).collect()
    assert sorted(map(tuple, spark.table("cells").collect())) == sorted(map(tuple, want))
