from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text as T


def test_column_functions_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("Hello, WORLD!",), ("see http://x now",)], "t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string").parquet(str(tmp_path / "in"))
    cleaned = stream.select(T.clean_ascii(F.col("t")).alias("c")).where(T.passes_filters(F.col("c"), 1, 1))
    query = cleaned.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {r["c"] for r in spark.table("cleaned").collect()} == {"hello world", "see now"}
