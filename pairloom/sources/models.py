"""Saving and loading a token table with its configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table import ModelConfig


def save_model(table: DataFrame, config: ModelConfig, path: str) -> None:
    table.select("token_id", "vec").write.parquet(f"{path}/token_embeddings")
    spark = table.sparkSession
    config_row = spark.range(1).select(F.lit(json.dumps(config.as_dict())).alias("value"))
    config_row.coalesce(1).write.text(f"{path}/config")


def check_model(table: DataFrame, config: ModelConfig) -> DataFrame:
    """One row: rows, cells and whether their shape fits the configuration."""
    shape = table.agg(
        F.count("*").alias("token_rows"),
        F.count_distinct("token_id").alias("ids"),
        F.sum(F.size("vec")).alias("cells"),
        F.count_if(F.size("vec") != config.embedding_dim).alias("misshapen"),
        F.count_if((F.col("token_id") < 0) | (F.col("token_id") >= config.vocab_size)).alias("out_of_range"),
    )
    fits = (
        (F.col("cells") == config.vocab_size * config.embedding_dim)
        & (F.col("token_rows") == config.vocab_size)
        & (F.col("ids") == config.vocab_size)
        & (F.col("misshapen") == 0)
        & (F.col("out_of_range") == 0)
    )
    return shape.withColumn("valid", F.coalesce(fits, F.lit(False)))


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, ModelConfig]:
    """Table and configuration; a bad configuration or a table of another size raises."""
    text = spark.read.text(f"{path}/config", wholetext=True).first()[0]
    config = ModelConfig(**json.loads(text))
    table = spark.read.parquet(f"{path}/token_embeddings")
    found = check_model(table, config).first()
    if not found["valid"]:
        raise ValueError(f"invalid token table in {path}: {found}")
    return table, config
