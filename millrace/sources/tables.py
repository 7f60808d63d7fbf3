"""Sources and sinks: tables, generated streams of items, shard folders."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def counter(spark: SparkSession, producers: int, per_producer: int) -> DataFrame:
    """(producer, v): each producer sends 0 to per_producer - 1."""
    ids = spark.range(producers * per_producer)
    return ids.select(F.floor(F.col("id") / per_producer).cast("int").alias("producer"), (F.col("id") % per_producer).alias("v"))


def key_sequence(spark: SparkSession, keys: int, per_key: int) -> DataFrame:
    """(k, seq): seq ascends within each key k0, k1 and so on."""
    ids = spark.range(keys * per_key)
    return ids.select(F.concat(F.lit("k"), (F.col("id") % keys).cast("string")).alias("k"), F.floor(F.col("id") / keys).alias("seq"))


def write_shards(df: DataFrame, path: str) -> None:
    """A folder a shard; reading one shard then prunes the others."""
    df.write.mode("errorifexists").partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("shard") == shard)
