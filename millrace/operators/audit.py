"""Audits: no row lost, doubled or out of order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordinals import fresh, most_before


def conservation(sent: DataFrame, done: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, sent, done, sent_sum, done_sum, lost): both sides by group."""
    one = lambda df, a: df.groupBy(*by).agg(F.count(F.lit(1)).alias(a), F.sum(value).cast("long").alias(f"{a}_sum"))
    both = one(sent, "sent").join(one(done, "done"), by, "full_outer")
    filled = both.select(*by, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sent", "done", "sent_sum", "done_sum")])
    return filled.withColumn("lost", F.col("sent") - F.col("done"))


def fifo_violations(df: DataFrame, key: str, place: str, ordinal: str) -> DataFrame:
    """The rows that come, by ``place``, after a row of their key with a larger
    ordinal."""
    (most,) = fresh(df, "most")
    return most_before(df, place, [key], F.col(ordinal), most).where(F.col(most) > F.col(ordinal)).drop(most)


def checksum(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).cast("long").alias("checksum"))
