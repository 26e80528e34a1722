"""Joins that gather a source row's parts from several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The rows of a query of a database."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def group_join(left: DataFrame, right: DataFrame, key: str, value: str, output: str) -> DataFrame:
    """left with the sorted array of right's values of equal key; empty where there are none."""
    kind = right.schema[value].dataType.simpleString()
    lists = right.where(F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(output))
    return left.join(lists, key, "left").withColumn(output, F.coalesce(F.col(output), F.array().cast(f"array<{kind}>")))
