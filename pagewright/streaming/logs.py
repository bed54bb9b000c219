"""Run logs and page outcomes as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.probe import parse


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of text files that appear under path, parsed; a torn last line lacks its last keys."""
    return parse(spark.readStream.text(path).withColumnRenamed("value", "line"))


def keep_better(old: DataFrame, new: DataFrame) -> DataFrame:
    """One outcome (page, outcome, version) a page: a translated page is never replaced by a worse outcome; else the latest version counts."""
    both = old.unionByName(new)
    good = (F.col("outcome") == "Translated").cast("int")
    first = F.row_number().over(Window.partitionBy("page").orderBy(good.desc(), F.desc("version"), "outcome"))
    return both.withColumn("__n", first).where("__n = 1").drop("__n")
