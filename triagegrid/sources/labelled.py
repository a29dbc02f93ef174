"""Labelled sets, fixture tickets, probe rows and saved run results."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.schema import LABELLED, PROBE, RUN_RESULT
from triagegrid.sources.ranges import json_items


def read_labelled(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(LABELLED).json(list(paths))


def read_probe(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(PROBE).json(list(paths))


def read_fixture_tickets(spark: SparkSession, path: str, source: str) -> DataFrame:
    """JSON arrays of {id, text}; the id, number or string, becomes external_id.  A file that is no such array holds no tickets."""
    items, _ = json_items(spark, path)
    row = F.from_json("item", "id string, text string")
    return items.select(row.alias("r")).select("r.text", F.lit(source).alias("source"), F.col("r.id").alias("external_id"))


def bakeoff_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved comparison rows, one per model and effort, in JSON arrays."""
    items, _ = json_items(spark, path, nan=True)
    return items.select(F.from_json("item", RUN_RESULT).alias("r")).select("r.*")
