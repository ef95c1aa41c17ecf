"""Query of the sharding. DuckDB has no crc32, so the tests hold it against a plain Python version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradelens.llm.common import table
from tradelens.llm.registry import query
from tradelens.llm.sharding import shard_slots


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_slots(table(spark, sf_dir, "documents"), shards=8)
