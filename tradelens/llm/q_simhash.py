"""Query of the SimHash groups. DuckDB has no XXH64, so the tests hold it against all pairs in plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm.common import table
from tradelens.llm.registry import query
from tradelens.llm.simhash import near_groups


@query("op5_simhash_dedup")
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
