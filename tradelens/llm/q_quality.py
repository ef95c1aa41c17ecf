"""Query of the quality scores; a trained model, so tests hold it against held-out labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm.common import fold, table
from tradelens.llm.quality import CUTOFF, fit, scores
from tradelens.llm.registry import query


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id", 4) != 2)
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
