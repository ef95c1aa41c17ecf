"""Query of the language identification; a trained model, so tests hold it against held-out documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm.common import fold, table
from tradelens.llm.language_id import fit, identify
from tradelens.llm.registry import query


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learn=fold("doc_id", 5) != 0)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
