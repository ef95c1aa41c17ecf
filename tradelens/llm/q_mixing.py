"""Query of the source mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradelens.llm.common import table
from tradelens.llm.mixing import mix, offset
from tradelens.llm.registry import query

MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {{documents}}),
per AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
        FROM d GROUP BY source),
filled AS (SELECT *, source_size * 3 AS bound,
    ((sum(source_size) OVER ())::BIGINT - coalesce((sum(source_size * 3) OVER upto)::BIGINT, 0))::DOUBLE
    / ((sum(weight) OVER ())::BIGINT - coalesce((sum(weight) OVER upto)::BIGINT, 0))::DOUBLE AS level
  FROM per WINDOW upto AS (ORDER BY (source_size * 3)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(bound::DOUBLE, max(level) OVER () * weight) AS target FROM filled),
ranked AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)),
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % greatest(1, (n + 4095) // 4096), size, doc_id NULLS FIRST) AS rank
  FROM d, (SELECT count(*) AS n FROM d)),
mixed AS (SELECT r.doc_id, r.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END AS rate, rank
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, least((floor(rank * rate + {offset()}) - floor((rank - 1) * rate + {offset()}))::BIGINT, 3) AS copies FROM mixed)
"""


@query("op3_source_mixing", MIX_SQL.format(documents="documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM taken")
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
