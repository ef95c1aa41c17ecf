"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradelens.llm.common import table
from tradelens.llm.quality_rules import judge
from tradelens.llm.registry import query

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
grams AS (SELECT r, unnest(range(len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM split WHERE len(w) >= 5),
twice AS (SELECT r, p FROM grams JOIN (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1) USING (r, g)),
repeated AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS k FROM twice) GROUP BY r),
counted AS (SELECT s.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                   (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
                   len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_letter, len(list_filter(w, lambda x: regexp_matches(x, '^[^a-z]*[A-Z][^a-z]*$'))) AS n_shouted,
                   len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) AS n_bullet, len(list_filter(l, lambda x: regexp_matches(x, '(?:[.]{3}|\x{2026})[\x20\x09-\x0D]*$'))) AS n_open
            FROM split s LEFT JOIN repeated USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
       NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20 OR word_chars < n_words * 3 OR word_chars > n_words * 10 OR n_symbols * 10 > n_words OR n_dup_lines * 100 > n_lines * 30
            OR n_letter * 100 < n_words * 80 OR n_shouted * 2 > n_words OR n_bullet * 10 > n_lines * 9 OR n_open * 10 > n_lines * 3) AS kept
FROM counted
"""


@query("op13_quality_rules", SQL)
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rejected_by`` is left out, as it names one of several rules by an order that timing decides."""
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")
