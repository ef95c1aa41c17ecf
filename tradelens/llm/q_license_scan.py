"""Query of the license scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradelens.llm.common import table
from tradelens.llm.license_scan import COVER, LICENSES, MERGE, PHRASES, scan
from tradelens.llm.registry import query

_TEMPLATES = ", ".join(f"({i}, '{t.label}', '{t.words}', {i < len(PHRASES)}, {t.exact})" for i, t in enumerate([*PHRASES, *LICENSES]))

#: ``chains`` holds each match with every length of a chain that may end there: forward in text and template, at most MERGE diagonals a step.
SQL = rf"""
WITH RECURSIVE lowered AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT r, doc_id, regexp_extract_all(t, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM lowered),
grams AS (SELECT r, unnest(range(len(w) - 1)) AS p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words),
given(id, label, phrase, base, exact) AS (VALUES {_TEMPLATES}),
templates AS (SELECT *, len(string_split(phrase, ' ')) - 1 AS pairs, CASE WHEN exact THEN 1 ELSE {COVER} END AS needed FROM given),
positions AS (SELECT id, unnest(range(len(x) - 1)) AS tpos, unnest(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS g
              FROM (SELECT id, string_split(phrase, ' ') AS x FROM templates)),
matches AS (SELECT r, id, p, tpos, p - tpos AS diag FROM grams JOIN positions USING (g)),
marked AS (SELECT d.*, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, id ORDER BY diag) <= CASE WHEN t.exact THEN 0 ELSE {MERGE} END THEN 0 ELSE 1 END AS fresh
           FROM (SELECT DISTINCT r, id, diag FROM matches) d JOIN templates t USING (id)),
spanned AS (SELECT *, sum(fresh) OVER (PARTITION BY r, id ORDER BY diag) AS span FROM marked),
placed AS (SELECT r, id, span, p, tpos, diag FROM matches JOIN spanned USING (r, id, diag)),
promising AS (SELECT r, id, span FROM placed JOIN templates USING (id) GROUP BY r, id, span HAVING count(DISTINCT tpos) / any_value(pairs) >= any_value(needed)),
hopeful AS (SELECT * FROM placed SEMI JOIN promising USING (r, id, span)),
chains AS (SELECT r, id, span, p, tpos, diag, 1 AS n FROM hopeful
  UNION SELECT m.r, m.id, m.span, m.p, m.tpos, m.diag, c.n + 1 FROM chains c JOIN hopeful m ON m.r = c.r AND m.id = c.id AND m.span = c.span AND m.p > c.p AND m.tpos > c.tpos AND abs(m.diag - c.diag) <= {MERGE}),
spans AS (SELECT r, id, any_value(label) AS label, any_value(base) AS base, min(diag) AS start, max(n) / any_value(pairs) AS share, any_value(needed) AS needed FROM chains JOIN templates USING (id) GROUP BY r, id, span),
good AS (SELECT * FROM spans WHERE share >= needed),
per AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
        FROM good GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM words LEFT JOIN per USING (r)
"""


@query("op1_license_scan", SQL)
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
