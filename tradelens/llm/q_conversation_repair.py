"""Query of the conversation repair. The SQL walks each conversation row by row and keeps the cheapest, least audit of each state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradelens.llm.common import table
from tradelens.llm.conversation_repair import DELETE, INSERT, REROLE, repaired
from tradelens.llm.registry import query


def _best(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _add(way: str, cost: str, letter: str, line: str | None) -> str:
    text = f"{way}.t" if line is None else f"list_append({way}.t, {line})"
    return f"struct_pack(c := {way}.c + {cost}, a := {way}.a || '{letter}', t := {text})"


def _row() -> str:
    keep = lambda way, initial: _add(way, f"CASE WHEN gone OR initial <> '{initial}' THEN 1000000000 ELSE late END", "K", "role || ':' || text")
    rerole = lambda way, role: _add(way, f"CASE WHEN gone THEN 1000000000 ELSE {REROLE} + late END", "R", f"'{role}:' || text")
    delete = lambda way: _add(way, str(DELETE), "D", None)
    return ", ".join([
        f"{delete('s0')} AS s0", f"{_best(delete('s1'), keep('s0', 's'))} AS s1",
        f"{_best(delete('i2'), *[f(w, x) for w in ('s0', 's1', 'i3') for f, x in ((keep, 'u'), (rerole, 'user'))])} AS s2",
        f"{_best(delete('i3'), keep('i2', 'a'), rerole('i2', 'assistant'))} AS s3",
    ])


_FAR = "struct_pack(c := 1000000000, a := '', t := []::VARCHAR[])"
_I2 = _best("s2", *[_add(f"s{k}", str(INSERT), "I", "'user:'") for k in (0, 1, 3)])
_I3 = _best("s3", _add("i2", str(INSERT), "I", "'assistant:'"))

SQL = rf"""
WITH RECURSIVE bits AS (SELECT range AS i, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS draw
  FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE draw <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) AS p, left(role, 1) AS initial,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM damaged),
marked AS (SELECT *, final = '' AS blank, final <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS dup,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY p) || initial AS pair FROM placed),
faulty AS (SELECT *, NOT blank AND NOT dup AND final NOT IN ('.', '!', '?') AS cut, blank OR dup AS gone FROM marked),
lines AS (SELECT conv_id, p, role, text, initial, gone, cut::INT AS late FROM faulty),
walk AS (SELECT conv_id, 0::BIGINT AS p, struct_pack(c := 0, a := '', t := []::VARCHAR[]) AS s0, {_FAR} AS s1, {_FAR} AS s2, {_FAR} AS s3 FROM (SELECT DISTINCT conv_id FROM lines)
  UNION ALL SELECT conv_id, p, {_row()}
  FROM (SELECT *, {_I3} AS i3 FROM (SELECT w.conv_id, l.p, l.role, l.text, l.initial, l.gone, l.late, s0, s1, s2, s3, {_I2} AS i2
        FROM walk w JOIN lines l ON w.conv_id IS NOT DISTINCT FROM l.conv_id AND l.p = w.p + 1))),
ended AS (SELECT conv_id, {_best('s0', 'i3')} AS best FROM (SELECT *, {_I3} AS i3 FROM (SELECT *, {_I2} AS i2 FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1))),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op11_conversation_repair", SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
