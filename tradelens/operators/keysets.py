"""Semi and anti restrictions, backlogs and one-row lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def only_keys(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def without_keys(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(known.select(*keys), list(keys), "left_anti")


def newest_missing(df: DataFrame, known: DataFrame, key: str, ts: str, limit: int) -> DataFrame:
    """Keys with no entry in ``known``, most recently seen first."""
    seen = df.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max(ts).alias("last_seen"))
    return without_keys(seen, known, [key]).orderBy(F.desc("last_seen"), key).limit(limit)


def with_benchmark(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row as scalar subqueries."""
    return df.select("*", *[benchmark.select(c).scalar().alias(c) for c in benchmark.columns])
