"""Latest row per key: the read side of versioned, upserted tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggregates: dict | None = None,
) -> DataFrame:
    """One whole row per key, the one greatest by ``order`` and then by the remaining columns.

    A greatest struct aggregates on the map side first, so a key that holds a third of the
    table travels as one row per map task. All columns of the result come from the same row.
    ``aggregates`` adds plain aggregates (``{name: Column}``) over every version of the key.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    plain = [f.name for f in df.schema.fields if f.name in rest and f.dataType.typeName() not in ("map", "variant")]
    if len(plain) == len(rest):
        newest = F.max(F.struct(*order, *rest))  # the ordering already holds every column
    else:
        newest = F.max_by(F.struct(*order, *rest), F.struct(*order, *plain))
    aggs = [newest.alias("_row")]
    aggs += [c.alias(name) for name, c in (aggregates or {}).items()]
    shown = [F.col(f"_row.{c}").alias(c) for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*aggs).select(*keys, *shown, *list(aggregates or {}))


def latest_ties(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Every row whose version equals the key's greatest version (ties are kept)."""
    newest = df.groupBy(*keys).agg(F.max(version).alias(version))
    return df.join(newest, [*keys, version], "left_semi")


def replace_versions(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Merge step of an upsert table: union both sides and keep the newest version."""
    return latest_per_key(current.unionByName(incoming), keys, order)
