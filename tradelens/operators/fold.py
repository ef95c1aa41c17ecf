"""Sequential folds as streams over sorted partitions: one row of state per task, whatever the length of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

KINDS = {"double": (DoubleType(), pa.float64()), "bigint": (LongType(), pa.int64()), "boolean": (BooleanType(), pa.bool_()), "string": (StringType(), pa.string())}


def fold_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: dict[str, str],
              start: tuple, step: Callable[[tuple, tuple], tuple[tuple, tuple]]) -> DataFrame:
    """Add the columns ``outputs`` (name: type) that ``step(state, inputs) -> (state, outputs)`` gives along ``order`` of each key.

    All rows of a key pass through one task, as the fold needs them in order, but they are streamed and never gathered. Keys
    may hold nulls. Cut hot keys into segments first where the fold composes.
    """
    return fold_sorted(df.repartition(*keys).sortWithinPartitions(*keys, *[F.asc(o) for o in order]), keys, inputs, outputs, start, step)


def fold_sorted(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], outputs: dict[str, str],
                start: tuple, step: Callable[[tuple, tuple], tuple[tuple, tuple]]) -> DataFrame:
    """``fold_rows`` over rows whose keys are whole in a partition and sorted there."""
    keys, names = list(keys), list(inputs)
    schema = StructType([*df.schema.fields, *[StructField(n, KINDS[k][0]) for n, k in outputs.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = start, None
        for batch in batches:
            column = lambda n, b=batch: b.column(b.schema.get_field_index(n)).to_pylist()
            made = []
            for key, row in zip(zip(*map(column, keys), strict=True), zip(*map(column, names), strict=True), strict=True):
                if key != current:
                    state, current = start, key
                state, out = step(state, row)
                made.append(out)
            added = [pa.array([m[i] for m in made], KINDS[k][1]) for i, k in enumerate(outputs.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *outputs])

    return df.mapInArrow(run, schema)
