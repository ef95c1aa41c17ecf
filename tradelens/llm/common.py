"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks, and the two word classes, of the contracts.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
NON_BLANK_RUN = r"[^\x20\x09-\x0D]+"
WORD_RUN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Maps every ASCII byte outside 0-9 and a-z to a space; bytes of other characters stay.
SEPARATORS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts may be long, so Python tasks take few rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def fold(doc_id: str | Column, parts: int) -> Column:
    """Remainder of crc32 of the id as text; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(parts)).cast("int")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of the class WORD_RUN."""
    return (text or b"").lower().translate(SEPARATORS).split()


def chunks(data: bytes, length: int, overlap: int = 0) -> Iterator[bytes]:
    """The whole of data in pieces of a bounded length."""
    for start in range(0, max(len(data) - overlap, 1), length):
        yield data[start:start + length + overlap]
