"""Decoding of 32-byte hex words found in chain logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 64
TWO_64 = "18446744073709551616"


def word_at(data: Column, index: Column | int) -> Column:
    """The ``index``-th 64-digit word after the ``0x`` prefix."""
    start = F.lit(3) + (F.lit(index) if isinstance(index, int) else index) * WORD
    return F.substring(data, start, F.lit(WORD))


def address(topic: Column) -> Column:
    return F.lower(F.concat(F.lit("0x"), F.right(topic, F.lit(40))))


def small_number(word: Column) -> Column:
    """Word as DECIMAL(38,0); NULL when it is no hex word or needs more than 38 digits."""
    part = lambda start: F.conv(F.substring(word, F.lit(start), F.lit(16)), 16, 10).cast("decimal(20,0)")
    high = F.try_multiply(part(33), F.lit(TWO_64).cast("decimal(20,0)"))
    value = F.try_add(high, part(49)).cast("decimal(38,0)")
    return F.when(word.rlike("^0{32}[0-9a-fA-F]{32}$"), value)


def as_long(word: Column) -> Column:
    return small_number(word).try_cast("bigint")


@F.pandas_udf(T.StringType())
def big_number(words: pd.Series) -> pd.Series:
    """Any 256-bit word as decimal text. Token ids exceed every numeric type, so they stay text."""
    return words.map(lambda w: str(int(w, 16)) if w else None)


def scaled(word: Column, decimals: int = 6) -> Column:
    return small_number(word).cast("double") / F.lit(float(10 ** decimals))
