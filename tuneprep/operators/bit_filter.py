"""A filter of bounded size that tells, where rows are read, which of them can match a large table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.session import materialise

# Two bits are set for a key; with so many bits for each, about 1.4 % of other keys pass.
BITS_PER_KEY = 16
# 8 MiB. A table of more than MAX_BITS / BITS_PER_KEY keys lets more rows pass, and loses none.
MAX_BITS = 1 << 26
WORD = 64


def _places(key: Column, bits: int) -> list[Column]:
    """The two bits of a key, from the lower and the upper half of its hash."""
    hashed = F.xxhash64(key)
    halves = [hashed, F.shiftrightunsigned(hashed, 32)]
    return [half.bitwiseAND(F.lit(bits - 1).cast("bigint")) for half in halves]


def bits_for(keys: int, most: int = MAX_BITS) -> int:
    """The size of the filter for so many keys: a power of two from one word to ``most``."""
    wanted = max(WORD, keys * BITS_PER_KEY)
    return min(most, 1 << (wanted - 1).bit_length())


def bit_filter(table: DataFrame, key: str, keys: int, most: int = MAX_BITS) -> tuple[Column, int]:
    """The filter of a table's keys, as a scalar column, and its size in bits.

    ``keys`` is a measured number of rows; a wrong one costs precision only. Words are
    combined in the map tasks, so a task sends at most ``most / 64`` of them. Null keys
    set no bit, and an empty table gives a filter that nothing passes.
    """
    bits = bits_for(keys, most)
    places = table.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits))).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(F.lit(WORD - 1)).cast("int"))
    words = places.groupBy(F.floor(F.col("place") / WORD).alias("word")).agg(F.bit_or(one).alias("set"))
    dense = table.sparkSession.range(bits // WORD).withColumnRenamed("id", "word").join(words, "word", "left")
    entry = F.struct("word", F.coalesce("set", F.lit(0).cast("bigint")).alias("set"))
    whole = dense.agg(F.sort_array(F.collect_list(entry)).alias("words"))
    return materialise(whole.select(F.col("words.set").alias("words")), "bit-filter").scalar(), bits


def may_match(key: Column, bit_filter: tuple[Column, int]) -> Column:
    """Whether a key can be in the table; true for all that are. A null key cannot."""
    words, bits = bit_filter

    def is_set(place: Column) -> Column:
        word = F.get(words, F.floor(place / WORD).cast("int"))
        return F.call_function("getbit", word, place.bitwiseAND(F.lit(WORD - 1)).cast("int")) == 1

    first, second = _places(key, bits)
    return key.isNotNull() & is_set(first) & is_set(second)
