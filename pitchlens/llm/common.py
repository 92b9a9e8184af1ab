"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, for expressions that name it repeatedly."""
    return F.element_at(F.transform(F.array(value), use), 1)


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores before it until no column in ``taken`` has the name."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted


def among(rows: DataFrame, key: Column, keys: DataFrame, most_bits: int = 1 << 26) -> DataFrame:
    """Add ``_maybe`` to ``rows``: false only where ``key`` is certainly not in ``keys``.

    ``keys`` has one long column. It is hashed into a bitmap, a table of at most ``most_bits`` / 64 rows
    (a million), which is joined by broadcast; few keys make a small one, very many only make it tell
    less. For rows that would be shuffled for a join in vain.
    """
    wanted = keys.count() * 16 // 64
    words = 1 << (max(16, min(most_bits // 64, wanted)) - 1).bit_length()

    def place(value: Column) -> tuple[Column, Column]:
        mixed = F.xxhash64(value)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), mixed.bitwiseAND(F.lit(63)).cast("int"))
        return F.pmod(F.shiftright(mixed, 6), F.lit(words)), bit

    word, bit = place(keys[keys.columns[0]])
    bitmap = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    word, bit = place(key)
    marked = rows.withColumn("_at", word).join(F.broadcast(bitmap), F.col("_at") == F.col("_word"), "left")
    known = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.withColumn("_maybe", known).drop("_at", "_word", "_bits")


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def component_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of ``n`` nodes under the links ``a``-``b``."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        low, high = np.minimum(la, lb)[open_], np.maximum(la, lb)[open_]
        np.minimum.at(label, high, low)
        while not np.array_equal(up := label[label], label):
            label = up
