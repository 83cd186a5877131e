"""Bloom filters as column expressions: cells of a key, filters as arrays of words, the test."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 512  # 64-bit words in a page of a filter


def size_for(keys: int, bits_per_key: int, limit_bytes: int) -> int:
    """Cells of a filter: a power of two, at least one page and never over the limit."""
    size = WORDS * 64
    while size < keys * bits_per_key and size * 2 <= limit_bytes * 8:
        size *= 2
    return size


def cells(h: Column, size: int, hashes: int) -> list[Column]:
    """Cells of a 64-bit hash, by double hashing of its halves. ``size`` is a power of two."""
    half = F.lit((1 << 31) - 1)
    a = h.bitwiseAND(half)
    b = F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
    return [(a + b * F.lit(i)).bitwiseAND(F.lit(size - 1)) for i in range(hashes)]


def holds(size: int, words: np.ndarray, hashes: np.ndarray, count: int) -> np.ndarray:
    """Which of the 64-bit hashes are in a filter of ``count`` cells a hash, given whole in numpy."""
    h = hashes.astype(np.uint64)
    a, b = h & np.uint64((1 << 31) - 1), (h >> np.uint64(33)) | np.uint64(1)
    held = np.ones(len(h), bool)
    for i in range(count):
        cell = (a + b * np.uint64(i)) & np.uint64(size - 1)
        held &= (words[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
    return held


def filter_pages(set_cells: DataFrame, size: int) -> DataFrame:
    """(page, words): every page of the filter in which the cells in column ``cell`` are set."""
    words = set_cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell").bitwiseAND(F.lit(63)).cast("int"))
        ).alias("bits")
    )
    spark = set_cells.sparkSession
    bits = F.coalesce("bits", F.lit(0).cast("long")).alias("bits")
    every = spark.range(size // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    return (
        every.groupBy(F.shiftright("word", 9).alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct("word", bits))).alias("w"))
        .select("page", F.col("w.bits").alias("words"))
    )


def whole_filter(set_cells: DataFrame, size: int) -> DataFrame:
    """One row with the filter as an array of pages. Its size is fixed by ``size``."""
    pages = filter_pages(set_cells, size)
    return pages.agg(F.sort_array(F.collect_list(F.struct("page", "words"))).alias("p")).select(
        F.col("p.words").alias("pages")
    )


def is_set(pages: Column, cell: Column) -> Column:
    words = F.get(pages, F.shiftright(cell, 15).cast("int"))
    word = F.get(words, F.shiftright(cell, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int"))
    bit = cell.bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftrightunsigned", word, bit).bitwiseAND(F.lit(1)) == 1
