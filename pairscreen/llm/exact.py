"""Exact duplicates by progressive refinement, with built-in functions only.

Rows are grouped by length, then by the hash of a prefix, and only rows that
share both with another have their whole content hashed. Which rows those are
goes to the scan as a bit map of fixed size, so texts are never shuffled: a bit set by
mistake costs one more hash and changes no result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscreen.session import materialize

#: Characters of the prefix that is hashed before the whole text.
PREFIX = 256
#: Bits of the map of shared (length, prefix) cells: 8 MB, whatever the input.
MAP_BITS = 1 << 26


def _position(size: str, prefix: str) -> Column:
    """Place of a cell in the bit map, from 1."""
    return F.pmod(F.xxhash64(size, prefix), F.lit(MAP_BITS)) + 1


def bit_map(cells: DataFrame) -> DataFrame:
    """``bucket, bits``: at most MAP_BITS / 32768 rows of 4 KB."""
    placed = cells.select(_position("size", "prefix").alias("at")).distinct()
    return placed.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def _is_set(bits: Column, at: Column) -> Column:
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def shared_cells(rows: DataFrame) -> DataFrame:
    """``size, prefix`` of the cells that hold several rows: first among rows of
    a shared length, then of a shared prefix hash. Rows are combined before
    each shuffle, so a cell that holds a third of them costs one row a task."""
    cells = materialize(rows.groupBy("size", "prefix").agg(F.count("*").alias("rows")), "cells")
    lengths = cells.groupBy("size").agg(F.sum("rows").alias("n")).filter("n > 1").select("size")
    return cells.join(lengths, "size", "left_semi").filter("rows > 1").select("size", "prefix")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     carried: Mapping[str, Column] | None = None) -> DataFrame:
    """``id_col, keep_id, group_size, kept`` for every row, and the ``carried``
    columns (any expressions of the row; carry the text to get it back).

    Rows are equal when their texts are, byte for byte; NULL text is empty. Of
    equal rows the one with the largest id stays; rows of that same id are repeats of each
    other, of which exactly one is kept. A NULL id is smaller than any other, so
    ``keep_id`` is NULL only if no row of the group has an id. Very long texts are
    read whole when they share length and prefix. An empty table gives no rows;
    columns that are not carried do not matter, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keys = [F.octet_length(text).alias("size"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("prefix")]
    shared = bit_map(shared_cells(docs.select(*keys)))
    carried = dict(carried or {})
    # of the input, only named values stay, so that no column can clash
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), *[c.alias(f"c{i}") for i, c in enumerate(carried.values())]).alias("own"),
                       text.alias("whole"), *keys).withColumn("at", _position("size", "prefix"))
    # at most MAP_BITS / 8 bytes, so broadcast at any size of the input
    known = rows.join(F.broadcast(shared), F.bitmap_bucket_number("at") == F.col("bucket"), "left")
    read = materialize(known.select(
        "own", "size", "prefix", F.when(_is_set(F.col("bits"), F.col("at")), F.sha2("whole", 256)).alias("full"),
        F.monotonically_increasing_id().alias("row")), "refined")
    groups = materialize(read.filter("full is not null").groupBy("size", "prefix", "full").agg(
        F.max(F.struct(F.col("own.id").alias("id"), F.col("row").alias("row"))).alias("best"), F.count("*").alias("n")).filter("n > 1"), "groups")
    alone = read.filter("full is null").select("own", "row", F.lit(None).cast(groups.schema["best"].dataType).alias("best"),
                                               F.lit(None).cast("long").alias("n"))
    met = read.filter("full is not null").join(groups, ["size", "prefix", "full"], "left").select("own", "row", "best", "n")
    return alone.unionByName(met).select(
        F.col("own.id").alias(id_col), F.when(F.col("n").isNull(), F.col("own.id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("best.row"))).alias("kept"),
        *[F.col(f"own.c{i}").alias(name) for i, name in enumerate(carried)])
