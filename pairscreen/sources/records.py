"""Records of separated text whose quoted cells may hold line breaks.

A reader that takes such files whole gives one task a whole file. Here every split is read on its
own, although only the text before it tells whether its first line lies inside a cell: each
line is followed under both assumptions until they agree, and the splits' starts are settled
afterwards from one row per split.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairscreen.session import materialize

_ROWS = "file string, block long, n long, value string, begins0 boolean, begins1 boolean, open0 boolean, open1 boolean"


def ends_open(line: Column, sep: str) -> Column:
    """Whether a line that starts a record ends inside a quoted cell. Quotes count only at the start
    of a cell; a doubled quote inside one is text. All loops are possessive, so long lines cost linear time."""
    quoted, mark = '"[^"]*+(?:""[^"]*+)*+', re.escape(sep)
    return line.rlike(rf'^(?:(?:{quoted}")?+(?!")[^{mark}]*+{mark})*+{quoted}\z')


class _Block:
    """Lines of one split in order. While the two assumptions (0: the split starts a record, 1: it
    starts inside a cell) differ, lines pass singly, with their meaning under each; after
    that, whole records pass."""

    def __init__(self, file: str, block: int):
        self.file, self.block, self.n = file, block, 0
        self.states, self.agreed = [False, True], False
        self.open: list[str] = []

    def _rows(self, texts: list[pa.Array], flags: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        value = pa.concat_arrays([t.cast(kind) for t in texts])
        count = len(value)
        n = np.arange(self.n, self.n + count)
        self.n += count
        return pa.RecordBatch.from_arrays(
            [pa.array([self.file] * count, pa.string()), pa.array(np.full(count, self.block)), pa.array(n), value,
             *[pa.array(flags[:, i]) for i in range(4)]],
            names=["file", "block", "n", "value", "begins0", "begins1", "open0", "open1"])

    def feed(self, text: pa.Array, opens: np.ndarray, stays: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``opens``: the line leaves a cell open if it starts a record; ``stays``: if it starts inside a cell."""
        i, total = 0, len(text)
        flags = np.zeros((total, 4), dtype=bool)
        moves = np.flatnonzero(opens | ~stays)
        while i < total and not self.agreed:
            step = int(moves[np.searchsorted(moves, i)]) if len(moves) and moves[-1] >= i else total
            before = [not s for s in self.states]
            flags[i:step] = [*before, *self.states]  # lines up to there change nothing
            if step < total:
                self.states = [bool(stays[step] if s else opens[step]) for s in self.states]
                flags[step] = [*before, *self.states]
                self.agreed = not any(self.states)
            i = min(step + 1, total)
        if i:
            yield self._rows([text.slice(0, i)], flags[:i], text.type)
        texts: list[pa.Array] = []
        starts = np.flatnonzero(opens)
        while i < total:
            if self.open:
                self.open.append(text[i].as_py())
                if not stays[i]:
                    texts.append(pa.array(["\n".join(self.open)], text.type))
                    self.open = []
                i += 1
                continue
            at = int(np.searchsorted(starts, i))
            step = int(starts[at]) if at < len(starts) else total
            if step > i:
                texts.append(text.slice(i, step - i))
            if step < total:
                self.open = [text[step].as_py()]
            i = step + 1
        if texts:
            count = sum(len(t) for t in texts)
            yield self._rows(texts, np.tile([True, True, False, False], (count, 1)), text.type)

    def finish(self) -> Iterator[pa.RecordBatch]:
        """A record that the split leaves open."""
        if self.open:
            yield self._rows([pa.array(["\n".join(self.open)], pa.string())], np.ones((1, 4), dtype=bool), pa.string())


def _follow(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    current: _Block | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        files = batch.column("file").dictionary_encode()
        codes = files.indices.to_numpy(zero_copy_only=False)
        opens, stays = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("opens", "stays"))
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
            file, block = files.dictionary[int(codes[lo])].as_py(), int(blocks[lo])
            if current is None or (current.file, current.block) != (file, block):
                if current is not None:
                    yield from current.finish()
                current = _Block(file, block)
            yield from current.feed(batch.column("value").slice(lo, hi - lo), opens[lo:hi], stays[lo:hi])
    if current is not None:
        yield from current.finish()


def _starting_inside(rows: DataFrame) -> DataFrame:
    """Splits (``file, block``) whose first line lies inside a cell. A split either ends alike under
    both assumptions, or keeps or swaps them, so the last of the first kind and the
    swaps since then settle a start."""
    last = rows.groupBy("file", "block").agg(F.max(
        F.col("n") * 4 + F.col("open0").cast("int") * 2 + F.col("open1").cast("int")).alias("_e"))
    ends = last.select("file", "block", F.col("_e").bitwiseAND(2).cast("boolean").cast("int").alias("e0"),
                       F.col("_e").bitwiseAND(1).cast("int").alias("e1"))
    upto = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    swap = ((F.col("e0") == 1) & (F.col("e1") == 0)).cast("int")
    swapped = ends.withColumn("_s", F.sum(swap).over(upto))
    known = F.last(F.when(F.col("e0") == F.col("e1"), F.col("e0") + F.col("_s")), ignorenulls=True).over(before)
    start = (F.coalesce(known, F.lit(0)) + F.coalesce(F.sum(swap).over(before), F.lit(0))) % 2
    return swapped.withColumn("_start", start).filter("_start = 1").select("file", "block", F.lit(True).alias("_inside"))


def quoted_records(spark: SparkSession, path: str, sep: str = ";", header: bool = True) -> DataFrame:
    """One row ``value`` per record of the files at ``path``, line breaks inside quoted cells kept.

    ``header`` drops each file's first record. Blank records are left out, as is a carriage return at a
    record's end. A cell that is never closed takes the rest of its file. Files are read once and the rows
    written once; only records that cross a split, and lines before a split's
    assumptions agree that start inside a cell, meet in a shuffle.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        ends_open(F.col("value"), sep).alias("opens"),
        ends_open(F.concat(F.lit('"_'), F.col("value")), sep).alias("stays"))
    rows = materialize(lines.mapInArrow(_follow, _ROWS), "records")
    placed = rows.join(_starting_inside(rows), ["file", "block"], "left")
    inside = F.coalesce("_inside", F.lit(False))
    placed = placed.select(
        "file", "block", "n", "value", ((F.col("block") == 0) & (F.col("n") == 0)).alias("first"),
        F.when(inside, F.col("begins1")).otherwise(F.col("begins0")).alias("begins"),
        F.when(inside, F.col("open1")).otherwise(F.col("open0")).alias("open"))
    alone = F.col("begins") & ~F.col("open")
    order = W.partitionBy("file").orderBy("block", "n").rowsBetween(W.unboundedPreceding, 0)
    pieces = placed.filter(~alone).withColumn("record", F.sum(F.col("begins").cast("int")).over(order))
    joined = pieces.groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "n", "value"))).alias("p"), F.max("first").alias("first"))
    whole = placed.filter(alone).select("value", "first").unionByName(
        joined.select(F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"), "first"))
    tidy = whole.filter(~F.col("first")) if header else whole
    return tidy.select(F.regexp_replace("value", r"\r\z", "").alias("value")).filter(F.trim("value") != "")
