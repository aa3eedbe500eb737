"""Near-duplicate vectors by cells of spherical k-means.

Equal vectors are one class. Every class belongs to the cell of its nearest
centroid and visits those cells where a vector within the threshold could
live: for unit vectors x, y with homes c, c' and |x - y| <= d, one of them is
within d/2 of the plane between c and c', so each such pair meets in a cell.
Cells are cut into blocks, and blocks are compared as matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscreen.llm.graph import components
from pairscreen.session import materialize

THRESHOLD = 0.95
#: Vectors that centroids are fitted on, the first by hash; every vector is assigned.
SAMPLE = 20_000
PER_CELL = 1024
MOST_CELLS = 4096
#: Rows at home, and visitors, that one task compares at once.
HOME_BLOCK, GUEST_BLOCK = 2048, 8192
TILE = 256
ROUNDS = 8


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def fit_centroids(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means of unit rows; an empty cell takes the row that its
    own centroid serves worst."""
    k = max(1, min(k, len(x)))
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = x @ centroids.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norms < 1e-12)
        worst = np.argsort(near[np.arange(len(x)), home])[:len(empty)]
        sums[empty], norms[empty] = x[worst], 1.0
        centroids = sums / norms[:, None]
    return centroids


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _margin(x: np.ndarray, home: np.ndarray, cell: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """How far rows lie on their home's side of its plane with ``cell``, times
    the centroids' distance. Row by row, so that every task gets the same bits."""
    return np.einsum("ij,ij->i", x, centroids[home]) - np.einsum("ij,ij->i", x, centroids[cell])


def _visits(x: np.ndarray, home: np.ndarray, cell: np.ndarray, centroids: np.ndarray, reach: float) -> np.ndarray:
    apart = centroids[home] - centroids[cell]
    return _margin(x, home, cell, centroids) <= reach * np.sqrt(np.einsum("ij,ij->i", apart, apart)) + 1e-9


def _reach(threshold: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * threshold)) / 2


def _assign(classes: DataFrame, centroids: np.ndarray, threshold: float) -> DataFrame:
    """``cell, home, node, copies, vector``: each class at home and in the
    cells it visits."""
    reach = _reach(threshold)
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x = units(_matrix(batch.column(2), width))
                near = x @ centroids.T
                home = near.argmax(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * centroids[home] @ centroids.T, 0))
                # a little more than the bound, then exactly
                loose = near[np.arange(len(x)), home][:, None] - near <= reach * apart + 1e-6
                loose[np.arange(len(x)), home] = False
                row, cell = np.nonzero(loose)
                sure = _visits(x[row], home[row], cell, centroids, reach)
                row, cell = row[sure], cell[sure]
                rows = np.concatenate([np.arange(len(x)), row])
                take = pa.array(rows)
                yield pa.record_batch([
                    pa.array(np.concatenate([home, cell]), pa.int32()), pa.array(home[rows], pa.int32()),
                    batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take)],
                    names=["cell", "home", "node", "copies", "vector"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("node", "copies", "vector").mapInArrow(
        run, f"cell int, home int, node long, copies long, vector {kind}")


def _blocks(placed: DataFrame) -> DataFrame:
    """Rows of every group ``cell, i, j``: block ``i`` of the cell's rows at
    home, and block ``j``, at home or visiting; ``slot`` says which a row is of. No
    group exceeds two blocks; a cell with one home block sends its visitors once."""
    at_home = F.col("home") == F.col("cell")
    size = placed.groupBy("cell").agg(
        F.ceil(F.count_if(at_home) / HOME_BLOCK).cast("int").alias("nh"),
        F.ceil(F.count_if(~at_home) / GUEST_BLOCK).cast("int").alias("ng"))
    spot = F.xxhash64("node")
    slotted = placed.join(size, "cell").filter("nh > 0").withColumn("slot", F.when(
        at_home, F.pmod(spot, F.col("nh"))).otherwise(F.col("nh") + F.pmod(spot, F.col("ng"))).cast("int"))
    upto = lambda a, b: F.filter(F.sequence(a, F.greatest(a, b)), lambda v: v <= b)
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    as_left = F.transform(upto(F.col("slot"), F.col("nh") + F.col("ng") - 1), lambda j: pair(F.col("slot"), j))
    as_right = F.transform(upto(F.lit(0), F.least(F.col("slot"), F.col("nh")) - 1), lambda i: pair(i, F.col("slot")))
    return slotted.withColumn("at", F.explode(F.when(at_home, F.concat(as_left, as_right)).otherwise(as_right))).select(
        "cell", "at.i", "at.j", "slot", "home", "node", "copies", "vector")


def local_components(n: int, p: np.ndarray, q: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels after linking rows ``p`` with ``q``: the least of what is linked."""
    while True:
        before = labels.copy()
        low = np.minimum(labels[p], labels[q])
        np.minimum.at(labels, p, low)
        np.minimum.at(labels, q, low)
        np.minimum.at(labels, before, labels)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def _compare(threshold: float, centroids: np.ndarray, one_width: bool):
    """Links inside one pair of blocks of a cell: rows ``a, null, n`` count the
    copies linked to a class, rows ``a, b, 0`` connect classes (fewer than
    the classes, however many the links)."""
    reach = _reach(threshold)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        part, home, node, copies = (table.column(c).to_numpy() for c in ("slot", "home", "node", "copies"))
        here, first, last = (table.column(c)[0].as_py() for c in ("cell", "i", "j"))
        raw = table.column("vector").combine_chunks()
        size = None if one_width else np.diff(raw.offsets.to_numpy())
        x = units(_matrix(raw, centroids.shape[1]))
        rough = x.astype(np.float32)
        at_home = home == here
        left, right = np.flatnonzero(part == first), np.flatnonzero(part == last)
        counts = np.zeros(len(node), np.int64)
        labels = np.arange(len(node))
        for k in range(0, len(left), TILE):
            rows = left[k:k + TILE]
            # single precision drops most pairs, double precision decides
            i, j = np.nonzero(rough[rows] @ rough[right].T >= np.float32(threshold - 1e-4))
            p, q = rows[i], right[j]
            ok = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            if first == last:
                ok &= p < q
            if size is not None:
                ok &= size[p] == size[q]
            p, q = p[ok], q[ok]
            guests = np.flatnonzero(~at_home[q])
            if len(guests):
                # the pair may also meet in the visitor's home: count it in the lower cell
                own, guest = p[guests], home[q[guests]]
                twice = (guest < here) & _visits(x[own], home[own], guest, centroids, reach)
                keep = np.ones(len(p), bool)
                keep[guests[twice]] = False
                p, q = p[keep], q[keep]
            np.add.at(counts, p, copies[q])
            np.add.at(counts, q, copies[p])
            if len(p):
                labels = local_components(len(node), p, q, labels)
        linked, joined = np.flatnonzero(counts), np.flatnonzero(labels != np.arange(len(node)))
        return pa.table({
            "a": np.concatenate([node[linked], node[joined]]),
            "b": pa.array(np.concatenate([np.zeros(len(linked), np.int64), node[labels[joined]]]),
                          mask=np.arange(len(linked) + len(joined)) < len(linked)),
            "n": np.concatenate([counts[linked], np.zeros(len(joined), np.int64)])})

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    per_cell: int = PER_CELL) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row.

    Rows are linked when the cosine, in double precision, is at least
    ``threshold`` (above 0); NULL, empty and zero vectors, and those with NULL or
    non-finite components, link with nothing, nor do vectors of different length.
    Every link is found. ``n_links`` counts other rows; ``component_id`` is the
    least id reachable, ``kept`` says that it is the row's own. Rows without an
    id take part, with NULL as their component unless it has an id; they are
    kept if it has none. Rows of one id hang together. Other columns are
    ignored. Links are counted, never listed: what leaves a block is at most two
    rows for each of its vectors.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    value = F.col("vector")
    read = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    fine = value.isNotNull() & F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(
        value, lambda v: v != 0)
    # adding zero makes -0.0 and 0.0 equal
    plain = F.transform(value, lambda v: v + F.lit(0).cast(df.schema[vector_col].dataType.elementType))
    rows = read.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("vector", F.when(F.col("fine"), plain))
    keyed = rows.withColumns({"h1": F.xxhash64(F.lit(1), "vector"), "h2": F.xxhash64(F.lit(2), "vector")}).withColumn(
        "node", F.coalesce("id", -1 - F.shiftrightunsigned("h1", 1)))
    classes = materialize(keyed.filter("fine").groupBy("h1", "h2").agg(
        F.min("node").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "vectors")
    shape = classes.agg(F.count("*"), F.max(F.size("vector")), F.min(F.size("vector"))).first()
    links = None
    if shape[0]:
        n, width = shape[0], shape[1]
        fit_on = classes.withColumn("_h", F.xxhash64(F.lit(3), "h1")).orderBy("_h", "node").limit(SAMPLE).select("vector").toArrow()
        cells = min(MOST_CELLS, max(1, n // per_cell))
        centroids = fit_centroids(units(_matrix(fit_on.column("vector"), width)), cells)
        placed = materialize(_assign(classes, centroids, threshold), "cells")
        links = materialize(_blocks(placed).groupBy("cell", "i", "j").applyInArrow(
            _compare(threshold, centroids, shape[2] == width), "a long, b long, n long"), "vector-links")
    spark = df.sparkSession
    links = links if links is not None else spark.createDataFrame([], "a long, b long, n long")
    counts = links.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    slim = materialize(keyed.select("id", "node", "fine", "h1", "h2").join(
        classes.select("h1", "h2", F.col("node").alias("class"), "copies"), ["h1", "h2"], "left").select(
            "id", "node", F.when(F.col("fine"), F.col("class")).alias("class"), "copies"), "vector-rows")
    own = F.coalesce("class", "node")
    several = slim.groupBy("node").agg(F.min(own).alias("a"), F.max(own).alias("hi")).filter("a < hi")
    same_id = slim.join(several.select("node", "a"), "node").select("a", own.alias("b")).filter("a <> b")
    found = components(links.filter("b is not null").select("a", "b").unionByName(same_id))
    joined = slim.withColumn("own", own).join(
        counts.withColumnRenamed("a", "own"), "own", "left").join(found.withColumnRenamed("node", "own"), "own", "left").select(
        "id", F.when(F.col("class").isNotNull(), F.coalesce("n", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.coalesce("component", "own").alias("component"))
    least = joined.filter("component < 0 and id is not null").groupBy("component").agg(F.min("id").alias("_least"))
    return joined.join(least, "component", "left").withColumn(
        "component_id", F.when(F.col("component") >= 0, F.col("component")).otherwise(F.col("_least"))).select(
        "id", "n_links", "component_id", F.coalesce(
            F.col("id") == F.col("component_id"), F.col("id").isNull() & F.col("component_id").isNull()).alias("kept"))
