"""Near-duplicates by HyperMinHash sketches, confirmed on whole shingle sets.

Each set of word shingles is hashed into 128 buckets; a bucket keeps the
leading-zero count and ten more bits of its least hash. Documents with equal
sets are one class. Classes that agree on a band of four registers are
candidates; the Jaccard estimate from all registers, less the agreement
expected by chance, drops hopeless ones, and the rest is counted on full sets.

No group is paired with itself: a band's classes are first compared with one
of them only, the one that shares most bands with others (an original rather
than one of its copies). Classes that are connected need no more work, so after
some rounds few bands have classes in several components; these are compared
in blocks, each pair in the first band that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscreen.llm import arrays, exact
from pairscreen.llm.graph import components
from pairscreen.session import Scratch, materialize, release_shuffles

WORDS = 5
PERCENT = 80
REGISTERS = 128
BAND = 4  # registers of a band
MANTISSA = 10
_EMPTY = 0xFFFF
_HASH_BITS = 52
#: Standard errors below the limit that an estimate may lie. With 128 filled registers
#: a pair at 0.8 falls below them with a probability of 2.1e-7 (binomial tail).
SLACK = 5.5
#: Classes of a band compared by one task at once.
BLOCK = 512
#: Rounds of comparing the classes of a band with one of them.
ROUNDS = 1


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, and their rows."""
    data, offsets = arrays.buffer(texts)
    found = arrays.shingles(*arrays.words(data, offsets), len(texts), k)
    return arrays.distinct(*found, len(texts))


def digests(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of every row's set, whatever its order."""
    edges = arrays.row_starts(rows, n)
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(arrays.mix(values ^ np.uint64(salt)), out=sums[1:])
        out.append(arrays.mix(sums[edges[1:]] - sums[edges[:-1]]).view(np.int64))
    return out[0], out[1]


def registers(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """[n, REGISTERS] registers; _EMPTY where no shingle fell."""
    mixed = arrays.mix(values + np.uint64(0x632BE59BD9B4E019))
    least = np.full(n * REGISTERS, 1 << _HASH_BITS, np.uint64)
    bucket = (mixed >> np.uint64(57)).astype(np.int64) % REGISTERS
    np.minimum.at(least, rows * REGISTERS + bucket, mixed & np.uint64((1 << _HASH_BITS) - 1))
    bits = np.frexp(least.astype(np.float64))[1]
    zeros = np.maximum(_HASH_BITS - bits, 0)
    top = least << zeros.astype(np.uint64)
    tail = (top >> np.uint64(_HASH_BITS - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    code = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | tail).astype(np.uint16)
    code[least >> np.uint64(_HASH_BITS) > 0] = _EMPTY
    return code.reshape(n, REGISTERS)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of ``n`` and ``m``
    shingles agree: with hash density x*y/(x+y)^2 and cells 2^-MANTISSA wide."""
    return 0.6797 * 2.0 ** -MANTISSA * n * m / np.square(n + m)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, corrected for chance, and the
    number of registers they rest on."""
    filled = (a != _EMPTY) | (b != _EMPTY)
    used = np.maximum(filled.sum(axis=-1), 1)
    agreed = ((a == b) & filled).sum(axis=-1)
    by_chance = chance(n.astype(float), m.astype(float))
    return (agreed / used - by_chance) / (1 - by_chance), used


def hopeful(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that may reach the limit: by size for certain, by estimate within SLACK."""
    t = percent / 100
    found, used = estimate(a, b, n, m)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (found >= t - SLACK * np.sqrt(t * (1 - t) / used))


def synthetic(digest: np.ndarray) -> np.ndarray:
    """Node of documents without an id, below zero."""
    return -1 - (digest.view(np.uint64) >> np.uint64(1)).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``id, node, n, d1, d2, regs`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrays.text_array(batch.column(1))
            for a, b in arrays.chunks(texts):
                values, rows = shingle_sets(texts.slice(a, b - a), k)
                d1, d2 = digests(values, rows, b - a)
                regs = registers(values, rows, b - a)
                ids = batch.column(0).slice(a, b - a)
                node = np.where(np.asarray(ids.is_null()), synthetic(d1), np.asarray(ids.fill_null(0)))
                yield pa.record_batch([
                    ids, pa.array(node), pa.array(np.bincount(rows, minlength=b - a)), pa.array(d1), pa.array(d2),
                    pa.array([r.tobytes() for r in regs], pa.binary())], names=["id", "node", "n", "d1", "d2", "regs"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        arrays.giving_back(run), "id long, node long, n long, d1 long, d2 long, regs binary")


def _with_node(df: DataFrame, text: str, k: int) -> DataFrame:
    """Rows without an id, with their node."""

    def node(texts: pa.Array) -> list[pa.Array]:
        texts = arrays.text_array(texts)
        out = np.zeros(len(texts), np.int64)
        for a, b in arrays.chunks(texts):
            out[a:b] = synthetic(digests(*shingle_sets(texts.slice(a, b - a), k), b - a)[0])
        return [pa.array(out)]

    return arrays.add_columns(df, [text], "node long", node)


def _texts(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``node, text`` of all rows; rows without an id are few or none."""
    known = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    unknown = docs.filter(F.col(id_col).isNull()).select(F.col(text_col).alias("text"))
    return known.unionByName(_with_node(unknown, "text", k))


def marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``_may``: false where ``key`` is certainly not among the values of ``wanted``, told by a bit map of
    fixed size. It spares the other rows a shuffle; what is marked by mistake is left to a join."""
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(exact.MAP_BITS)) + 1
    bits = wanted.select(at.alias("_at")).distinct().groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    found = rows.withColumn("_at", at).join(F.broadcast(bits), F.bitmap_bucket_number("_at") == F.col("_bucket"), "left")
    return found.withColumn("_may", exact._is_set(F.col("_bits"), F.col("_at"))).drop("_at", "_bucket", "_bits")


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of classes that their sketches allow."""
    one = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    two = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ra, rb = batch.columns
            keep = pa.array(hopeful(_regs(ra), _regs(rb), np.asarray(na), np.asarray(nb), percent))
            yield pa.record_batch([a.filter(keep), b.filter(keep)], names=["a", "b"])

    joined = pairs.join(one, "a").join(two, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(arrays.giving_back(run), "a long, b long").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (arrays.text_array(batch.column(i)) for i in (2, 3))
            linked = np.zeros(batch.num_rows, bool)
            for a, b in arrays.chunks(two):
                left, right = shingle_sets(one.slice(a, b - a), k), shingle_sets(two.slice(a, b - a), k)
                le, re = arrays.row_starts(left[1], b - a), arrays.row_starts(right[1], b - a)
                for i in range(b - a):
                    x, y = left[0][le[i]:le[i + 1]], right[0][re[i]:re[i + 1]]
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    linked[a + i] = common > 0 and 100 * common >= percent * (len(both) - common)
            keep = pa.array(linked)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(arrays.giving_back(run), "a long, b long")


def _blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of every group ``key, i, j``: blocks ``i`` and ``j`` of a band;
    ``part`` says which a row is of. No group exceeds two blocks."""
    size = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = rows.join(size, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "band", "part", "node", "comp", *columns)


def _partners(x: int, right: np.ndarray, inside: bool, node: np.ndarray, comp: np.ndarray, n: np.ndarray, regs: np.ndarray,
              band: int, percent: int) -> np.ndarray:
    """Rows of ``right`` to compare row ``x`` with: of other components,
    hopeful, and first met in this band."""
    ys = right[(comp[right] != comp[x]) & ((node[right] > node[x]) if inside else True)]
    if len(ys):
        ys = ys[hopeful(regs[x][None], regs[ys], n[x:x + 1], n[ys], percent)]
    if len(ys):
        bands = regs.reshape(-1, REGISTERS // BAND, BAND)
        same = (bands[x] == bands[ys]).all(axis=2) & (bands[x] != _EMPTY).any(axis=1)
        ys = ys[same.argmax(axis=1) == band]
    return ys


def _undecided(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``key, band, node, comp`` of the classes that have somebody left to be
    compared with in a band."""

    def run(table: pa.Table) -> pa.Table:
        node, comp, n, part = (table.column(c).to_numpy() for c in ("node", "comp", "n", "part"))
        regs = _regs(table.column("regs"))
        first, last, band = (table.column(c)[0].as_py() for c in ("i", "j", "band"))
        left, right = np.flatnonzero(part == first), np.flatnonzero(part == last)
        keep = np.zeros(len(node), bool)
        for x in left.tolist():
            ys = _partners(x, right, first == last, node, comp, n, regs, band, percent)
            if len(ys):
                keep[x] = True
                keep[ys] = True
        return table.select(["key", "band", "node", "comp"]).filter(pa.array(keep))

    sketched = _blocks(rows.join(classes.select("node", "n", "regs"), "node"), ["n", "regs"])
    return sketched.groupBy("key", "i", "j").applyInArrow(run, "key long, band int, node long, comp long").distinct()


def _linked(rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components inside bands, counted on full shingle sets
    where the texts meet, so no pair without a link leaves a task."""

    def run(table: pa.Table) -> pa.Table:
        node, part = (table.column(c).to_numpy() for c in ("node", "part"))
        comp = table.column("comp").to_numpy().copy()
        first, last, band = (table.column(c)[0].as_py() for c in ("i", "j", "band"))
        values, of = shingle_sets(arrays.text_array(table.column("text")), k)
        edges = arrays.row_starts(of, len(node))
        n, regs = np.diff(edges), registers(values, of, len(node))
        left, right = np.flatnonzero(part == first), np.flatnonzero(part == last)
        found = []
        for x in left.tolist():
            own = values[edges[x]:edges[x + 1]]
            for y in _partners(x, right, first == last, node, comp, n, regs, band, percent).tolist():
                if comp[x] == comp[y]:  # linked meanwhile
                    continue
                both = np.concatenate([own, values[edges[y]:edges[y + 1]]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    found.append((node[x], node[y]))
                    comp[comp == comp[y]] = comp[x]
        return pa.table({"a": pa.array([int(a) for a, _ in found], pa.int64()), "b": pa.array([int(b) for _, b in found], pa.int64())})

    return _blocks(rows.join(texts, "node"), ["text"]).groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """``id, node, n, component`` for every row: the size of its set of
    ``k``-word shingles, and the least node that links reach.

    Two documents are linked when ``percent`` of the union of their sets is
    common. A text of fewer than ``k`` words is one shingle; a text without words
    (or NULL) links with nothing. A node is the document's id; rows of one id
    are one document. Rows without an id have a negative node made from their set.
    A pair at the limit is missed with a probability of about 2.6e-7 (README);
    every pair found is confirmed exactly. Other columns are ignored.
    """
    arrays.small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table("sketches", sketches(docs, id_col, text_col, k))
    filled = rows.filter("n > 0")
    # one class for each distinct set; its node is its least document
    classes = scratch.table("classes", filled.groupBy("d1", "d2").agg(
        F.min("node").alias("node"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    placed = materialize(rows.join(classes.select("d1", "d2", F.col("node").alias("class")), ["d1", "d2"], "left").withColumn(
        "class", F.when(F.col("n") > 0, F.col("class"))).select(
        "id", "node", "n", "class"), "classed")
    scratch.drop("sketches")
    release_shuffles(docs.sparkSession)
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62  # smaller sets link to equal ones only
    bytes_ = 2 * BAND
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: F.struct(
        i.alias("i"), F.substring(F.col("regs"), 1 + i * bytes_, F.lit(bytes_)).alias("r")))
    keyed = classes.filter(F.col("n") >= least).select("node", F.explode(bands).alias("band")).filter(
        F.col("band.r") != F.lit(b"\xff" * bytes_)).select(
            F.xxhash64("band.i", "band.r").alias("key"), F.col("band.i").alias("band"), "node")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = scratch.table("shared-bands", keyed.join(sizes, "key"))
    shared = scratch.table("ranked-bands", met.join(met.groupBy("node").agg(F.sum("size").alias("rank")), "node").select(
        "key", "band", "node", "rank"))
    scratch.drop("shared-bands")
    release_shuffles(docs.sparkSession)
    # the texts that any comparison may need, once
    needed = materialize(shared.select("node").distinct(), "needed")
    texts = scratch.table("texts", marked(_texts(docs, id_col, text_col, k), "node", needed).filter("_may").drop("_may").join(
        needed, "node", "left_semi"))
    release_shuffles(docs.sparkSession)
    open_ = shared.withColumn("comp", F.col("node"))
    links = tried = hubs = None
    for _ in range(ROUNDS):
        left = open_ if hubs is None else open_.join(hubs, (F.col("key") == F.col("_key")) & (F.col("node") == F.col("_hub")), "left_anti")
        best = materialize(left.groupBy("key").agg(F.max(F.struct("rank", (-F.col("node")).alias("_n"), "comp")).alias("b")).select(
            F.col("key").alias("_key"), (-F.col("b._n")).alias("_hub"), F.col("b.comp").alias("_comp")), "hubs")
        pairs = open_.join(best, F.col("key") == F.col("_key")).filter("comp <> _comp").select(
            F.least("node", "_hub").alias("a"), F.greatest("node", "_hub").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        found = materialize(_confirmed(materialize(_likely(pairs, classes, percent), "pairs"), texts, k, percent), "links")
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        used = best.select("_key", "_hub")
        hubs = used if hubs is None else hubs.unionByName(used)
        now = shared.join(components(links), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        open_ = materialize(now.join(mixed, "key").select("key", "band", "node", "rank", "comp"), "open-bands")
    scratch.drop("ranked-bands")
    release_shuffles(docs.sparkSession)
    undecided = materialize(_undecided(open_, classes, percent), "undecided")
    scratch.drop("classes")
    release_shuffles(docs.sparkSession)
    links = links.unionByName(materialize(_linked(undecided, texts, k, percent), "links"))
    scratch.drop("texts")
    # rows of one id with several sets hang together
    several = placed.filter("n > 0").groupBy("node").agg(F.min("class").alias("a"), F.max("class").alias("hi")).filter("a < hi")
    same_id = placed.join(several.select("node", "a"), "node").select("a", F.col("class").alias("b")).filter("a <> b")
    found = components(links.unionByName(same_id))
    return placed.join(found.withColumnRenamed("node", "class"), "class", "left").select(
        "id", "node", "n", F.coalesce("component", "class", "node").alias("component"))


def mark(found: DataFrame) -> DataFrame:
    """``id, n, component_id, kept``: the least id of the component (NULL if no
    document of it has one), and whether the row stands for it. In a component
    without ids every row of the least set is kept."""
    ids = found.filter("component < 0 and id is not null").groupBy("component").agg(F.min("id").alias("_least"))
    real = found.join(ids, "component", "left").withColumn(
        "component_id", F.when(F.col("component") >= 0, F.col("component")).otherwise(F.col("_least")))
    return real.select("id", "node", "n", "component_id", F.coalesce(
        F.col("id") == F.col("component_id"),
        F.col("id").isNull() & F.col("component_id").isNull() & (F.col("node") == F.col("component"))).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one document of each component, unchanged.
    Of rows with the same id, or without ids and with the same set, one stays."""
    found = materialize(mark(near_duplicates(docs, id_col, text_col, k, percent)), "near-duplicates")
    # whole rows in one column, so that no column of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = F.col("row").getField(id_col)
    dropped = materialize(found.filter("not kept and id is not null").select("id").distinct(), "dropped")
    repeated = materialize(found.filter("id is not null").groupBy("id").count().filter("count > 1").select("id"), "repeated")
    known = marked(rows.filter(key.isNotNull()).withColumn("id", key.cast("long")), "id", dropped.unionByName(repeated))
    sure = known.filter("not _may").select("row")
    known = known.filter("_may").drop("_may").join(dropped, "id", "left_anti")
    once = sure.unionByName(known.join(repeated, "id", "left_anti").select("row"))
    if not repeated.isEmpty():
        once = once.unionByName(known.join(repeated, "id", "left_semi").dropDuplicates(["id"]).select("row"))
    unknown = _with_node(rows.filter(key.isNull()), f"row.{text_col}", k)
    kept = found.filter("kept and id is null").select("node").distinct()
    once = once.unionByName(unknown.join(kept, "node", "left_semi").dropDuplicates(["node"]).select("row"))
    return once.select("row.*")
