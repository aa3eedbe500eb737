"""Words, hashes and runs over whole Arrow text columns, without row loops.

Texts are handled as one UTF-8 buffer with row offsets. A word is a run of
bytes other than space and 0x09-0x0D, which no multi-byte character contains,
so words on bytes and words on characters are the same. NULL counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text handled at once. A longer single text is handled alone.
CHUNK_BYTES = 1 << 20
#: Bytes that Spark hands to a task at once, or one row.
BATCH_BYTES = 8 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by bytes: 10,000 long texts, Spark's
    bound by rows, are too many to hold beside a full heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Hand freed memory back to the system. A worker outlives its task, and the
    C library keeps what was freed between blocks still in use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """``run``, a function over the batches of a task, that leaves no freed
    memory with the worker when the task ends, and finds none: the functions of the task
    before, with the tables they were sent with, are freed only after its end."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # freed Arrow memory goes to the C library, not to a pool of the worker
        pa.set_memory_pool(pa.system_memory_pool())
        give_back()
        try:
            yield from run(batches)
        finally:
            _HELD_POWERS.clear()
            give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


_HELD_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers, kept up to the length of a chunk."""
    held = _HELD_POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 20), base, np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        if len(held) <= CHUNK_BYTES + 1:
            _HELD_POWERS[base] = held
    return held[:n]


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 row offsets."""
    # freed Arrow memory goes back to the system, not to a pool of the worker
    pa.set_memory_pool(pa.system_memory_pool())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes that do not cross rows: starts, ends, rows."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, from one running polynomial."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers(_MULTIPLIER, len(data)), out=sums[1:])
    inverse = _powers(_INVERSE, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, A-Z as a-z."""
    starts, ends, rows = spans(~SPACE[data], offsets)
    return span_hashes(LOWER[data], starts, ends), rows


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets of sorted row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``k`` words; a row of fewer words, but at
    least one, has its whole sequence as one shingle."""
    starts = row_starts(rows, n)
    counts = np.diff(starts)
    m = len(hashes)
    full = np.zeros(0, np.uint64)
    full_rows = np.zeros(0, np.int64)
    if m >= k:
        whole = rows[:m - k + 1] == rows[k - 1:]
        acc = np.zeros(m - k + 1, np.uint64)
        for j in range(k):
            acc = acc * np.uint64(_MULTIPLIER) + hashes[j:m - k + 1 + j]
        full, full_rows = mix(acc[whole] + np.uint64(k)), rows[:m - k + 1][whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    acc = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        more = counts[short] > j
        acc[more] = acc[more] * np.uint64(_MULTIPLIER) + hashes[starts[short[more]] + j]
    out = np.concatenate([full, mix(acc + counts[short].astype(np.uint64))])
    out_rows = np.concatenate([full_rows, short])
    order = np.argsort(out_rows, kind="stable")
    return out[order], out_rows[order]


def distinct(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of every row, sorted inside rows."""
    values = values.copy()
    edges = row_starts(rows, n)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], rows[keep]


def text_array(column: pa.Array) -> pa.Array:
    """One plain array of a column of a record batch."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def add_columns(df: DataFrame, inputs: Sequence[str], fields: str, fn: Callable, drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns that ``fn`` makes from whole input columns (a
    dotted name is a field of a struct), and without those of ``drop``.

    Always one map over batches: an executor keeps idle workers of each kind
    of Python operator, so plans keep to a single kind.
    """
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType([*kept, *T.StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for name in inputs:
                first, _, rest = name.partition(".")
                column = batch.column(first)
                columns.append(pc.struct_field(column, rest) if rest else column)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *fn(*columns)], names=schema.names)

    return df.mapInArrow(giving_back(run), schema)
