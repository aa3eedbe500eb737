"""Sum-of-squares packing of tokenized documents into windows.

Every task packs its own documents as they come. The window levels (how full
a partly filled window is) are counted in one array; a document goes to the
level, or to a new window, for which the sum of squared counts of partly
filled windows grows least. A document longer than a window first fills whole
windows; its rest is placed. Since no whole document may fit the gaps that
are left, at most ``open_windows`` stay open: beyond that a document is cut to
close the window with the largest gap it can fill. Windows still open when the
task ends stay together: the emptiest are taken apart to fill the gaps of the
fullest. What is left of one window at last becomes
sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pairscreen.llm.arrays import giving_back, small_batches, text_array
from pairscreen.llm.tokens import Encoder

WINDOW = 4096
END_ID = 2
OPEN_WINDOWS = 512

PIECES = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Windows of one task. A piece is (document, start, ids); a document is
    any object, with its number of ids."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, first_id: int = 0):
        if window < 1 or open_windows < 1:
            raise ValueError("window and open_windows must be at least 1")
        self.window, self.limit, self.next_id = window, open_windows, first_id
        self.counts = np.zeros(window + 1, np.int64)  # open windows by level
        self.at: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.moved = 0

    def _level(self, size: int) -> int:
        """The level to put ``size`` ids on: 0 for a new window. The fullest
        of equally good levels."""
        room = self.window - size
        levels = np.flatnonzero(self.counts[:room + 1])
        after = self.counts[levels + size]
        grown = 2 * after + (levels + size < self.window) - 2 * self.counts[levels] + 1
        fresh = 2 * self.counts[size] + (size < self.window)
        if len(levels) and grown.min() <= fresh:
            return int(levels[len(levels) - 1 - np.argmin(grown[::-1])])
        return 0

    def _put(self, level: int, piece: tuple) -> Iterator[tuple]:
        if level:
            pieces = self.at[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        level += len(piece[2])
        if level == self.window:
            yield from self._emit(pieces)
        else:
            self.at[level].append(pieces)
            self.counts[level] += 1
            self.n_open += 1

    def _emit(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for document, start, ids in pieces:
            yield document, start, ids, self.next_id, offset
            offset += len(ids)
        self.next_id += 1

    def add(self, document, ids: np.ndarray) -> Iterator[tuple]:
        """Place a document; yields (document, start, ids, sequence, offset)
        of the windows that this fills."""
        start, size = 0, len(ids)
        while size - start >= self.window:
            yield from self._emit([(document, start, ids[start:start + self.window])])
            start += self.window
        while start < size:
            level = self._level(size - start)
            end = size
            if not level and self.n_open >= self.limit:
                # the emptiest window that the rest fills up
                level = int(np.flatnonzero(self.counts[self.window - (size - start):])[0]) + self.window - (
                    size - start) if self.counts[self.window - (size - start):].any() else 0
                end = start + self.window - level if level else size
            yield from self._put(level, (document, start, ids[start:end]))
            start = end

    def close(self) -> Iterator[tuple]:
        """Windows still open, the fullest filled up from the emptiest, and the
        last one's rest as a tail of powers of two. ``moved`` counts the ids
        that change their window."""
        left = deque(w for level in range(self.window, 0, -1) for w in self.at[level])
        while left:
            pieces = left.popleft()
            gap = self.window - sum(len(p[2]) for p in pieces)
            while gap and left:
                document, start, ids = left[-1].pop()
                cut = max(0, len(ids) - gap)
                pieces.append((document, start + cut, ids[cut:]))
                gap -= len(ids) - cut
                self.moved += len(ids) - cut
                if cut:
                    left[-1].append((document, start, ids[:cut]))
                if not left[-1]:
                    left.pop()
            if gap:
                yield from self._tail(pieces, self.window - gap)
            else:
                yield from self._emit(pieces)
        self.counts[:] = 0
        self.at = [[] for _ in range(self.window + 1)]
        self.n_open = 0

    def _tail(self, pieces: list, total: int) -> Iterator[tuple]:
        """Pieces cut into sequences of powers of two, the largest first."""
        queue = deque(pieces)
        for bit in reversed(range(total.bit_length())):
            size, taken = total & 1 << bit, []
            while size:
                document, start, ids = queue.popleft()
                taken.append((document, start, ids[:size]))
                if len(ids) > size:
                    queue.appendleft((document, start + size, ids[size:]))
                size -= len(taken[-1][2])
            if taken:
                yield from self._emit(taken)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = END_ID, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids`` (little-endian
    32-bit), ``doc_tokens`` (with ``end_id``), ``sequence_id, offset``.

    Without a shuffle: each task packs the rows of its input partition, and
    numbers sequences below its partition number. A task holds at most
    ``open_windows`` windows and one batch. NULL text is empty: such a document
    is its ``end_id`` alone. Rows with equal or NULL ids are documents of their
    own. Other columns are ignored. No rows give no pieces. A window of a power
    of two makes every sequence ``window`` ids or a smaller power of two;
    otherwise the last sequence of a task may need padding.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        packer = Packer(window, open_windows, TaskContext.get().partitionId() << 36)
        rows: list[tuple] = []
        id_type = None

        def out() -> pa.RecordBatch:
            got = pa.record_batch([
                pa.array([r[0][0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([len(r[2]) for r in rows], pa.int64()),
                pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()),
                pa.array([r[0][1] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return got

        for batch in batches:
            texts, keys = text_array(batch.column(1)), batch.column(0)
            id_type = keys.type
            step = 512
            for a in range(0, len(texts), step):
                found = encoder.ids(texts.slice(a, step))
                for key, ids in zip(keys.slice(a, step).to_pylist(), found):
                    ids = np.append(ids, np.uint32(end_id))
                    rows.extend(packer.add((key, len(ids)), ids))
                if len(rows) >= 2000:
                    yield out()
        rows.extend(packer.close())
        if rows:
            yield out()

    return docs.select(id_col, text_col).mapInArrow(giving_back(run), PIECES.format(id=kind))
