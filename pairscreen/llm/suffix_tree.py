"""Language-model scores from a probabilistic suffix tree over words.

Texts are read once into chunks: the distinct word hashes of a chunk, and its
documents as numbers into them. Word counts come from the chunks' distinct
words, and go back to the chunks the same way, so no join sees single tokens.

The tree's alphabet is the words that training texts have ``LEAST_SYMBOL`` times or
more, the end mark, and one symbol for the rest. A context of one to
``DEPTH`` symbols is a candidate if it comes ``LEAST_CONTEXT`` times or more,
and is kept if its next symbols differ from those of its longest
kept suffix by a likelihood-ratio test. Its distribution is discounted
and filled up with its parent's. A token is scored in the longest kept suffix of what
precedes it; inside the rest, by its own discounted count, and an unknown word by the
mass that discounting freed.

Both bounds are counts, so the tree grows with the input, and nobody holds it:
chunks send their distinct runs of a level to shards of contexts, which add them up,
test the contexts and answer every chunk in the order of its question. The next level
starts from the answers. A hot context's runs go to all shards. A run is sent as its last symbol's number,
the most frequent first, as steps inside its context, and every question by bytes of one weight: small numbers
pack well, hashes of runs would not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscreen.llm import arrays
from pairscreen.operators.ordering import number_rows
from pairscreen.session import materialize, release_shuffles

CHUNK_BYTES = 8 << 20  # a batch at most
#: Occurrences in training texts.
LEAST_SYMBOL = 5
LEAST_CONTEXT = 5
DEPTH = 3
#: Standard deviations above its mean that the test statistic must lie.
CRITICAL = 3.09
END = 0x3C656E643E  # stands for the end mark among word hashes
REST = 0x6D1B8A4F35C927E3  # and this for the rest among symbols
#: Training tokens whose runs a shard counts, on average at most twice as many.
SHARD_TOKENS = 1 << 20

CHUNKS = ("chunk long, ids array<{id}>, held array<boolean>, lengths array<int>, words array<long>, train array<int>, "
          "tokens binary")


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def encode(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """Chunks of documents as numbers, one row each: ``words`` (distinct
    hashes, most frequent first), ``train`` (their counts in documents not held out) and
    ``tokens``, with the end mark after every document. A chunk has at most
    CHUNK_BYTES of text, or one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = arrays.text_array(batch.column(1))
            for a, b in arrays.chunks(texts, CHUNK_BYTES):
                found = [arrays.words(*arrays.buffer(texts.slice(a + i, j - i))) + (i,) for i, j in arrays.chunks(texts.slice(a, b - a))]
                rows = np.concatenate([r + i for _, r, i in found])
                lengths = np.bincount(rows, minlength=b - a) + 1
                held = np.asarray(batch.column(2).slice(a, b - a).fill_null(False))
                tokens = np.full(lengths.sum(), END, np.uint64)
                word = np.ones(len(tokens), bool)
                word[np.cumsum(lengths) - 1] = False
                tokens[word] = np.concatenate([h for h, _, _ in found])
                words, places, n = np.unique(tokens, return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                places = rank[places]
                train = np.bincount(places[np.repeat(~held, lengths)], minlength=len(words))
                yield pa.record_batch([
                    pa.array([number]), pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a)),
                    _list(held, pa.bool_()), _list(lengths, pa.int32()), _list(words[order].view(np.int64), pa.int64()),
                    _list(train, pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(places.astype("<u4").tobytes())], pa.binary())],
                    names=["chunk", "ids", "held", "lengths", "words", "train", "tokens"])
                number += 1

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, held_out.alias("_held")).mapInArrow(run, CHUNKS.format(id=kind))


def word_counts(chunks: DataFrame) -> DataFrame:
    """``word, c``: training count of every word hash."""
    flat = chunks.select(F.explode(F.arrays_zip("words", "train")).alias("x")).filter("x.train > 0")
    return flat.groupBy(F.col("x.words").alias("word")).agg(F.sum(F.col("x.train").cast("long")).alias("c"))


def _symbols(counts: DataFrame) -> DataFrame:
    """``word, c, symbol``: symbols numbered from 1, most frequent first; 0 is the rest."""
    often = counts.filter((F.col("c") >= LEAST_SYMBOL) | (F.col("word") == END)).withColumn("_less", -F.col("c"))
    numbered = number_rows(often, [], ["_less", "word"], "symbol").select("word", "c", (F.col("symbol") + 1).cast("int").alias("symbol"))
    rest = counts.filter((F.col("c") < LEAST_SYMBOL) & (F.col("word") != END))
    return numbered.unionByName(rest.select("word", "c", F.lit(0).alias("symbol")))


def _decode(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"].as_py()), "<u4").astype(np.int64)
    return tokens, row["lengths"].values.to_numpy().astype(np.int64), row["words"].values.to_numpy()


def _contexts(symbols: np.ndarray, lengths: np.ndarray, depth: int, end: int) -> list[np.ndarray]:
    """The symbol 1, 2, ... places before every token; the end mark stands
    before the first token of a document, and -1 before that."""
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = []
    for d in range(1, depth + 1):
        back = np.full(len(symbols), -1, np.int64)
        back[d:] = symbols[:-d] if d < len(symbols) + 1 else back[d:]
        back[place < d] = -1
        back[place == d - 1] = end
        out.append(back)
    return out


def _word_replies(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """Replies of depth 0: training counts and symbols of a chunk's words, those that have any."""
    asked = chunks.select("chunk", F.posexplode("words").alias("pos", "word"))
    found = asked.join(_symbols(counts), "word").select(F.col("chunk").alias("of"), "pos", "c", "symbol")

    def run(table: pa.Table) -> pa.Table:
        pos, c, symbol = (table.column(k).to_numpy() for k in ("pos", "c", "symbol"))
        order = np.argsort(pos)
        blob = _pack(np.diff(pos[order], prepend=0).astype(np.uint32), c[order].astype(np.int64), symbol[order].astype(np.uint32))
        return pa.table({"of": table.column("of").slice(0, 1), "depth": pa.array([0], pa.int32()), "shard": pa.array([-1], pa.int64()),
                         "blob": pa.array([blob], pa.binary())})

    return found.groupBy("of").applyInArrow(run, "of long, depth int, shard long, blob binary")


def _combine(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Key of a run of symbols, from that of all but its last."""
    return key * np.uint64(0x9E3779B97F4A7C15) + symbol


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


@dataclass
class Model:
    """What every task is told: totals, and by depth the discount and the hot
    contexts, sorted, with how many symbols follow each (0: not kept)."""

    total: int
    distinct: int
    discount: float
    rest: float  # probability of the rest without a context
    rest_count: int
    least_symbol: float
    least_context: float
    bits: int  # of the number of shards
    discounts: list[float]
    hot: list[tuple[np.ndarray, np.ndarray]]


def _model(counts: DataFrame) -> Model:
    c, symbol = F.col("c"), (F.col("c") >= LEAST_SYMBOL) | (F.col("word") == END)
    total, distinct, once, twice, often, symbols = (int(v) for v in counts.agg(
        F.coalesce(F.sum(c), F.lit(0)), F.count("*"), F.count_if(c == 1), F.count_if(c == 2),
        F.coalesce(F.sum(F.when(symbol, c)), F.lit(0)), F.count_if(symbol)).first())
    d = _discount(once, twice)
    rest = max((total - often + d * symbols) / max(total, 1), 1e-12)
    return Model(total, distinct, d, rest, total - often, LEAST_SYMBOL, max(LEAST_CONTEXT, 1),
                 max(4, (total // SHARD_TOKENS).bit_length()), [], [])


def _pack(*parts: np.ndarray) -> bytes:
    """Arrays by bytes of one weight: the high ones are mostly alike."""
    import zstandard

    sizes = np.asarray([len(x) for x in parts], np.int64)
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in parts]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes.tobytes(), *planes]))


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(data, np.int64, len(kinds)).tolist(), kinds):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size * width
    return out


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the place of every code among them. Codes that
    leave room for it carry their position through a plain sort, several times as fast as sorting positions."""
    bits = max(len(codes) - 1, 0).bit_length()
    if not len(codes) or int(codes.max()).bit_length() + bits > 63:
        return np.unique(codes, return_inverse=True)
    held = np.sort(codes << bits | np.arange(len(codes)))
    at = held & ((1 << bits) - 1)
    held >>= bits
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    places = np.empty(len(held), np.int64)
    places[at] = np.cumsum(new) - 1
    return held[new], places


class _Walk:
    """The tokens of a chunk, each with the number ``of`` its context of the present depth
    (-1: none), and its probability ``p`` in its longest kept context so far. Contexts have
    a key and a training count (0: no candidate), and make a run with every symbol."""

    def __init__(self, row: dict, count: np.ndarray, number: np.ndarray, model: Model):
        self.tokens, self.lengths, words = _decode(row)
        self.model, self.count = model, count  # training count of its words
        self.known = (count > 0) & ((count >= model.least_symbol) | (words == END))
        end = int(np.flatnonzero(words == END)[0])
        # the chunk's symbols by their number, the rest first
        self.numbers, symbol = np.unique(np.where(self.known, number, np.uint32(0)), return_inverse=True)
        self.symbol_keys, self.context_n = np.empty(len(self.numbers), np.uint64), np.empty(len(self.numbers), np.int64)
        self.symbol_keys[symbol] = np.where(self.known, words.view(np.uint64), np.uint64(REST))
        self.context_n[symbol] = np.where(self.known, count, model.rest_count)
        self.context_keys = self.symbol_keys
        self.symbols = symbol[self.tokens]
        self.of = symbol[_contexts(self.tokens, self.lengths, 1, end)[0]]
        self.p = np.where(self.known, (count - model.discount) / max(model.total, 1), model.rest)[self.tokens]
        self.first = np.cumsum(self.lengths) - self.lengths

    def ask(self) -> None:
        """Distinct runs of candidate contexts, in order of shards and contexts.
        A context's runs are in one shard; those of a hot one, more than a
        shard's share of all tokens, in all."""
        down = np.uint64(64 - self.model.bits)
        open_ = np.append(self.context_n >= self.model.least_context, False)  # the last for tokens without a context
        self.here = np.flatnonzero(open_[self.of])
        found = np.flatnonzero(open_)
        place = arrays.mix(self.context_keys[found])
        order = np.argsort(place)
        rank = np.zeros(len(open_), np.int64)
        rank[found[order]] = np.arange(len(found))
        found, place = found[order], place[order]
        runs, of = _distinct(rank[self.of[self.here]] * len(self.numbers) + self.symbols[self.here])
        context, symbol = np.divmod(runs, len(self.numbers))
        self.runs = _combine(self.context_keys[found[context]], self.symbol_keys[symbol])
        self.run_n = self.context_n[found[context]]  # of runs' contexts
        hot = self.run_n > self.model.total >> self.model.bits
        shard = (place >> down)[context]
        shard[hot] = arrays.mix(self.runs[hot]) >> down
        # small numbers are sorted by counting
        order = np.argsort(shard.astype(np.uint16) if self.model.bits <= 16 else shard, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.at = rank[of]  # of tokens, among runs
        self.runs, self.run_n, context, shard, last = self.runs[order], self.run_n[order], context[order], shard[order], self.numbers[symbol[order]]
        new = np.ones(len(order), bool)
        new[1:] = (shard[1:] != shard[:-1]) | (context[1:] != context[:-1])
        self.entry = np.cumsum(new) - 1  # of runs, among contexts
        self.starts = np.flatnonzero(new)
        self.steps = last.copy()  # from one run's symbol to the next in its context
        self.steps[1:] -= np.where(new[1:], np.uint32(0), last[:-1])
        self.keys, self.is_hot = self.context_keys[found[context[new]]], hot[order][new]
        self.shard = shard[new].astype(np.int64)

    def questions(self, held: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """By shard: contexts, whether hot, the sum of their training tokens' log
        probabilities, their numbers of runs; steps of the runs' symbols, and training counts."""
        train = np.repeat(~held, self.lengths)[self.here].astype(float)
        n = np.bincount(self.at, train, len(self.runs)).astype(np.uint32)
        logs = np.bincount(self.entry[self.at], train * np.log(self.p[self.here]), len(self.keys))
        sizes = np.diff(np.append(self.starts, len(self.runs)))
        edges = np.flatnonzero(np.diff(self.shard, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            i, j = self.starts[a], self.starts[b] if b < len(self.starts) else len(self.runs)
            yield int(self.shard[a]), _pack(arrays.mix(self.keys[a:b]), self.is_hot[a:b].astype(np.uint8), logs[a:b], sizes[a:b].astype(np.uint32),
                                            self.steps[i:j], n[i:j])

    def go(self, depth: int, blobs: list[bytes]) -> None:
        """On to contexts of one more symbol, by the shards' replies in order."""
        self.ask()
        replies = [_unpack(x, np.uint32, np.int64) for x in blobs]
        types = np.concatenate([np.zeros(0, np.uint32), *[x for x, _ in replies]]).astype(np.int64)
        n = np.concatenate([np.zeros(0, np.int64), *[x for _, x in replies]])
        keys, followers = self.model.hot[depth - 1]
        if self.is_hot.any():
            types[self.is_hot] = followers[np.searchsorted(keys, arrays.mix(self.keys[self.is_hot]))]
        self.types, self.counts = types, n
        d, p = self.model.discounts[depth - 1], self.p[self.here]
        types = types[self.entry]
        inside = (np.maximum(n - d, 0)[self.at] + (d * types)[self.at] * p) / self.run_n[self.at]
        self.p[self.here] = np.where((types > 0)[self.at], inside, p)
        self.of = np.full(len(self.tokens) + 1, -1, np.int64)
        self.of[self.here + 1] = self.at
        self.of = self.of[:-1]
        self.of[self.first] = -1
        self.context_keys, self.context_n = self.runs, n


def _by_depth(replies: pa.Table) -> dict[int, list[bytes]]:
    by: dict[int, list] = {}
    for depth, _, blob in sorted(zip(*[replies.column(k).to_pylist() for k in ("depth", "shard", "blob")])):
        by.setdefault(depth, []).append(blob)
    return by


def _walk(left: pa.Table, right: pa.Table, model: Model, depth: int) -> _Walk:
    """The chunk at contexts of ``depth`` symbols, by all replies so far."""
    row = {k: left.column(k)[0] for k in ("tokens", "lengths", "words")}
    count, number = np.zeros(len(row["words"].values), np.int64), np.zeros(len(row["words"].values), np.uint32)
    by = _by_depth(right)
    for blob in by.get(0, []):
        steps, c, symbol = _unpack(blob, np.uint32, np.int64, np.uint32)
        pos = np.cumsum(steps, dtype=np.int64)
        count[pos], number[pos] = c, symbol
    walk = _Walk(row, count, number, model)
    for d in range(1, depth):
        walk.go(d, by.get(d, []))
    return walk


def _ask(model: Model, depth: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, held = left.column("chunk")[0].as_py(), np.asarray(left.column("held")[0].values)
        walk = _walk(left, right, model, depth)
        walk.ask()
        rows = list(walk.questions(held))
        return pa.table({"shard": pa.array([s for s, _ in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()),
                         "blob": pa.array([x for _, x in rows], pa.binary())})

    return run


REPLIES = "chunk long, depth int, shard long, blob binary, key long, n long, types long, part double"


def _passes(n: np.ndarray, types: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The likelihood-ratio test; ``part`` sums n_x log(n_x / parent(x))."""
    free = np.maximum(types - 1, 1)
    return (n > 0) & (2 * (part - n * np.log(np.maximum(n, 1))) > free + CRITICAL * np.sqrt(2 * free))


def _reply(depth: int):
    """Counts and the test in one shard. Rows: replies to chunks; parts of hot
    contexts (chunk -1); how many runs came once and twice (chunk -2)."""

    def run(table: pa.Table) -> pa.Table:
        shard, chunks, blobs = table.column("shard")[0].as_py(), table.column("chunk").to_pylist(), table.column("blob").to_pylist()
        out: list[tuple] = []
        got = [_unpack(x, np.uint64, np.uint8, np.float64, np.uint32, np.uint32, np.uint32) for x in blobs]
        keys, hot, logs, sizes, steps, n = (np.concatenate(x) for x in zip(*got))
        keys, first, entry = np.unique(keys, return_index=True, return_inverse=True)
        hot = hot[first].astype(bool)
        logs = np.bincount(entry, logs, len(keys))
        symbols = np.cumsum(steps, dtype=np.uint64)
        before = np.cumsum(sizes, dtype=np.int64) - sizes
        symbols -= np.repeat(symbols[before] - steps[before], sizes)
        runs = np.repeat(entry, sizes).astype(np.uint64) << np.uint64(32) | symbols
        runs, of = np.unique(runs, return_inverse=True)
        total = np.bincount(of, n, len(runs)).astype(np.int64)
        context = (runs >> np.uint64(32)).astype(np.int64)
        n = np.bincount(context, total, len(keys))
        types = np.bincount(context[total > 0], minlength=len(keys))
        part = np.bincount(context, total * np.log(np.maximum(total, 1)), len(keys)) - logs
        kept = np.where(_passes(n, types, part) & ~hot, types, 0).astype(np.uint32)
        i = j = 0
        for chunk, x in zip(chunks, got):
            a, b = i + len(x[0]), j + len(x[4])
            out.append((chunk, depth, shard, _pack(kept[entry[i:a]], total[of[j:b]]), None, None, None, None))
            i, j = a, b
        for k in np.flatnonzero(hot).tolist():
            out.append((-1, depth, shard, None, int(keys[k].view(np.int64)), int(n[k]), int(types[k]), float(part[k])))
        out.append((-2, depth, shard, None, None, int((total == 1).sum()), int((total == 2).sum()), None))
        names = [x.split()[0] for x in REPLIES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table({k: pa.array(list(v), t) for k, t, v in zip(names, kinds, zip(*out))})

    return run


def _learn(chunks: DataFrame, replies: DataFrame, model: Model) -> DataFrame:
    """All replies to the chunks, level by level, after those of depth 0. The driver receives at most one
    row per shard and hot context, no state of the others."""
    spark = chunks.sparkSession
    asking = chunks.select("chunk", "held", "lengths", "words", "tokens")
    for depth in range(1, DEPTH + 1):
        asked = asking.groupBy("chunk").cogroup(replies.groupBy("of")).applyInArrow(
            _ask(model, depth), "shard long, chunk long, blob binary")
        level = materialize(asked.groupBy("shard").applyInArrow(_reply(depth), REPLIES), "suffix-level")
        once, twice = level.filter("chunk = -2").agg(F.sum("n"), F.sum("types")).first()
        hot = level.filter("chunk = -1").groupBy("key").agg(F.sum("n"), F.sum("types"), F.sum("part")).collect()
        keys = np.asarray([r[0] for r in hot], np.int64).view(np.uint64)
        n, types, part = (np.asarray([r[i] for r in hot], float) for i in (1, 2, 3))
        order = np.argsort(keys)
        model.hot.append((keys[order], np.where(_passes(n, types, part), types, 0).astype(np.int64)[order]))
        model.discounts.append(_discount(once or 0, twice or 0))
        level = level.filter("chunk >= 0").select(F.col("chunk").alias("of"), "depth", "shard", "blob")
        replies = replies.unionByName(level)
        release_shuffles(spark)
    return replies


@dataclass
class Tree:
    """``words`` (sorted hashes) are symbols 1, 2, ...; 0 is the rest.
    ``index[d]`` numbers the candidate contexts of d + 1 symbols, ``state[d]``
    has their states (-1: not kept); ``logs`` the log10 distributions by state,
    the root first."""

    words: np.ndarray
    symbols: np.ndarray
    end: int
    total: int
    distinct: int
    discount: float
    index: list[np.ndarray]
    state: list[np.ndarray]
    logs: np.ndarray


def grow(chunks: DataFrame, counts: DataFrame) -> Tree:
    """The whole tree on the driver, for small inputs, to look at what ``score`` uses;
    ``score`` itself never holds it."""
    model = _model(counts)
    rows = counts.filter((F.col("c") >= LEAST_SYMBOL) | (F.col("word") == END)).collect()
    often = sorted((int(r["word"]), int(r["c"])) for r in rows) or [(END, 0)]
    words = np.asarray([w for w, _ in often], np.int64)
    c = np.asarray([model.rest_count] + [n for _, n in often])
    wide = len(c)
    end = int(np.flatnonzero(words == END)[0]) + 1
    hashes = np.concatenate([np.asarray([REST], np.uint64), words.view(np.uint64)])
    root = (c - model.discount) / max(model.total, 1)
    root[0] = model.rest
    tree = Tree(words, np.arange(1, wide), end, model.total, model.distinct, model.discount, [], [], np.zeros(0))
    parts = [np.maximum(root, 1e-300)]
    paths: dict[tuple, int] = {(): 0}  # kept context -> state
    followers: list[dict] = [{} for _ in range(DEPTH)]
    runs: list[dict] = [{} for _ in range(DEPTH)]
    if model.total:
        held, replies = chunks.toArrow(), _learn(chunks, _word_replies(chunks, counts), model).toArrow()
        for i in range(held.num_rows):
            own = replies.filter(pc.equal(replies.column("of"), held.column("chunk")[i]))
            walk, by = _walk(held.slice(i, 1), own, model, 1), _by_depth(own)
            for d in range(DEPTH):
                walk.go(d + 1, by.get(d + 1, []))
                followers[d].update(zip(walk.keys.tolist(), walk.types.tolist()))
                runs[d].update(zip(walk.runs.tolist(), walk.counts.tolist()))
    level = [((x,), hashes[x:x + 1]) for x in range(wide) if c[x] >= model.least_context]
    previous: list[tuple] = []
    for depth in range(DEPTH):
        if not level:
            break
        table = np.full((len(previous), wide) if depth else wide, -1, np.int64)
        at = {path: i for i, (path, _) in enumerate(previous)}
        state = np.full(len(level), -1, np.int64)
        longer = []
        for i, (path, key) in enumerate(level):
            table[(at[path[:-1]], path[-1]) if depth else path[0]] = i
            after = _combine(key, hashes)
            n = np.asarray([runs[depth].get(x, 0) for x in after.tolist()], float)
            types = followers[depth].get(int(key[0]), 0)
            if types:
                suffix = path[1:]
                while suffix not in paths:
                    suffix = suffix[1:]
                d = model.discounts[depth]
                state[i] = paths[path] = len(parts)
                parts.append((np.maximum(n - d, 0) + d * types * parts[paths[suffix]]) / n.sum())
            longer += [(path + (int(x),), after[x:x + 1]) for x in np.flatnonzero(n >= model.least_context) if x != end]
        tree.index.append(table)
        tree.state.append(state)
        previous, level = level, longer
    tree.logs = np.log10(np.maximum(np.vstack(parts), 1e-300))
    return tree


def _score(model: Model, kind: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        walk = _walk(left, right, model, DEPTH + 1 if model.total else 1)
        tokens, lengths, count = walk.tokens, walk.lengths, walk.count
        edges = np.concatenate([[0], np.cumsum(lengths)])

        def per_row(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(values)])
            return sums[edges[1:]] - sums[edges[:-1]]

        base = np.log10((count + 0.5) / (model.total + 0.5 * (model.distinct + 1)))
        if model.total:
            own = np.where(count > 0, count - model.discount, model.discount * model.distinct) / model.total
            inside = np.where(walk.known, 0.0, np.log10(own) - np.log10(model.rest))
            scored = per_row(np.log10(np.maximum(walk.p, 1e-300)) + inside[tokens])
        else:
            scored = per_row(base[tokens])
        held = left.column("held")[0].values
        return pa.table({
            "id": pa.chunked_array([left.column("ids")[0].values], kind), "held_out": held, "n_tokens": pa.array(lengths),
            "n_known": pa.array(per_row((count > 0)[tokens]).astype(np.int64)), "base_score": pa.array(per_row(base[tokens])),
            "score": pa.array(scored)})

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``
    for every row; scores are log10 probabilities of the whole text with its end.

    Words are runs of non-space, A-Z as a-z. The tree learns from rows where
    ``held_out`` is not true (NULL counts as false). NULL text is empty: its only token is the end.
    ``base_score`` is that of single words with 0.5 added to all counts. Without
    training rows both scores are the base. Rows of repeated or NULL ids each have their own
    result; repeated texts count as often as they come. Other columns are ignored.
    """
    arrays.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    chunks = materialize(encode(docs, id_col, text_col, held_out), "chunks")
    counts = materialize(word_counts(chunks), "word-counts")
    release_shuffles(spark)
    model = _model(counts)
    replies = materialize(_word_replies(chunks, counts), "word-replies")
    release_shuffles(spark)
    if model.total:
        replies = _learn(chunks, replies, model)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    scored = chunks.drop("train").groupBy("chunk").cogroup(replies.groupBy("of")).applyInArrow(_score(model, arrow), fields)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
                         F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
