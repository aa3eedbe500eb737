"""Collocations: phrases whose words come together more often than their parts explain.

Texts become chunks of one language, as numbers of words with a 0 at every break. Words that
come LEAST times are numbered by falling frequency, so the pairs of frequent words fill a corner
of the table of pairs: it is cut into tiles of TILE x TILE numbers, and a chunk counts
a well-filled tile with one bincount. All other pairs are counted as sorted coordinates, in
shards by their hash. Both are added up as streams of parts.

Frequent pairs are numbered by frequency again, and take the places of the numbers in the
chunks; two such numbers side by side are a phrase of one word more, and the same counting
finds the frequent ones. A chunk asks the shards for its own pairs, if a map of bits of fixed
size says that they may be frequent, and only their numbers return to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscreen.llm import arrays
from pairscreen.operators.ordering import number_rows, top_k_per_group
from pairscreen.session import materialize, parallelism

LEAST = 100
LONGEST = 5
#: Percent of a phrase's occurrences inside one longer phrase at which it is dropped.
COVERED = 100
TOP = 2000
CHUNK_BYTES = 8 << 20
#: Numbers along the side of a tile, and tiles along the side of the corner.
TILE, SIDE = 256, 4
#: Bits of the map that keeps questions about rare words and pairs from being asked.
MAP_BITS = 1 << 26
#: Sorted coordinates that a shard's sum holds beside those added up.
HELD_PAIRS = 1 << 20
#: A tile of a chunk with as many pairs is counted densely.
DENSE = TILE * TILE // 8

_PIECES = np.zeros(256, bool)
_PIECES[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09]] = True


def _pack(*columns: np.ndarray) -> bytes:
    """Whole numbers from 0, byte by byte of equal weight, compressed."""
    import zstandard

    out = []
    for column in columns:
        values = np.ascontiguousarray(column, np.int64)
        width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
        out.append(np.asarray([len(values), width], np.int64).tobytes())
        out.append(values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _open(blob: bytes) -> list[np.ndarray]:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    at, out = 0, []
    while at < len(data):
        n, width = data[at:at + 16].view(np.int64).tolist()
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = data[at + 16:at + 16 + n * width].reshape(width, n).T
        out.append(whole.reshape(-1).view(np.int64))
        at += 16 + n * width
    return out


def _bit_map(places: DataFrame) -> Broadcast:
    """A map of MAP_BITS bits, set at ``place``, for all tasks: 8 MB at any size of the input. A bit
    set by chance costs a question without an answer."""
    rows = places.select((F.col("place") + 1).alias("at")).distinct().groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for bucket, part in rows:
        bits[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(bytes(part), np.uint8)
    return places.sparkSession.sparkContext.broadcast(bits)


def _is_set(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _place(i, j):
    """Place of a pair in the map of bits: of columns and of arrays alike."""
    return (i * 611_953 + j * 1_299_709) % MAP_BITS


def _shard(i, j, shards: int):
    return (i * 7919 + j * 104_729) % shards


def _word_places(words: pa.Array) -> np.ndarray:
    data, offsets = arrays.buffer(words)
    return (arrays.span_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(MAP_BITS)).astype(np.int64)


def _numbers(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and the words of all rows as their places from 1, with 0 at breaks."""
    data, offsets = arrays.buffer(texts)
    starts, ends, rows = arrays.spans(~(_PIECES | _SPACES)[data], offsets)
    lengths = ends - starts
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(starts) else starts, lengths) + np.arange(lengths.sum())
    edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(arrays.LOWER[data[inside]])])
    coded = words.dictionary_encode()
    piece = np.cumsum(_PIECES[data])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (rows[1:] != rows[:-1])
    places = np.arange(len(starts)) + np.cumsum(new) - 1
    numbers = np.zeros(len(starts) + int(new.sum()), np.int64)
    numbers[places] = np.asarray(coded.indices) + 1
    return coded.dictionary.cast(pa.string()), numbers


def encode(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``chunk, lang, words, counts, numbers``: texts of one language each, of at most
    CHUNK_BYTES or one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = pc.fill_null(arrays.text_array(batch.column(0)), "und").dictionary_encode()
            texts = arrays.text_array(batch.column(1))
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = texts.filter(pc.equal(langs.indices, code))
                for a, b in arrays.chunks(own, CHUNK_BYTES):
                    words, numbers = _numbers(own.slice(a, b - a))
                    counts = np.bincount(numbers, minlength=len(words) + 1)[1:]
                    yield pa.record_batch([
                        pa.array([chunk], pa.int64()), pa.array([lang], pa.string()),
                        pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                        pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(counts, pa.int64())),
                        pa.array([_pack(numbers)], pa.binary())], names=["chunk", "lang", "words", "counts", "numbers"])
                    chunk += 1

    named = [F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")]
    return docs.select(*named).mapInArrow(run, "chunk long, lang string, words array<string>, counts array<long>, numbers binary")


def _ranked(found: DataFrame, order: list[str], name: str) -> DataFrame:
    """``id``: places by falling ``a`` in a language, from 0."""
    numbered = number_rows(found.withColumn("_down", -F.col("a")), ["lang"], ["_down", *order], "id").drop("_down")
    return materialize(numbered, name)


def _sides(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places with a number here and at the next place, and both from 0."""
    here = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
    return here, numbers[here] - 1, numbers[here + 1] - 1


def _sorted_pairs(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each comes."""
    rows, columns = np.unique(i), np.unique(j)
    wide = max(len(columns), 1)
    code, n = np.unique(np.searchsorted(rows, i) * wide + np.searchsorted(columns, j), return_counts=True)
    return rows[code // wide], columns[code % wide], n


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=0)


def count_pairs(chunks: DataFrame, shards: int) -> DataFrame:
    """``chunk, lang, tile, blob``: the pairs of every chunk, by tile of the corner of frequent
    numbers (all counts of a well-filled tile, else its cells in order and their counts) and by shard
    of all others, numbered behind the tiles (sorted coordinates with counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, blob in zip(*[batch.column(c).to_pylist() for c in ("chunk", "lang", "numbers")]):
                _, i, j = _sides(*_open(blob))
                corner = (i < TILE * SIDE) & (j < TILE * SIDE)
                x, y = i[corner], j[corner]
                tile, rows = x // TILE * SIDE + y // TILE, []
                order = np.argsort(tile, kind="stable")
                edges = np.searchsorted(tile[order], np.arange(SIDE * SIDE + 1)).tolist()
                cell = (x % TILE * TILE + y % TILE)[order]
                for t, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    if b - a >= DENSE:
                        rows.append((t, _pack(np.bincount(cell[a:b], minlength=TILE * TILE))))
                    elif b > a:
                        cells, n = np.unique(cell[a:b], return_counts=True)
                        rows.append((t, _pack(_steps(cells), n)))
                x, y, n = _sorted_pairs(i[~corner], j[~corner])
                shard = _shard(x, y, shards)
                order = np.argsort(shard, kind="stable")
                edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1)).tolist()
                for a, b in zip(edges[:-1], edges[1:]):
                    own = order[a:b]
                    rows.append((SIDE * SIDE + int(shard[own[0]]), _pack(_steps(x[own]), y[own], n[own])))
                if rows:
                    yield pa.record_batch([pa.array([chunk] * len(rows), pa.int64()), pa.array([lang] * len(rows), pa.string()),
                                           pa.array([t for t, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())],
                                          names=["chunk", "lang", "tile", "blob"])

    return chunks.select("chunk", "lang", "numbers").mapInArrow(run, "chunk long, lang string, tile int, blob binary")


def _add_tiles(batches: Iterator[pa.RecordBatch]) -> tuple[str | None, int, np.ndarray]:
    """The sum of a tile's parts, read as a stream."""
    total, lang, tile = np.zeros(TILE * TILE, np.int64), None, 0
    for batch in batches:
        for lang, tile, blob in zip(*[batch.column(c).to_pylist() for c in ("lang", "tile", "blob")]):
            *cells, n = _open(blob)
            if cells:
                total[np.cumsum(cells[0])] += n
            else:
                total += n
    return lang, tile, total


def _part_of_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lang, tile, total = _add_tiles(batches)
    yield pa.record_batch([pa.array([lang], pa.string()), pa.array([tile], pa.int32()), pa.array([_pack(total)], pa.binary())], names=["lang", "tile", "blob"])


def _often(lang: str | None, i: np.ndarray, j: np.ndarray, n: np.ndarray, least: int) -> pa.RecordBatch:
    own = np.flatnonzero(n >= least)
    return pa.record_batch([pa.array([lang] * len(own), pa.string()), *[pa.array(v[own], pa.int64()) for v in (i, j, n)]], names=["lang", "i", "j", "a"])


def _often_in_tile(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, tile, total = _add_tiles(batches)
        cell = np.arange(TILE * TILE)
        yield _often(lang, tile // SIDE * TILE + cell // TILE, tile % SIDE * TILE + cell % TILE, total, least)

    return run


def _often_in_shard(least: int):
    """Sorted coordinates are added up whenever HELD_PAIRS of them have come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, lang = [np.zeros((3, 0), np.int64)], 0, None

        def added() -> np.ndarray:
            i, j, n = np.concatenate(held, axis=1)
            order = np.lexsort((j, i))
            i, j, n = i[order], j[order], n[order]
            new = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(j, prepend=-1) != 0))
            return np.stack([i[new], j[new], np.add.reduceat(n, new)]) if len(new) else np.zeros((3, 0), np.int64)

        for batch in batches:
            for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("blob").to_pylist()):
                i, j, n = _open(blob)
                held.append(np.stack([np.cumsum(i), j, n]))
                waiting += len(n)
                if waiting > max(HELD_PAIRS, held[0].shape[1]):
                    held, waiting = [added()], 0
        yield _often(lang, *added(), least)

    return run


def frequent_pairs(parts: DataFrame, least: int) -> DataFrame:
    """``lang, i, j, a`` of the pairs that come ``least`` times. A tile's parts are
    added in as many sums as the session has shuffle partitions, and those in one; a shard's parts are
    added as they come. Each sum reads a stream and holds one tile, or its shard's distinct pairs."""
    salt = F.pmod(F.xxhash64("chunk"), F.lit(parallelism(parts.sparkSession)))
    shape = "lang string, i long, j long, a long"
    corner = F.col("tile") < SIDE * SIDE
    some = parts.filter(corner).withColumn("salt", salt).groupBy("lang", "tile", "salt").applyInArrow(_part_of_tile, "lang string, tile int, blob binary")
    tiles = some.groupBy("lang", "tile").applyInArrow(_often_in_tile(least), shape)
    return tiles.unionByName(parts.filter(~corner).groupBy("lang", "tile").applyInArrow(_often_in_shard(least), shape))


def _ask(chunks: DataFrame, bits: Broadcast, shards: int) -> DataFrame:
    """``lang, shard, of, blob``: by shard, those pairs of a chunk that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, blob in zip(*[batch.column(c).to_pylist() for c in ("chunk", "lang", "numbers")]):
                _, i, j = _sides(*_open(blob))
                often = _is_set(bits.value, _place(i, j))
                i, j, _ = _sorted_pairs(i[often], j[often])
                shard = _shard(i, j, shards)
                order = np.argsort(shard, kind="stable")
                edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1)).tolist()
                rows = [(int(shard[order[a]]), _pack(_steps(i[order[a:b]]), j[order[a:b]])) for a, b in zip(edges[:-1], edges[1:])]
                if rows:
                    yield pa.record_batch([pa.array([lang] * len(rows), pa.string()), pa.array([k for k, _ in rows], pa.int64()),
                                           pa.array([chunk] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())],
                                          names=["lang", "shard", "of", "blob"])

    return chunks.select("chunk", "lang", "numbers").mapInArrow(run, "lang string, shard long, of long, blob binary")


class _Known:
    """Pairs and their numbers, to look others up in."""

    def __init__(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray):
        self.rows, self.columns = np.unique(i), np.unique(j)
        code = np.searchsorted(self.rows, i) * len(self.columns) + np.searchsorted(self.columns, j)
        order = np.argsort(code)
        self.code, self.ids = code[order], ids[order]

    def find(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers of pairs from 1; 0 for those not known."""
        found = np.zeros(len(i), np.int64)
        if not len(self.code):
            return found
        a = np.minimum(np.searchsorted(self.rows, i), len(self.rows) - 1)
        b = np.minimum(np.searchsorted(self.columns, j), len(self.columns) - 1)
        code = a * len(self.columns) + b
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        own = (self.rows[a] == i) & (self.columns[b] == j) & (self.code[at] == code)
        found[own] = self.ids[at[own]] + 1
        return found


def _replies(chunks: DataFrame, ranked: DataFrame, shards: int) -> DataFrame:
    """``of, blob``: the numbers of a chunk's own frequent pairs."""
    asked = _ask(chunks, _bit_map(ranked.select(_place(F.col("i"), F.col("j")).alias("place"))), shards)
    known = ranked.select("lang", _shard(F.col("i"), F.col("j"), shards).alias("shard"), F.lit(-1).cast("long").alias("of"), "i", "j", "id")

    def answer(held: list, batch: pa.RecordBatch, k: int) -> bytes | None:
        if not isinstance(held[0], _Known):
            held[:] = [_Known(*[np.concatenate([part[n].to_numpy() for part in held]) for n in range(3)])]
        i, j = _open(batch.column("blob")[k].as_py())
        i = np.cumsum(i)
        found = held[0].find(i, j)
        own = found > 0
        return _pack(_steps(i[own]), j[own], found[own] - 1) if own.any() else None

    return _met(known, asked, ("i", "j", "id"), answer, parallelism(chunks.sparkSession))


def _answer(numbers: np.ndarray, blobs: list[bytes]) -> np.ndarray:
    """Numbers of the pairs that begin at each place, from 1; 0 for those not frequent."""
    here, i, j = _sides(numbers)
    parts = [_open(x) for x in blobs]
    table = _Known(*[np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.cumsum(p[0]) for p in parts], [p[1] for p in parts], [p[2] for p in parts])])
    after = np.zeros(len(numbers), np.int64)
    after[here] = table.find(i, j)
    return after


def _trim(numbers: np.ndarray) -> np.ndarray:
    """One 0 stands for every run of them."""
    keep = np.ones(len(numbers), bool)
    keep[1:] = (numbers[1:] > 0) | (numbers[:-1] > 0)
    return numbers[keep]


def _chunk_table(left: pa.Table, numbers: np.ndarray) -> pa.Table:
    return pa.table({"chunk": left.column("chunk"), "lang": left.column("lang"), "numbers": pa.array([_pack(_trim(numbers))], pa.binary())})


def _words_to_ranks(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return _nothing()
    numbers = _open(left.column("numbers")[0].as_py())[0]
    rank = np.zeros(int(numbers.max(initial=0)) + 1, np.int64)
    for blob in right.column("blob").to_pylist():
        steps, ids = _open(blob)
        rank[np.cumsum(steps) + 1] = ids + 1
    return _chunk_table(left, rank[numbers])


def _pairs_to_ranks(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return _nothing()
    return _chunk_table(left, _answer(_open(left.column("numbers")[0].as_py())[0], right.column("blob").to_pylist()))


def _nothing() -> pa.Table:
    return pa.table({"chunk": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "numbers": pa.array([], pa.binary())})


def _word_replies(chunks: DataFrame, ranked: DataFrame, shards: int) -> DataFrame:
    """``of, blob``: places of a chunk's frequent words and their numbers, by shards like ``_replies``."""
    spark = chunks.sparkSession
    placed = materialize(arrays.add_columns(ranked.select("lang", "word", "id"), ["word"], "place long", lambda words: [pa.array(_word_places(words), pa.int64())]), "placed")
    bits = _bit_map(placed.select("place"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, lang, words = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values
                place = _word_places(words)
                often = np.flatnonzero(_is_set(bits.value, place))
                shard = place[often] % shards
                order = np.argsort(shard, kind="stable")
                edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
                m, own = len(edges) - 1, often[order]
                if m > 0:
                    yield pa.record_batch([
                        pa.array([lang] * m, pa.string()), pa.array(shard[order][edges[:-1]], pa.int64()), pa.array([chunk] * m, pa.int64()),
                        pa.array([_pack(_steps(own[a:b])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words.take(pa.array(own)))], names=["lang", "shard", "of", "blob", "asked"])

    asked = chunks.select("chunk", "lang", "words").mapInArrow(ask, "lang string, shard long, of long, blob binary, asked array<string>")
    known = placed.select("lang", (F.col("place") % shards).alias("shard"), F.lit(-1).cast("long").alias("of"), "word", "id")

    def answer(held: list, batch: pa.RecordBatch, k: int) -> bytes | None:
        words, ids = (pa.concat_arrays([x[n] for x in held]) for n in range(2))
        at = pc.index_in(batch.column("asked")[k].values, value_set=words)
        found = np.flatnonzero(at.is_valid())
        places = np.cumsum(_open(batch.column("blob")[k].as_py())[0])
        return _pack(_steps(places[found]), ids.to_numpy()[at.drop_null().to_numpy()]) if len(found) else None

    return _met(known, asked, ("word", "id"), answer, parallelism(spark))


def _met(known: DataFrame, asked: DataFrame, columns: tuple, answer, n: int) -> DataFrame:
    """``of, blob``: answers to the questions of each (lang, shard), made where it is read as a stream: first what is
    known (``of`` is -1; its ``columns`` are held), then the questions, one at a time."""
    both = known.unionByName(asked, allowMissingColumns=True)
    names = ["lang", "shard", "of", *[c for c in both.columns if c not in ("lang", "shard", "of")]]
    met = both.select(*names).repartition(n, "lang", "shard").sortWithinPartitions("lang", "shard", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            lang, shard, of = (batch.column(c).to_pylist() for c in ("lang", "shard", "of"))
            kinds = [(x, y, z < 0) for x, y, z in zip(lang, shard, of)]
            out, a = [], 0
            while a < len(kinds):
                b = a + 1
                while b < len(kinds) and kinds[b] == kinds[a]:
                    b += 1
                if kinds[a][:2] != key:
                    key, held = kinds[a][:2], []
                if kinds[a][2]:
                    held.append([batch.column(c).slice(a, b - a) for c in columns])
                elif held:
                    answers = [(of[k], answer(held, batch, k)) for k in range(a, b)]
                    out += [x for x in answers if x[1] is not None]
                a = b
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["of", "blob"])

    return met.mapInArrow(run, "of long, blob binary")


def _grown(ranked: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases with the counts of all that they begin with (``pre``) and end with (``suf``)."""
    one = shorter.select("lang", F.col("id").alias("i"), "phrase", "pre")
    two = shorter.select("lang", F.col("id").alias("j"), "last", "suf")
    return ranked.join(one, ["lang", "i"]).join(two, ["lang", "j"]).select(
        "lang", "id", "a", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last",
        F.concat("pre", F.array("a")).alias("pre"), F.concat("suf", F.array("a")).alias("suf"))


def lowest_cut(scale: int = 1000) -> Column:
    """``score, k, l, r`` of the cut with the lowest floor(scale a n / (l r)), the first of equals;
    in 38 digits, so for counts up to 10^17."""

    def wide(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        l, r = F.element_at("pre", k), F.element_at("suf", F.size("suf") - k)
        score = F.call_function("div", F.lit(scale).cast("decimal(9,0)") * (wide(F.col("a")) * wide(F.col("n"))), wide(l) * wide(r))
        return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("pre") - 1), cut))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of every language's best phrases of two to
    LONGEST words: ``a`` occurrences, ``l`` and ``r`` of both parts of the lowest-scoring cut, ``n``
    words of the language, score floor(1000 a n / (l r)).

    Words are runs of anything but space and tab inside pieces between ``.,;:!?`` and the
    characters 0x0A to 0x0D; A-Z as a-z. NULL text is empty, a NULL language ``und``. Overlapping
    occurrences all count, and so do repeated rows. Phrases that a longer one with as many
    occurrences contains are dropped. Ties in score go by ``a``, then by the phrase as
    UTF-8. Counts are exact at any size; empty tables and texts give nothing, a very long text is a chunk of its
    own, other columns do not matter.
    """
    arrays.small_batches(docs.sparkSession)
    chunks = materialize(encode(docs, text_col, lang_col), "chunks")
    totals = chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    flat = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    words = flat.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("a")).filter(F.col("a") >= least)
    ranked = _ranked(materialize(words, "words"), ["word"], "ranks")
    held = F.array("a")
    phrases = ranked.select("lang", "id", "a", F.col("word").alias("phrase"), F.col("word").alias("last"), held.alias("pre"), held.alias("suf"))
    shards = parallelism(docs.sparkSession)
    replies = _word_replies(chunks, ranked, shards)
    now = materialize(chunks.select("chunk", "lang", "numbers").groupBy("chunk").cogroup(replies.groupBy("of")).applyInArrow(
        _words_to_ranks, "chunk long, lang string, numbers binary"), "numbered")
    levels: list[DataFrame] = []
    for size in range(2, LONGEST + 1):
        parts = materialize(count_pairs(now, shards), "pairs")
        found = materialize(frequent_pairs(parts, least), "frequent")
        if found.isEmpty():
            break
        ranked = _ranked(found, ["i", "j"], "ranks")
        if levels:  # what the longer phrases cover: only those of one word more need a look
            inner = ranked.select("lang", F.explode(F.array("i", "j")).alias("id"), F.col("a").alias("outer")).groupBy("lang", "id").agg(F.max("outer").alias("outer"))
            levels[-1] = levels[-1].join(inner, ["lang", "id"], "left").filter(
                F.col("outer").isNull() | (100 * F.col("outer") < COVERED * F.col("a"))).drop("outer")
        phrases = materialize(_grown(ranked, phrases), "phrases")
        levels.append(phrases)
        if size < LONGEST:
            now = materialize(now.groupBy("chunk").cogroup(_replies(now, ranked, shards).groupBy("of")).applyInArrow(
                _pairs_to_ranks, "chunk long, lang string, numbers binary"), "numbered")
    best = phrases.limit(0) if not levels else levels[0]
    for level in levels[1:]:
        best = best.unionByName(level)
    scored = best.join(totals, "lang").withColumn("cut", lowest_cut()).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    first = top_k_per_group(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
