"""How far the sources of a language are apart, by their words.

Texts go through Arrow kernels inside tasks: lower case, split, dictionary and
two hash aggregations (by row and word, then by group and word), which leave one count
for each group and word of a task's run of batches. Merged counts are dealt to shards
of words; a shard lays its counts out as one column of words per source and gives
every pair's part of the divergence, and each source's best words in the shard.

All arithmetic is on integers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two
groups differ at a word by floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairscreen.llm.arrays import chunks, giving_back, small_batches, text_array
from pairscreen.operators.ordering import number_rows, top_k_per_group
from pairscreen.session import materialize, parallelism

#: What stands between terms: every ASCII character but letters.
BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Bytes of text split into words at once, or one row.
PART_BYTES = 2 << 20
#: Rows of counts that a task holds before it passes them on.
HELD_ROWS = 1 << 19
#: Words of a shard on average, and sources of a block.
SHARD_TERMS = 1024
BLOCK = 128

PARTS = "lang string, source string, term string, n long, docs long"


def _group(table: pa.Table, keys: list[str], sums: list) -> pa.Table:
    """One thread: Arrow's would each fill a table of groups, and hold memory of their own, beside the task's cores."""
    return table.group_by(keys, use_threads=False).aggregate(sums)


def _batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and rows of every (lang, source, term) of a batch."""
    lang, source, text = (pc.fill_null(text_array(batch.column(i)), "") for i in range(3))
    pieces = pc.split_pattern_regex(pc.ascii_lower(text.cast(pa.large_string())), pattern=BREAKS)
    rows, terms = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    found = pc.not_equal(terms, "")
    coded = terms.filter(found).dictionary_encode()
    by_row = _group(pa.table({"row": rows.filter(found), "term": coded.indices}), ["row", "term"], [([], "count_all")])
    at = by_row.column("row")
    named = pa.table({"lang": lang.take(at), "source": source.take(at), "term": by_row.column("term"), "n": by_row.column("count_all")})
    merged = _group(named, ["lang", "source", "term"], [("n", "sum"), ("n", "count")])
    return pa.table({"lang": merged.column("lang").cast(pa.string()), "source": merged.column("source").cast(pa.string()),
                     "term": coded.dictionary.take(merged.column("term")).cast(pa.string()),
                     "n": merged.column("n_sum").cast(pa.int64()), "docs": merged.column("n_count").cast(pa.int64())})


def _merge(held: list[pa.Table]) -> pa.Table:
    merged = _group(pa.concat_tables(held), ["lang", "source", "term"], [("n", "sum"), ("docs", "sum")])
    return merged.rename_columns(["lang", "source", "term", "n", "docs"])


def partial_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``lang, source, term, n, docs``: counts of runs of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for a, b in chunks(text_array(batch.column(2)), PART_BYTES):
                # a copy: Arrow's split by a pattern fails on slices
                held.append(_batch_counts(batch.take(pa.array(range(a, b), pa.int64()))))
                if len(held) > 1 and sum(t.num_rows for t in held) > HELD_ROWS:
                    held = [_merge(held)]
                    if held[0].num_rows > HELD_ROWS // 2:
                        yield from held.pop().to_batches(1 << 16)
        if held:
            yield from _merge(held).to_batches(1 << 16)

    named = [F.col(f"`{c}`").cast("string") for c in (lang_col, source_col, text_col)]
    return docs.select(*named).mapInArrow(giving_back(run), PARTS)


def _p(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 terms)), in decimals wide enough for any count."""
    wide = (n + 2).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + 2 * terms).cast("decimal(28,0)")).cast("long") + 1


def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _shard(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One block of sources against another, over the words of one shard.
    Rows: pairs (term NULL), with the words that any source of either block has as ``seen``;
    and words, from the meeting of a block with itself."""
    lang, _, first, second = (k.as_py() for k in key)
    number, none = (right.column(k).to_numpy() for k in range(4, 6))  # Spark may name them as their origins
    own = np.argsort(number)
    number, none = number[own], none[own]
    block = number // BLOCK
    out: list[pa.Table] = []
    terms = left.column("term").combine_chunks().dictionary_encode() if left.num_rows else None
    wide = len(terms.dictionary) if left.num_rows else 0
    p = np.repeat(none[:, None], wide, axis=1)
    if wide:
        at, word = np.searchsorted(number, left.column("number").to_numpy()), np.asarray(terms.indices)
        p[at, word] = left.column("p").to_numpy()
    a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
    for x in a.tolist():
        others = b[b > x] if first == second else b
        if len(others):
            out.append(pa.table({"a": np.full(len(others), number[x]), "b": number[others], "value": differ(p[x], p[others]).sum(axis=1),
                                 "seen": np.full(len(others), wide)}).append_column("term", pa.nulls(len(others), pa.string())))
    if first == second and wide:
        p_own, q = left.column("p").to_numpy(), left.column("q").to_numpy()
        more = np.flatnonzero(p_own > q)
        value = differ(p_own[more], q[more])
        names, source = left.column("term").take(pa.array(more)), left.column("number").to_numpy()[more]
        t = pa.table({"a": source, "b": q[more], "value": value, "seen": np.zeros(len(more), np.int64), "term": names})
        # a source's best of the shard are enough for its best of all
        t = t.sort_by([("a", "ascending"), ("value", "descending"), ("term", "ascending")])
        source = t.column("a").to_numpy()
        rank = np.arange(len(source)) - np.searchsorted(source, source)
        out.append(t.filter(pa.array(rank < TOP)))
    if not out:
        return pa.table({"lang": pa.array([], pa.string()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()),
                         "value": pa.array([], pa.int64()), "seen": pa.array([], pa.int64()), "term": pa.array([], pa.string())})
    done = pa.concat_tables([t.select(["a", "b", "value", "seen", "term"]).cast(pa.schema(
        [("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64()), ("seen", pa.int64()), ("term", pa.string())])) for t in out])
    return done.add_column(0, "lang", pa.array([lang] * done.num_rows, pa.string()))


def _between_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows once for every block that their own meets, as ``first, second``."""
    own = F.floor(F.col("number") / BLOCK).cast("int")
    return rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "*", F.least("_own", "_other").alias("first"), F.greatest("_own", "_other").alias("second")).drop("_own", "_other")


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, q, rank``: for every source of a
    language, all other sources by divergence (part ``pair``), and the TOP words that it has
    more often than its language (part ``term``; ``q`` is the language's value there).

    Text, language and source that are NULL count as ''. Words are runs of ASCII letters
    and non-ASCII characters, A-Z as a-z; a language keeps those in at least LEAST_DOCS of its
    rows. A source without any kept word still meets all others; a language without
    kept words gives pairs of value 0. Repeated rows count each; ties go by item, as
    UTF-8. An empty table gives no rows; other columns do not matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    groups = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"),
                         F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source")).distinct()
    # one shuffle by word serves the merged counts and the numbers of documents
    merged = partial_counts(docs, text_col, lang_col, source_col).repartition(parallelism(spark), "lang", "term").groupBy(
        "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    word = W.partitionBy("lang", "term")
    # a language's words are counted where the first source of each stands
    first = F.row_number().over(word.orderBy("source")) == 1
    kept = materialize(merged.withColumn("docs", F.sum("docs").over(word)).filter(F.col("docs") >= LEAST_DOCS).select(
        "lang", "source", "term", "n", F.sum("n").over(word).alias("lang_count"), first.alias("first")), "term-counts")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("first").alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = materialize(groups, "groups")
    many = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    numbered = number_rows(groups, ["lang"], ["source"], "number").join(many, "lang").join(
        totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source", "number", "sources", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("source_n", "lang_n", "terms")])
    none = F.when(F.col("terms") > 0, _p(F.lit(0), F.col("source_n"), F.greatest("terms", F.lit(1)))).otherwise(1)
    sources = materialize(numbered.withColumn("none", none).withColumn(
        "shards", F.greatest(F.ceil(F.col("terms") / SHARD_TERMS), F.lit(1)).cast("int")).withColumn(
            "blocks", F.ceil(F.col("sources") / BLOCK).cast("int")), "sources")
    placed = kept.join(sources.select("lang", "source", "number", "source_n", "lang_n", "terms", "shards", "blocks"), ["lang", "source"]).select(
        "lang", "term", "number", "blocks", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"),
        _p(F.col("n"), F.col("source_n"), F.col("terms")).alias("p"), _p(F.col("lang_count"), F.col("lang_n"), F.col("terms")).alias("q"))
    counts = materialize(_between_blocks(placed, F.col("blocks")).select(
        "lang", "shard", "first", "second", "term", "number", "p", "q"), "shard-counts")
    asked = _between_blocks(sources.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))), F.col("blocks")).select(
        "lang", "shard", "first", "second", "number", "none")
    key = ["lang", "shard", "first", "second"]
    parts = materialize(counts.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(
        _shard, "lang string, a long, b long, value long, seen long, term string"), "shards")

    names = sources.select("lang", F.col("number").alias("a"), "source", "terms", F.col("none").alias("p"))
    others = sources.select("lang", F.col("number").alias("b"), F.col("source").alias("item"), F.col("none").alias("q"))
    summed = parts.filter("term is null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    unseen = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    one = summed.join(names, ["lang", "a"]).join(others, ["lang", "b"]).select(
        "lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("seen")) * unseen).alias("value"))
    both = one.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = both.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.lit(None).cast("long").alias("q"), "rank")
    best = top_k_per_group(parts.filter("term is not null"), ["lang", "a"], [F.desc("value"), F.asc("term")], TOP, "rank")
    words = best.join(names, ["lang", "a"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.col("b").alias("q"), "rank")
    return pairs.unionByName(words)
