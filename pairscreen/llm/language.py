"""Language of documents by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the text (letter trigrams), the
language that the markup declares, the suffix of the address, and a prior from
other documents of the same host, smoothed towards its domain and towards all
documents. Every table behind them comes from grouped aggregates over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscreen.llm.arrays import LOWER, add_columns, buffer, chunks, giving_back, small_batches, text_array
from pairscreen.session import materialize

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
BUCKETS = 1 << 16
#: Trigrams of a text overlap and repeat, so a text counts as at most this many.
MOST_EVIDENCE = 200
#: Fewest letter trigrams of a text that votes in the tables of hosts, declarations and suffixes.
LEAST_VOTE = 20
#: Documents that a parent (domain, all) is worth in the prior of its child.
PRIOR_WEIGHT = 10.0
LEAST_POSTERIOR = 0.5
#: Share of the languages' mean in the trigrams of each.
SHARED = 0.05

_FOLD = np.full(256, 32, np.uint8)  # all but letters is a space
for _b in (*range(65, 91), *range(97, 123), *range(128, 256)):
    _FOLD[_b] = LOWER[_b]


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash bucket at every byte, whether a trigram with a letter in its
    middle starts there, and row offsets."""
    data, offsets = buffer(texts)
    folded = _FOLD[data]
    upper = np.zeros(len(data), bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)
    folded[upper] += 0x20
    wide = folded.astype(np.uint32)
    codes = np.zeros(len(data), np.uint32)
    good = np.zeros(len(data), bool)
    if len(data) > 2:
        codes[:-2] = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(0x9E3779B1)) >> 16
        good[:-2] = folded[1:-1] != 32
        inner = offsets[1:-1]
        for back in (1, 2):  # none across rows
            at = inner - back
            good[at[at >= 0]] = False
    return codes, good, offsets


def text_counts(df: DataFrame, text_col: str, declared_col: str, languages: Sequence[str]) -> DataFrame:
    """``language, bucket, n``: letter trigrams of all texts by the language
    they declare, counted inside tasks first (at most languages x buckets rows
    from a task)."""
    names = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names) * BUCKETS, np.int64)
        for batch in batches:
            texts, declared = text_array(batch.column(0)), batch.column(1).to_pylist()
            label = np.asarray([names.get(d, -1) for d in declared], np.int64)
            for a, b in chunks(texts):
                codes, good, offsets = _trigrams(texts.slice(a, b - a))
                of = np.repeat(label[a:b], np.diff(offsets))
                good &= of >= 0
                total += np.bincount(of[good] * BUCKETS + codes[good], minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full // BUCKETS, pa.int32()), pa.array(full % BUCKETS, pa.int32()),
                               pa.array(total[full], pa.int64())], names=["language", "bucket", "n"])

    counted = df.select(text_col, declared_col).mapInArrow(giving_back(run), "language int, bucket int, n long")
    return counted.groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def text_table(counts: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """Log-probabilities of buckets by language, and last of text in none of
    them, nearly uniform. Each has a share of the languages' mean, so that a
    text in two of them still goes to the larger part. The driver receives at most
    languages x buckets rows, whatever the input."""
    rows = counts.toPandas()
    table = np.full((len(languages), BUCKETS), 0.5)
    np.add.at(table, (rows["language"].to_numpy(int), rows["bucket"].to_numpy(int)), rows["n"].to_numpy(float))
    table /= table.sum(axis=1, keepdims=True)
    mean = table.mean(axis=0)
    other = SHARED * mean + (1 - SHARED) / BUCKETS
    return np.log(np.vstack([SHARED * mean + (1 - SHARED) * table, other])).astype(np.float32)


def text_evidence(table: np.ndarray):
    """A function from a text column to ``_n`` (letter trigrams) and ``_logs``
    (log-likelihoods of the whole text by language, as of at most MOST_EVIDENCE
    independent ones)."""

    def score(texts: pa.Array) -> list[pa.Array]:
        texts = text_array(texts)
        counts, logs = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(table)))
        for a, b in chunks(texts):
            codes, good, offsets = _trigrams(texts.slice(a, b - a))
            sums = np.zeros(len(codes) + 1)
            np.cumsum(good, out=sums[1:])
            n = sums[offsets[1:]] - sums[offsets[:-1]]
            counts[a:b] = n
            for k in range(len(table)):
                np.cumsum(np.where(good, table[k][codes], np.float32(0)), dtype=np.float64, out=sums[1:])
                logs[a:b, k] = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1) * np.minimum(n / 3, MOST_EVIDENCE)
        return [pa.array(counts), pa.ListArray.from_arrays(
            pa.array(np.arange(len(texts) + 1) * len(table), pa.int32()), pa.array(logs.ravel()))]

    return score


@dataclass
class Evidence:
    """Fitted tables. ``hosts``, ``domains`` and ``suffixes`` have one row per
    value with its votes by language."""

    languages: tuple[str, ...]
    table: np.ndarray
    everywhere: list[float]
    declared: dict[str, list[float]]
    hosts: DataFrame
    domains: DataFrame
    suffixes: DataFrame


def _column(name: str | None) -> Column:
    return F.col(name) if name else F.lit(None).cast("string")


def _read(df: DataFrame, table: np.ndarray, languages: Sequence[str], text_col: str, declared_col: str | None,
          host_col: str | None, id_col: str | None) -> DataFrame:
    """Rows as ``_row`` (or only the id) with what the fusion needs."""
    host = F.lower(_column(host_col))
    labels = F.split(host, r"\.")
    dotted = F.size(labels) > 1
    row = F.struct(*[F.col(f"`{c}`") for c in ([id_col] if id_col else df.columns)]).alias("_row")
    declared = F.lower(F.substring_index(_column(declared_col), "-", 1))
    read = df.select(
        row, *([F.col(text_col).alias("_t")] if id_col else []), host.alias("_host"), F.when(dotted, F.array_join(F.slice(labels, -2, 2), ".")).alias("_domain"),
        F.when(dotted, F.element_at(labels, -1)).alias("_suffix"),
        F.when(declared.isin(*languages), declared).when(F.trim(declared) != "", "other").otherwise("none").alias("_declared"))
    read = add_columns(read, ["_t" if id_col else f"_row.{text_col}"], "_n long, _logs array<double>", text_evidence(table), drop=["_t"])
    best = F.array_position(F.col("_logs"), F.array_max("_logs")).cast("int")
    return read.withColumn("_vote", F.when(F.col("_n") >= LEAST_VOTE, best))


def _votes(rows: DataFrame, key: str, n: int) -> DataFrame:
    counts = F.array(*[F.count_if(F.col("_vote") == i + 1).cast("double") for i in range(n)])
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(counts.alias(f"{key}_votes"))


def fit(df: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str | None = "source",
        languages: Sequence[str] = LANGUAGES, id_col: str | None = None) -> tuple[Evidence, DataFrame]:
    """Evidence from all rows, and the rows read (with ids only, if
    ``id_col`` is given). The declared language labels the texts' trigram
    counts; the votes of texts then measure how far declarations, hosts and
    suffixes can be trusted."""
    small_batches(df.sparkSession)
    languages = tuple(languages)
    normal = df.withColumn("_lang", F.lower(F.substring_index(F.col(declared_col), "-", 1)))
    table = text_table(text_counts(normal, text_col, "_lang", languages), languages)
    rows = _read(df, table, languages, text_col, declared_col, host_col, id_col)
    slim = materialize(rows if id_col else rows.select("_host", "_domain", "_suffix", "_declared", "_vote"), "language-votes")
    n = len(languages) + 1
    by_declared = {r["_declared"]: r["_declared_votes"] for r in _votes(slim, "_declared", n).collect()}
    kinds = [*languages, "other", "none"]
    votes = np.array([by_declared.get(k, [0.0] * n) for k in kinds])
    everywhere = (votes.sum(axis=0) + 1) / (votes.sum() + n)
    likely = (votes + 1) / (votes.sum(axis=0) + len(kinds))  # P(declared | language)
    found = Evidence(
        languages, table, everywhere.tolist(), {k: likely[i].tolist() for i, k in enumerate(kinds)},
        materialize(_votes(slim, "_host", n), "language-hosts"), materialize(_votes(slim, "_domain", n), "language-domains"),
        materialize(_votes(slim, "_suffix", n), "language-suffixes"))
    return found, slim if id_col else rows


def fuse(rows: DataFrame, found: Evidence) -> DataFrame:
    """Rows read by ``fit`` with ``language, confidence, kept``. A document's
    own vote is taken out of its host's, domain's and suffix's votes."""
    names = [*found.languages, UNKNOWN]
    joined = rows
    for key, side in (("_host", found.hosts), ("_domain", found.domains), ("_suffix", found.suffixes)):
        joined = joined.join(side, key, "left")
    n = len(names)
    vote = F.coalesce("_vote", F.lit(0))
    everywhere = F.array(*[F.lit(p) for p in found.everywhere])

    def smoothed(key: str, parent: Column) -> Column:
        less = F.transform(f"{key}_votes", lambda v, i: v - (i + 1 == vote).cast("double"))
        others = F.coalesce(less, F.array(*[F.lit(0.0)] * n))
        total = F.aggregate(others, F.lit(0.0), lambda x, v: x + v)
        return F.zip_with(others, parent, lambda v, p: (v + PRIOR_WEIGHT * p) / (total + PRIOR_WEIGHT))

    declared = F.create_map(*[x for k, v in found.declared.items() for x in (F.lit(k), F.array(*[F.lit(math.log(p)) for p in v]))])
    joined = joined.withColumn("_prior", smoothed("_host", smoothed("_domain", everywhere))).withColumn(
        # P(suffix | language) up to a factor shared by all languages
        "_address", F.zip_with(smoothed("_suffix", everywhere), everywhere, lambda p, q: p / q))
    evidence = F.zip_with(F.zip_with("_prior", "_address", lambda p, a: F.log(p * a)), declared[F.col("_declared")], lambda x, y: x + y)
    scored = joined.withColumn("_all", F.zip_with("_logs", evidence, lambda x, y: x + y)).withColumn(
        # value and place in one, the first of equals
        "_best", F.array_max(F.transform("_all", lambda x, i: F.struct(x.alias("v"), (n - i).alias("k"))))).withColumn(
        "_sum", F.aggregate("_all", F.lit(0.0), lambda x, v: x + F.exp(v - F.col("_best.v"))))
    language = F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1 - F.col("_best.k")).cast("int"))
    confidence = F.least(1 / F.col("_sum"), F.lit(1.0))
    return scored.select(
        "_row", language.alias("language"), confidence.alias("confidence"),
        ((language != UNKNOWN) & (confidence >= LEAST_POSTERIOR) & (F.col("_n") > 0)).alias("kept"))


def identify(df: DataFrame, id_col: str, text_col: str = "text", declared_col: str = "lang",
             host_col: str | None = "source", languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """``id_col, language, confidence, kept`` for every row.

    ``kept`` is false for ``und`` (text like none of ``languages``), for an
    unsure posterior, and for texts without three letters in a row, NULL and empty ones
    included. NULL or unlisted declarations and NULL hosts are evidence of
    their own kind or none. Equally likely languages: the first listed. Repeated
    rows each get a row. Other columns are ignored. No rows give no rows.
    """
    found, rows = fit(df, text_col, declared_col, host_col, languages, id_col)
    return fuse(rows, found).select("_row.*", "language", "confidence", "kept")


def keep_identified(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str | None = "source",
                    languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """The rows of ``docs`` that ``identify`` keeps, with the identified
    language in ``declared_col``. Texts are read three times, not shuffled."""
    found, rows = fit(docs, text_col, declared_col, host_col, languages)
    out = fuse(rows, found).filter("kept")
    return out.select(*[F.col("language").alias(c) if c == declared_col else F.col("_row").getField(c).alias(c)
                        for c in docs.columns])
