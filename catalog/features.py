"""Feature banks, vectors, sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalog.base import long_vector, query, r, role, rounded, table
from pairscreen.functions import vectors
from pairscreen.functions.text import clean_sequence
from pairscreen.operators import features, sequences
from pairscreen.session import parallelism, scratch_path, spread
from pairscreen.sources import scans, sinks

_LONG = """v AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""


def bank(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))


# -- banks --------------------------------------------------------------------------

@query("scan_bank", f"""WITH {_LONG}, n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings)
    SELECT CAST(idx AS BIGINT) AS idx, vec_id, CAST(pos AS INTEGER) AS pos, {r('x')} AS value FROM v JOIN n USING (vec_id)""")
def scanned_bank(spark, sf):
    # A second, worse-named vector column must not be picked.
    df = table(spark, sf, "embeddings").withColumn("other", F.array(F.lit(1.0)))
    return long_vector(scans.scan_bank(df, ["vec_id"]), ["idx", "vec_id"], "vec")


@query("concat_views", f"""WITH {_LONG} SELECT vec_id, CAST(pos + b.o AS INTEGER) AS pos, {r('x * b.s')} AS value
    FROM v JOIN (VALUES (0, 1e0), (64, -1e0), (128, 2e0)) AS b(o, s) ON TRUE""")
def concatenated(spark, sf):
    df = bank(spark, sf).select("vec_id", "vec")

    def times(factor):
        return df.withColumn("vec", F.transform("vec", lambda x: x * F.lit(factor)))

    scaled = [times(1.0), times(-1.0), times(2.0)]
    return long_vector(features.combine_banks(scaled, "vec_id"), ["vec_id"], "vec")


_WIDTHS = [32, 20, 12]


@query("split_views", f"""WITH {_LONG} SELECT vec_id, CASE WHEN pos < 32 THEN 'a' WHEN pos < 52 THEN 'b' ELSE 'c' END AS view,
    CAST(CASE WHEN pos < 32 THEN pos WHEN pos < 52 THEN pos - 32 ELSE pos - 52 END AS INTEGER) AS pos, {r('x')} AS value FROM v""")
def split(spark, sf):
    parts = vectors.split_views(F.col("vec"), _WIDTHS)
    cells = F.array(*[F.struct(F.lit(n).alias("view"), p.alias("vec")) for n, p in zip("abc", parts)])
    return long_vector(bank(spark, sf).select("vec_id", F.explode(cells).alias("c")).select("vec_id", "c.*"),
                       ["vec_id", "view"], "vec")


@query("mask_views", f"""WITH {_LONG} SELECT vec_id, CAST(pos AS INTEGER) AS pos,
    {r('CASE WHEN pos >= 32 AND pos < 52 THEN 0 ELSE x END')} AS value FROM v""")
def masked(spark, sf):
    df = bank(spark, sf).withColumn("vec", vectors.mask_views(F.col("vec"), _WIDTHS, [1, 0, 1]))
    return long_vector(df, ["vec_id"], "vec")


def _pairs(spark, sf):
    """Every vector with the first vector of its label."""
    b = bank(spark, sf)
    first = b.groupBy("label").agg(F.min_by("vec", "vec_id").alias("p"))
    return b.join(first, "label").select("vec_id", F.col("vec").alias("d"), "p")


_PAIRED = f"""{_LONG}, t AS (SELECT label, min(vec_id) AS tid FROM embeddings GROUP BY label),
    pr AS (SELECT v.vec_id, v.pos, v.x::DOUBLE AS d, w.x::DOUBLE AS p FROM v JOIN t ON t.label = v.label
           JOIN v AS w ON w.vec_id = t.tid AND w.pos = v.pos)"""


@query("pair_features", f"""WITH {_PAIRED} SELECT vec_id, CAST(pos + o AS INTEGER) AS pos, {r('''
        CASE o WHEN 0 THEN d WHEN 64 THEN p WHEN 128 THEN d * p ELSE abs(d - p) END''')} AS value
    FROM pr JOIN (VALUES (0), (64), (128), (192)) AS b(o) ON TRUE""")
def paired(spark, sf):
    df = _pairs(spark, sf).withColumn("vec", vectors.pair_features(F.col("d"), F.col("p"), "concat_product_absdiff"))
    return long_vector(df, ["vec_id"], "vec")


_WD = [[1.0] * 64, [1.0 if i < 32 else -1.0 for i in range(64)]]
_WP = [[0.5] * 64, [1.0 if i % 2 == 0 else 0.0 for i in range(64)]]


@query("pair_features_bilinear", f"""WITH {_PAIRED}, s AS (
        SELECT vec_id, sum(d) * sum(p) * 0.5 AS a,
               sum(CASE WHEN pos < 32 THEN d ELSE -d END) * sum(CASE WHEN pos % 2 = 0 THEN p ELSE 0 END) AS b
        FROM pr GROUP BY vec_id)
    SELECT vec_id, CAST(256 AS INTEGER) AS size, {r('a')} AS a, {r('b')} AS b FROM s""")
def bilinear(spark, sf):
    x = vectors.pair_features(F.col("d"), F.col("p"), "full_bilinear", _WD, _WP)
    df = _pairs(spark, sf).select("vec_id", x.alias("x"))
    return df.select("vec_id", (F.size("x") - 2).alias("size"), rounded(F.get("x", F.lit(256))).alias("a"),
                     rounded(F.get("x", F.lit(257))).alias("b"))


@query("pair_features_normalized", f"""WITH {_PAIRED}, x AS (
        SELECT vec_id, pos, d AS v FROM pr UNION ALL SELECT vec_id, pos + 64, p FROM pr),
    s AS (SELECT vec_id, avg(v) AS m, var_pop(v) AS var FROM x GROUP BY vec_id)
    SELECT vec_id, CAST(pos AS INTEGER) AS pos, {r('(v - m) / sqrt(var + 1e-5)')} AS value FROM x JOIN s USING (vec_id)""")
def normalized(spark, sf):
    df = _pairs(spark, sf).withColumn(
        "vec", vectors.layer_norm(vectors.pair_features(F.col("d"), F.col("p"), "concat_only")))
    return long_vector(df, ["vec_id"], "vec")


# -- standardisation: every 17th cell is missing, dimension 5 wholly -----------------------

_HOLES = f"""{_LONG}, h AS (SELECT vec_id, label, pos, CASE WHEN pos = 5 OR (vec_id + pos) % 17 = 0 THEN NULL
                                   ELSE CAST(x AS DOUBLE) END AS x FROM v),
    med AS (SELECT pos, COALESCE(median(x), 0) AS median FROM h WHERE label < 7 GROUP BY pos),
    st AS (SELECT pos, any_value(median) AS median, avg(COALESCE(x, median)) AS mean,
                  stddev_pop(COALESCE(x, median)) AS sd FROM h JOIN med USING (pos) WHERE label < 7 GROUP BY pos),
    fit AS (SELECT pos, median, mean, CASE WHEN sd > 0 THEN sd ELSE 1 END AS std FROM st)"""


def _with_holes(spark, sf):
    hole = lambda x, i: F.when(
        (i == 5) | ((F.col("vec_id") + i) % 17 == 0),
        F.when(F.col("vec_id") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(x).cast("float")
    return bank(spark, sf).withColumn("vec", F.transform("vec", hole))


def _fitted(spark, sf):
    df = _with_holes(spark, sf)
    return features.fit_standardization(df, df.filter("label < 7").select("vec_id"), "vec_id")


@query("fit_standardization", f"WITH {_HOLES} SELECT CAST(pos AS INTEGER) AS pos, {r('median')} AS median, "
                              f"{r('mean')} AS mean, {r('std')} AS std FROM fit")
def fitted(spark, sf):
    return _fitted(spark, sf).select("pos", *[rounded(c).alias(c) for c in ("median", "mean", "std")])


@query("standardize_vector", f"""WITH {_HOLES} SELECT vec_id, CAST(pos AS INTEGER) AS pos,
    {r('greatest(-10, least(10, (COALESCE(x, median) - mean) / std))')} AS value FROM h JOIN fit USING (pos)""")
def standardized(spark, sf):
    df = _with_holes(spark, sf).drop("label")
    return long_vector(features.apply_standardization(df, _fitted(spark, sf)), ["vec_id"], "vec")


# -- sequences ---------------------------------------------------------------------------------
# Sequences are whole document texts inside FASTA header lines. Upper-casing
# the German sharp s gives two letters here and must do so in SQL too.

_SEQ = """s AS (SELECT doc_id AS prot_id, upper(replace(regexp_replace(text, '\\s+', '', 'g'), 'ß', 'SS')) AS seq
           FROM documents WHERE trim(text, E' \\n\\t\\r') <> '')"""


@query("clean_sequence", f"WITH {_SEQ} SELECT prot_id, md5(seq) AS digest, length(seq) AS length FROM s")
def cleaned_sequences(spark, sf):
    df = role(spark, sf, "sequences").withColumn("seq", clean_sequence(F.col("seq"))).filter("seq <> ''")
    return df.select("prot_id", F.md5("seq").alias("digest"), F.length("seq").cast("bigint").alias("length"))


def _sequences(spark, sf):
    rows = spread(role(spark, sf, "sequences"), "prot_id")
    return sequences.valid_sequences(rows, "prot_id", "seq").select("prot_id", "seq")


@query("valid_sequences", f"WITH {_SEQ} SELECT prot_id, md5(seq) AS digest FROM s WHERE lower(seq) <> 'nan'")
def valid(spark, sf):
    """Every sequence comes twice, once under a text id; unusable ids go."""
    df = role(spark, sf, "sequences")
    twice = df.withColumn("prot_id", F.explode(F.array(
        F.concat(F.col("prot_id").cast("string"), F.lit(".0")), F.lit("unknown"))))
    return sequences.valid_sequences(twice, "prot_id", "seq").select("prot_id", F.md5("seq").alias("digest"))


_SLIDING = """w AS (SELECT prot_id, seq, unnest(CASE WHEN length(seq) <= 1024 THEN [0] ELSE
    range(0, CAST(ceil((length(seq) - 1024) / 512.0) AS BIGINT) * 512 + 1, 512) END) AS start FROM s)"""
_TAIL = """w AS (SELECT prot_id, seq, unnest(CASE WHEN length(seq) <= 1024 THEN [0] ELSE list_distinct(list_append(
    range(0, length(seq) - 1024 + 1, 512), length(seq) - 1024)) END) AS start FROM s)"""
_PIECES = """SELECT prot_id, CAST(row_number() OVER (PARTITION BY prot_id ORDER BY start) - 1 AS INTEGER) AS "window",
    CAST(start AS INTEGER) AS start, md5(substring(seq, start + 1, 1024)) AS piece FROM w"""


def _windows(spark, sf, tail=False):
    w = sequences.sequence_windows(_sequences(spark, sf), "seq", tail_anchored=tail)
    return w.select("prot_id", "window", "start", F.md5("piece").alias("piece"))


@query("sequence_windows", f"WITH {_SEQ}, {_SLIDING} {_PIECES}")
def sliding(spark, sf):
    return _windows(spark, sf)


@query("sequence_windows_tail_anchored", f"WITH {_SEQ}, {_TAIL} {_PIECES}")
def tail_anchored(spark, sf):
    return _windows(spark, sf, tail=True)


@query("encoding_stats", f"""WITH {_SEQ}, {_SLIDING}, n AS (SELECT prot_id, count(*) AS c FROM w GROUP BY prot_id)
    SELECT count(*) AS proteins, count(*) FILTER (c > 1) AS long_proteins, CAST(sum(c) AS BIGINT) AS total_windows FROM n""")
def stats(spark, sf):
    return sequences.encoding_stats(sequences.sequence_windows(_sequences(spark, sf), "seq"), "prot_id")


def _encode(batches):
    """Stand-in encoder: three letter counts per window."""
    for pdf in batches:
        s = pdf["piece"]
        yield pd.DataFrame({"prot_id": pdf["prot_id"], "window": pdf["window"], "vec": [
            [float(len(t)), float(t.count("A")), float(t.count("E"))] for t in s]})


@query("embed", f"""WITH {_SEQ}, {_SLIDING}, p AS (SELECT prot_id, substring(seq, start + 1, 1024) AS piece FROM w)
    SELECT prot_id, {r("avg(length(piece))")} AS n, {r("avg(length(piece) - length(replace(piece, 'A', '')))")} AS a,
           {r("avg(length(piece) - length(replace(piece, 'E', '')))")} AS e FROM p GROUP BY prot_id""")
def embedded(spark, sf):
    windows = sequences.sequence_windows(_sequences(spark, sf), "seq").select("prot_id", "window", "piece")
    vecs = sequences.embed(windows, _encode, "prot_id long, window int, vec array<double>", partitions=16)
    pooled = sequences.pool_mean(vecs.withColumn("residue", F.lit(0)), "prot_id")
    return pooled.select("prot_id", *[rounded(F.get("vec", F.lit(i))).alias(n) for i, n in enumerate("nae")])


# -- residue tokens: the words of a document, three numbers each ---------------------------------

_TOKENS = """t AS (SELECT doc_id, pos, length(word) AS a, ascii(word) AS b, pos % 7 AS c FROM (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (
        SELECT doc_id, string_split(text, ' ') AS ws FROM documents)))"""


def tokens(spark, sf):
    words = table(spark, sf, "documents", "doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("residue", "word"))
    return words.select("doc_id", "residue", F.array(
        F.length("word").cast("float"), F.ascii("word").cast("float"), (F.col("residue") % 7).cast("float")).alias("vec"))


def _wide(df, *keys):
    return df.select(*keys, *[rounded(F.get("vec", F.lit(i))).alias(n) for i, n in enumerate("abc")])


@query("pool_mean", f"""WITH {_TOKENS}, w AS (
        SELECT doc_id, pos // 100 AS w, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM t GROUP BY ALL)
    SELECT doc_id, {r('avg(a)')} AS a, {r('avg(b)')} AS b, {r('avg(c)')} AS c FROM w GROUP BY doc_id""")
def pooled(spark, sf):
    windowed = tokens(spark, sf).withColumn("window", F.floor(F.col("residue") / 100))
    return _wide(sequences.pool_mean(windowed, "doc_id"), "doc_id")


@query("pool_cls", f"""WITH {_TOKENS} SELECT doc_id, {r('avg(a)')} AS a, {r('avg(b)')} AS b, {r('avg(c)')} AS c
    FROM t WHERE pos % 100 = 0 GROUP BY doc_id""")
def pooled_cls(spark, sf):
    windowed = tokens(spark, sf).withColumn("window", F.floor(F.col("residue") / 100))
    return _wide(sequences.pool_mean(windowed, "doc_id", pool="cls"), "doc_id")


@query("stitch_windows", f"""WITH {_TOKENS}, l AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
    w AS (SELECT doc_id, unnest(CASE WHEN n <= 64 THEN [0] ELSE list_distinct(list_append(range(0, n - 64 + 1, 32), n - 64))
          END) AS start FROM l)
    SELECT doc_id, CAST(pos AS INTEGER) AS residue_idx, {r('avg(a + start)')} AS a, {r('avg(b)')} AS b, {r('avg(c)')} AS c
    FROM t JOIN w USING (doc_id) WHERE pos >= start AND pos < start + 64 GROUP BY ALL""")
def stitched(spark, sf):
    return _wide(stitched_tokens(spark, sf), "doc_id", "residue_idx")


def stitched_tokens(spark, sf):
    """Each window shifts the first number by its start, so overlaps differ."""
    # Many small tasks: each holds a sum for every residue of its documents.
    docs = table(spark, sf, "documents").repartition(4 * parallelism(spark), "doc_id")

    def pieces(words):
        starts = sequences.window_starts(F.size(words), 64, 32, tail_anchored=True)
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(words, s + 1, 64).alias("piece")))

    # A text is split once, not once for each of its windows.
    windows = docs.select("doc_id", F.explode(vectors.bind(F.split("text", " "), pieces)).alias("w")).select("doc_id", "w.*")
    seen = windows.select("doc_id", "start", F.posexplode("piece").alias("offset", "word"))
    vecs = seen.select("doc_id", "start", "offset", F.array(
        (F.length("word") + F.col("start")).cast("float"), F.ascii("word").cast("float"),
        ((F.col("start") + F.col("offset")) % 7).cast("float")).alias("vec"))
    lengths = docs.select("doc_id", F.size(F.split("text", " ")).alias("length"))
    return sequences.stitch_windows(vecs, "doc_id", lengths, dims=3)


@query("boundary_trim", """
    SELECT doc_id, len(string_split(text, ' ')) AS n, md5(text) AS digest FROM documents""")
def trimmed(spark, sf):
    """Every other document carries begin and end tokens."""
    words = F.split("text", " ")
    df = table(spark, sf, "documents").select("doc_id", F.size(words).alias("n"), F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.array(F.lit("<s>")), words, F.array(F.lit("</s>")))).otherwise(words).alias("t"))
    out = df.select("doc_id", vectors.boundary_trim(F.col("t"), F.col("n")).alias("t"))
    return out.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("center_crop", f"""WITH {_TOKENS}, l AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id)
    SELECT doc_id, CASE WHEN n > 128 THEN 128 ELSE n END AS kept,
           CAST(CASE WHEN n > 128 THEN (n - 128) // 2 ELSE 0 END AS INTEGER) AS first FROM l""")
def cropped(spark, sf):
    return sequences.center_crop(tokens(spark, sf), "doc_id", "residue", 128).groupBy("doc_id").agg(
        F.count("*").alias("kept"), F.min("residue").alias("first"))


@query("scan_manifest", f"""WITH {_TOKENS} SELECT doc_id AS prot_id, source AS protein_key, count(*) AS length,
        CAST(3 AS INTEGER) AS embedding_dim FROM t JOIN documents USING (doc_id)
    GROUP BY ALL""")
def manifest(spark, sf):
    """Records of all documents, checked against the bank of labelled ones."""
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("prot_id"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("prot_id"), F.col("source").alias("protein_key"))
    t = tokens(spark, sf).withColumnRenamed("doc_id", "prot_id").join(docs, "prot_id")
    records = sequences.token_manifest(t, ["prot_id", "protein_key"]).withColumn("token_file", F.lit("tokens"))
    path = sinks.write_table(records, scratch_path(spark, "manifest"))
    out = scans.scan_manifest(spark, path)
    if not sequences.unmapped_bank_rows(labelled, out, "prot_id").isEmpty():
        raise ValueError("bank rows without token records")
    return out.drop("token_file")
