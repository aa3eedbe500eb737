"""SpotSigs fingerprints, in DataFrame functions only.

A signature is the chain of content words that follows a common word (the
anchor). A document's fingerprint is its set of signatures, as 32-bit hashes.
Boilerplate has few common words, so it leaves few signatures. Documents are
compared by the Jaccard coefficient of their sets; sets whose lengths alone rule a
likeness out are never compared.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairscreen.llm.graph import components
from pairscreen.operators.ordering import range_cuts
from pairscreen.session import materialize, parallelism

#: Anchors: common words of the supported languages.
ANCHORS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "an auf das dem den der des die ein eine er es im in ist mit nicht sich sie und von zu "
    "al como con de del el en es la las lo los no para por que se su un una y "
    "au aux ce dans de des du elle en est et il la le les ne pas pour qui sur un une").split()
CHAIN = 2
THRESHOLD = 0.8
ROWS_PER_RANGE = 20_000

_MARK = "\u0001"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = "\t\n\x0b\x0c\r.,;:!?|()[]{}<>\"*#$%&/\\+=~^`_@" + _MARK


def with_signatures(df: DataFrame, text: Column, name: str, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``df`` with the sorted distinct signature hashes of a text as ``name``.

    Words are split at white space and common punctuation, A-Z lower-cased. A
    chain starts at a content word that directly follows one or more anchors
    and has up to ``chain`` content words. Text without a chain has its whole
    word sequence as one signature; without a word (or NULL) it has none.
    """
    flat = F.translate(F.coalesce(text, F.lit("")), _BREAKS + _UPPER, " " * len(_BREAKS) + _LOWER)
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(flat, " {2,}", " ")), F.lit(" "))
    # after this every content word that follows an anchor carries a mark
    listed = "|".join(sorted(set(anchors), key=lambda w: (-len(w), w)))
    # (one anchor at a time: Java's matcher recurses into repeated groups, and
    # a text may be nothing but anchors)
    marked = F.regexp_replace(F.regexp_replace("_spaced", f"(?<= )(?:{listed}) ", _MARK), f"{_MARK}+", _MARK)
    found = F.regexp_extract_all(marked, F.lit(f"{_MARK}(?=([^ ]+(?: [^ ]+){{0,{chain - 1}}}))"), F.lit(1))
    hashed = F.transform("_found", lambda s: F.hash(F.translate(s, _MARK, "")))
    whole = F.when(F.length("_spaced") > 2, F.array(F.hash("_spaced"))).otherwise(F.array().cast("array<int>"))
    # columns of their own, so that each step is evaluated once
    steps = df.withColumn("_spaced", spaced).withColumn("_found", found)
    return steps.withColumn(name, F.array_sort(F.array_distinct(F.when(F.size("_found") > 0, hashed).otherwise(whole)))).drop(
        "_spaced", "_found")


def fingerprint(sigs: Column) -> Column:
    """The set as text: eight hex digits for every signature, in order."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def with_likeness(df: DataFrame, a: str, b: str, name: str, at_least: float = 0.0) -> DataFrame:
    """``df`` with the Jaccard coefficient of two signature columns as
    ``name``; NULL, without comparing, if their lengths keep it below
    ``at_least``. Two empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    apart = (large > 0) & (small < at_least * large - 1e-9)
    common = F.when(~apart & (small > 0), F.size(F.array_intersect(a, b))).when(~apart, F.lit(0))
    value = F.when(large == 0, F.lit(1.0)).otherwise(F.col("_common") / (small + large - F.col("_common")))
    return df.withColumn("_common", common).withColumn(name, F.when(F.col("_common").isNotNull(), value)).drop("_common")


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``columns`` of every row and, as struct ``_next``, those of the next row
    by descending id (after the last: the first). NULL ids come last, rows of
    one id in order of a hash. Rows move once: ids are cut into ranges, and the
    first row of a range is copied to the end of the range before it. Ranges
    are sized by the row count; the driver holds their cut points and first ids."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    keys = docs.select(key.alias("_key"))
    total = keys.count()
    ranges = max(parallelism(docs.sparkSession), total // ROWS_PER_RANGE)
    cuts = sorted({float(c[0]) for c in range_cuts(keys, ["_key"], ranges)})

    def with_range(df: DataFrame) -> DataFrame:
        if not cuts:
            return df.withColumn("_range", F.lit(0))
        slots = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_double", outputCol="_slot")
        placed = slots.transform(df.withColumn("_double", F.col("_key").cast("double")))
        return placed.withColumn("_range", F.col("_slot").cast("int")).drop("_double", "_slot")

    heads = with_range(keys).groupBy("_range").agg(F.max("_key").alias("_head")).collect()
    order = [r["_range"] for r in sorted(heads, key=lambda r: -r["_head"])]
    # the range before, going down; the first row of all closes the last range
    before = {r: order[i - 1] for i, r in enumerate(order)}
    spark = docs.sparkSession
    links = spark.createDataFrame([(r["_head"], before[r["_range"]]) for r in heads], "_head long, _to int")
    placed = with_range(rows).withColumn("_tie", F.xxhash64("_row"))
    # one row stands for a head: the one whose hash comes first
    first = placed.join(links, F.col("_key") == F.col("_head")).groupBy("_to").agg(F.min_by("_row", "_tie").alias("_row"))
    closing = first.select(F.col("_to").alias("_range"), F.lit(1).alias("_guard"), F.lit(0).cast("long").alias("_key"),
                           F.lit(0).cast("long").alias("_tie"), "_row")
    both = placed.select("_range", F.lit(0).alias("_guard"), "_key", "_tie", "_row").unionByName(closing)
    w = W.partitionBy("_range").orderBy("_guard", F.col("_key").desc(), "_tie")
    return both.select("*", F.lead("_row").over(w).alias("_next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, signatures, fingerprint`` for every row. Equal texts have equal
    fingerprints. Other columns are ignored."""
    read = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return with_signatures(read, F.col("_text"), "signatures").drop("_text").withColumn(
        "fingerprint", fingerprint(F.col("signatures")))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How fingerprints follow an edit. For every row ``id_col, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``: the
    last floor(n_chars / 2) characters are replaced by the first as many of the
    next document (descending id; after the last the first)."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    paired = with_next(read, "id", ["id", "text"])
    sigs = with_signatures(paired, F.col("_row.text"), "sigs")
    w = W.partitionBy("_range").orderBy("_guard", F.col("_key").desc(), "_tie")
    nexts = sigs.withColumn("next_sigs", F.lead("sigs").over(w)).filter("_guard = 0")
    text, half = F.col("_row.text"), F.floor(F.length("_row.text") / 2).cast("int")
    edited = F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(F.col("_next.text"), F.lit(1), half))
    held = nexts.select(F.col("_row.id").alias("id"), F.length(text).cast("long").alias("n_chars"), "sigs", "next_sigs",
                        edited.alias("edited"))
    done = with_signatures(held, F.col("edited"), "edited_sigs")
    done = with_likeness(with_likeness(done, "sigs", "edited_sigs", "near_edited"), "sigs", "next_sigs", "near_next")
    return done.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        "near_edited", "near_next")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, component``: the least id that pairs of likeness ``threshold`` or
    more connect with the row's. Ids must be unique and not NULL; documents
    without words stay alone.

    Equal sets are one class. A class is listed under its rarest signatures, so many that
    two alike classes share one, and under its length partition and the next:
    lengths of alike sets differ by at most one partition. Classes of a list are compared
    with its least class first; only lists that still hold several components
    are compared within.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(with_signatures(read, F.col("text"), "sigs").select("id", "sigs"), "spotsigs")
    filled = rows.filter(F.size("sigs") > 0).withColumn("h", F.sha2(F.array_join("sigs", ","), 256))
    sets = materialize(filled.groupBy("h").agg(F.min("id").alias("node"), F.first("sigs").alias("sigs")), "spotsigs-sets")
    flat = sets.select("node", F.size("sigs").alias("n"), F.explode("sigs").alias("s"))
    common = flat.groupBy("s").agg(F.count("*").alias("df"))
    ranked = flat.join(common, "s").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("by"))
    prefix = F.slice("by", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    part = F.floor(F.log("n") / math.log(1 / threshold) + 1e-9)
    keys = materialize(ranked.select("node", "n", F.explode(prefix).alias("x"), part.alias("p")).select(
        "node", F.explode(F.array(F.xxhash64("x.s", "p"), F.xxhash64("x.s", F.col("p") + 1))).alias("key")).distinct(), "spotsigs-lists")
    hubs = keys.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("c")).filter("c > 1").select("key", "a")
    shared = materialize(keys.join(hubs, "key"), "spotsigs-shared")

    def alike(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("node").alias("a"), F.col("sigs").alias("x"))
        two = sets.select(F.col("node").alias("b"), F.col("sigs").alias("y"))
        return with_likeness(pairs.join(one, "a").join(two, "b"), "x", "y", "near", threshold).filter(
            F.col("near") >= threshold - 1e-12).select("a", "b")

    tried = materialize(shared.filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "spotsigs-pairs")
    links = materialize(alike(tried), "spotsigs-links")
    open_ = shared.select("key", "node").join(components(links), "node", "left").withColumn("comp", F.coalesce("component", "node"))
    mixed = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    left = materialize(open_.join(mixed, "key").select("key", "node", "comp"), "spotsigs-open")
    more = left.alias("l").join(left.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & (
        F.col("l.comp") != F.col("r.comp"))).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    found = components(links.unionByName(alike(more.join(tried, ["a", "b"], "left_anti"))))
    return filled.select("id", "h").join(sets.select("h", "node"), "h").join(found, "node", "left").select(
        "id", F.coalesce("component", "node").alias("component")).unionByName(
            rows.filter(F.size("sigs") == 0).select("id", F.col("id").alias("component")))
