"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document's expected copies are
the source's rate; their whole part is certain, the rest is an inclusion
probability. Documents are ranked by random odds over inclusion odds, and the
lowest ranks are taken until the source's words are filled. The cut of every
source is found from counts by rank slice, so no source is sorted in one task,
and documents are then taken by comparing their rank with the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairscreen.operators.ordering import number_rows
from pairscreen.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 1024
#: Passes that fill the words left below the document at the cut.
FILLS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(id_col: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the row's id, or from its text if that is NULL."""
    bits = F.xxhash64(F.lit(seed), F.coalesce(F.xxhash64(id_col), F.lit(0)),
                      F.when(id_col.isNull(), F.xxhash64(text)))
    return (F.shiftrightunsigned(bits, 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` rows.

    Sources in code-point order, NULL last, weigh ``weights`` in turn and share
    ``share`` of all words. No target passes ``cap`` times its source; the
    excess goes to the others by weight until none is above. Each round sends
    three numbers to the driver and caps at least one more source.
    """
    keyed = sizes.withColumn("_null", F.col("source").isNull().cast("int")).withColumn(
        "_text", F.coalesce("source", F.lit("")))
    numbered = number_rows(keyed, [], ["_null", "_text"], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights)).cast("int") + 1)
    held = materialize(numbered.select("source", "source_size", weight.alias("weight"),
                                       (F.col("source_size") * float(cap)).alias("most")), "mix-sources")
    level, capped = None, -1
    whole = held.agg(F.sum("source_size")).first()[0]
    while whole:
        above = F.lit(False) if level is None else F.col("most") <= level * F.col("weight")
        n, fixed, shared = held.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not shared:
            break
        capped, level = n, (whole * float(share) - fixed) / shared
    target = F.least(F.col("most"), F.col("weight") * level) if level is not None else F.lit(0.0)
    return held.select("source", "source_size", target.alias("target"))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, seed: int) -> DataFrame:
    """Whole rows as ``_row``, so that no column of theirs can clash, and what
    the draw needs of them."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    key, text, source = (F.col("_row").getField(c) for c in (id_col, text_col, source_col))
    weight = F.col("_row").getField(weight_col).cast("double") if weight_col else F.lit(1.0)
    return row.select("_row", key.alias("_id"), source.alias("_source"), word_count(text).alias("_size"),
                      _uniform(key, text, seed).alias("_u"), F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0)).alias("_weight"))


def _ranked(rows: DataFrame, cap: float) -> DataFrame:
    """Certain copies and rank (random odds over inclusion odds; NULL without
    a chance) of measured rows that carry their source's ``_rate``."""
    copies = F.least(F.lit(float(cap)), F.coalesce(F.col("_rate") * F.col("_weight"), F.lit(0.0)))
    whole = F.floor(copies + 1e-12)
    chance = F.greatest(copies - whole, F.lit(0.0))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (chance / (1 - chance))
    return rows.withColumn("_whole", whole.cast("long")).withColumn(
        "_rank", F.when((chance > 1e-12) & (F.col("_size") > 0), odds / (1 + odds)))


def _cut(rows: DataFrame, left: DataFrame, nearest: bool) -> DataFrame:
    """Per source the highest rank to take so that the words of all ranks up
    to it come nearest to ``_left`` (or stay at or below it): ``_source, _cut,
    _used``. ``rows`` has ``_source, _size, _rank``. Slices of the rank are
    counted twice, the second time inside the slice where the words run out;
    only rows of one slice of a slice are put in order."""
    held = left.select(F.col("_source").alias("_s"), "_left")
    same = F.col("_source").eqNullSafe(F.col("_s"))

    def crossing(counted: DataFrame, slot: str, before: Column) -> DataFrame:
        w = W.partitionBy("_source").orderBy(slot).rowsBetween(W.unboundedPreceding, 0)
        run = counted.withColumn("_upto", before + F.sum("_words").over(w))
        over = W.partitionBy("_source")
        first = F.min(F.when(F.col("_upto") >= F.col("_left"), F.col(slot))).over(over)
        return run.withColumn("_first", F.coalesce(first, F.max(slot).over(over))).filter(
            F.col(slot) == F.col("_first")).withColumn("_before", F.col("_upto") - F.col("_words"))

    one = rows.join(held, same).filter("_left > 0").withColumn("_a", F.floor(F.col("_rank") * SLICES)).withColumn(
        "_b", F.floor(F.col("_rank") * SLICES * SLICES))
    first = materialize(crossing(one.groupBy("_source", "_left", "_a").agg(F.sum("_size").alias("_words")), "_a", F.lit(0)).select(
        F.col("_source").alias("_s1"), F.col("_a").alias("_a1"), F.col("_before").alias("_base")), "mix-slice")
    two = one.join(first, F.col("_source").eqNullSafe(F.col("_s1")) & (F.col("_a") == F.col("_a1")))
    second = materialize(crossing(two.groupBy("_source", "_left", "_base", "_b").agg(F.sum("_size").alias("_words")), "_b", F.col("_base")).select(
        F.col("_source").alias("_s2"), F.col("_b").alias("_b2"), F.col("_before").alias("_base")), "mix-slice")
    # rows of equal rank are taken together
    last = one.join(second, F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_b") == F.col("_b2"))).groupBy(
        "_source", "_left", "_base", "_rank").agg(F.sum("_size").alias("_words"))
    upto = F.col("_base") + F.sum("_words").over(W.partitionBy("_source").orderBy("_rank").rowsBetween(W.unboundedPreceding, 0))
    before = F.col("_upto") - F.col("_words")
    fits = F.col("_upto") <= F.col("_left")
    if nearest:
        fits = fits | ((before < F.col("_left")) & (F.col("_upto") - F.col("_left") < F.col("_left") - before))
    chosen = last.withColumn("_upto", upto).groupBy("_source", "_left").agg(
        F.max(F.when(fits, F.col("_rank"))).alias("_in"), F.max(F.when(fits, F.col("_upto"))).alias("_at"),
        F.min("_rank").alias("_low"), F.first("_base").alias("_base"))
    return chosen.select(
        # where not even the first rank fits: a cut just below it
        "_source", F.coalesce("_in", F.col("_low") - F.col("_low") * 1e-15).alias("_cut"),
        F.coalesce("_at", "_base").alias("_used"))


def plan_mix(docs: DataFrame, weights: Sequence[float], share: float, cap: float = 2.0, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source", weight_col: str | None = None, seed: int = 1,
             fills: int = FILLS) -> tuple[DataFrame, DataFrame]:
    """Measured rows (ids, sizes, no text) and, per source, the decisions that
    say which documents the mix takes. See ``mix``."""
    sized = materialize(_measured(docs, id_col, text_col, source_col, weight_col, seed).select(
        "_id", "_source", "_size", "_u", "_weight"), "mix-sizes")
    by_source = materialize(sized.groupBy("_source").agg(
        F.sum("_size").alias("source_size"), F.sum(F.col("_weight") * F.col("_size")).alias("_mass")), "mix-totals")
    wanted = targets(by_source.select(F.col("_source").alias("source"), "source_size"), weights, share, cap)
    rates = by_source.join(wanted.select(F.col("source").alias("_s"), "target"), F.col("_source").eqNullSafe(F.col("_s"))).select(
        "_source", "source_size", "target",
        F.when(F.col("_mass") > 0, F.col("target") / F.col("_mass")).alias("_rate"))
    plan = materialize(rates, "mix-rates")
    rows = materialize(_ranked(_with(sized, plan.select("_source", "_rate")), cap), "mix-ranks")
    certain = rows.groupBy("_source").agg(F.sum(F.col("_whole") * F.col("_size")).alias("_certain"))
    plan = materialize(_with(plan, certain).withColumn("_left0", F.col("target") - F.col("_certain")), "mix-left")
    chances = rows.filter("_rank is not null").select("_source", "_size", "_rank")
    for k in range(fills + 1):
        cut = _cut(chances, plan.select("_source", F.col(f"_left{k}").alias("_left")), nearest=k == fills)
        plan = materialize(_with(plan, cut.withColumnsRenamed({"_cut": f"_cut{k}", "_used": f"_used{k}"})).withColumn(
            f"_left{k + 1}", F.col(f"_left{k}") - F.coalesce(f"_used{k}", F.lit(0))), "mix-cut")
        if k < fills:
            # next: documents beyond the cut that fit what is left
            chances = _with(chances, plan.select("_source", F.col(f"_cut{k}").alias("_c"), F.col(f"_left{k + 1}").alias("_l")))
            chances = chances.filter(F.col("_c").isNotNull() & (F.col("_rank") > F.col("_c")) & (
                F.col("_size") <= F.col("_l"))).select("_source", "_size", "_rank")
            chances = materialize(chances, "mix-rest")
    return rows, plan


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the source, NULL included; the right side is unique."""
    renamed = right.withColumnRenamed("_source", "_key")
    return left.join(renamed, F.col("_source").eqNullSafe(F.col("_key")), "left").drop("_key")


def _copies(fills: int) -> Column:
    """Copies of a ranked row that carries its source's decisions."""
    taken, out = F.lit(False), F.lit(True)
    for k in range(fills + 1):
        inside = out & F.coalesce(F.col("_rank") <= F.col(f"_cut{k}"), F.lit(False))
        taken = taken | inside
        out = out & F.coalesce((F.col("_rank") > F.col(f"_cut{k}")) & (F.col("_size") <= F.col(f"_left{k + 1}")), F.lit(False))
    return F.col("_whole") + taken.cast("long")


def decide(rows: DataFrame, plan: DataFrame, fills: int = FILLS) -> DataFrame:
    """Measured rows with ``copies``, ``source_size`` and ``target``."""
    extra = [c for c in plan.columns if c not in ("_rate", "_certain")]
    return _with(rows, plan.select(*extra)).withColumn("copies", _copies(fills))


def mix(docs: DataFrame, weights: Sequence[float], share: float, cap: float = 2.0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", weight_col: str | None = None, seed: int = 1) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it.

    Words decide sizes; NULL text has none. Documents without words are never
    drawn. ``weight_col`` (a document's importance, NULL as 0) scales expected
    copies inside a source, up to ``cap``. The draw depends on id and seed
    alone (on the text where the id is NULL): rows with equal ids in a source
    share their rank and are taken together. Texts are read twice and never
    shuffled unless there are too many sources for Spark to send to all tasks.
    Negative weights count as 0. No rows, or no words at all, give no rows.
    """
    _, plan = plan_mix(docs, weights, share, cap, id_col, text_col, source_col, weight_col, seed)
    rows = _measured(docs, id_col, text_col, source_col, weight_col, seed)
    ranked = _ranked(_with(rows, plan.select("_source", "_rate")), cap)
    taken = decide(ranked, plan).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")
