import random

import pytest
from pyspark.sql import functions as F

from pairscreen.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds two thirds of the rows and a third of all scores tie."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        group = "hot" if rng.random() < 0.66 else f"g{rng.randrange(7)}"
        score = 0.0 if rng.random() < 0.35 else round(rng.uniform(-5, 5), 2)
        rows.append((i, group, score, rng.randrange(1, 9)))
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "id long, g string, s double, v long").repartition(parts)


def test_cuts_split_evenly_and_in_order(spark, skewed):
    df = ordering.with_range(frame(spark, skewed), ["s", "id"], n_ranges=16)
    per = df.groupBy("_range").agg(F.count("*").alias("n"), F.min(F.struct("s", "id")).alias("lo"),
                                   F.max(F.struct("s", "id")).alias("hi")).orderBy("_range").collect()
    assert len(per) > 10 and max(r["n"] for r in per) < 200
    assert all(a["hi"] < b["lo"] for a, b in zip(per, per[1:]))


def test_string_cuts(spark):
    names = sorted({f"{random.Random(i).choice('aZé中ß')}{i}\"\\" for i in range(300)})
    df = spark.createDataFrame([(n,) for n in names], "k string").repartition(3)
    got = ordering.assign_dense_ids(df, "k", "id").orderBy("id").collect()
    assert [r["k"] for r in got] == sorted(names, key=lambda s: s.encode())
    assert [r["id"] for r in got] == list(range(len(names)))


@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals(spark, skewed, parts):
    got = ordering.running_totals(frame(spark, skewed, parts), ["g"], ["s", "id"], ["v"]).collect()
    assert len(got) == len(skewed)
    for r in got:
        earlier = [v for i, g, s, v in skewed if g == r["g"] and (s, i) < (r["s"], r["id"])]
        assert r["before_v"] == sum(earlier)
    assert {r["total_v"] for r in got if r["g"] == "hot"} == {sum(v for _, g, _, v in skewed if g == "hot")}


def test_rank_keeps_ties_in_row_order(spark, skewed):
    got = {r["id"]: r["rank"] for r in ordering.rank_within_group(frame(spark, skewed), "g", "s", "id").collect()}
    for group in {g for _, g, _, _ in skewed}:
        members = sorted((x for x in skewed if x[1] == group), key=lambda x: (-x[2], x[0]))
        assert [got[x[0]] for x in members] == list(range(1, len(members) + 1))


def test_numbering_filtered_aggregates(spark, skewed):
    sizes = frame(spark, skewed).groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("t")).filter("n > 1 and t > 1")
    numbered = ordering.number_rows(sizes, [], ["g"], "i")
    assert numbered.count() == sizes.count()
    assert sorted(r["i"] for r in numbered.collect()) == list(range(sizes.count()))


def test_unusual_scores_keep_their_order(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, "a", s) for i, s in enumerate([inf, 1.0, -inf, nan, 2.0, -inf, inf, 0.5, -0.0, 0.0] * 9)]
    df = spark.createDataFrame(rows, "id long, g string, s double").repartition(4)
    got = ordering.number_rows(df, ["g"], ["s", "id"], "p").orderBy("p").collect()
    want = df.orderBy("s", "id").collect()
    assert [r["id"] for r in got] == [r["id"] for r in want] and [r["p"] for r in got] == list(range(90))
    with pytest.raises(ValueError, match="order by numbers"):
        ordering.number_rows(df.withColumn("t", F.current_timestamp()), ["g"], ["t"], "p")


def test_number_by_hash_is_a_permutation(spark, skewed):
    def numbered(parts):
        df = frame(spark, skewed, parts).withColumn("h", F.xxhash64(F.lit(3), "id"))
        rows = ordering.number_by_hash(df, ["g"], "h", "id", "p").collect()
        return {r["id"]: (r["g"], r["p"], r["p_total"]) for r in rows}

    a, b = numbered(1), numbered(6)
    assert a == b
    hot = sorted(p for g, p, _ in a.values() if g == "hot")
    assert hot == list(range(len(hot))) and {t for g, _, t in a.values() if g == "hot"} == {len(hot)}


def test_group_ids_follow_first_appearance(spark, skewed):
    got = ordering.group_ids(frame(spark, skewed), "g", "id").collect()
    seen = []
    for _, g, _, _ in skewed:
        if g not in seen:
            seen.append(g)
    assert {r["g"]: r["group_id"] for r in got} == {g: i for i, g in enumerate(seen)}
    assert len(got) == len(skewed)


@pytest.mark.parametrize("k", [0, 1, 13, 5000])
@pytest.mark.parametrize("salts", [1, 3])
def test_top_k_equals_sort_and_limit(spark, skewed, k, salts):
    df = frame(spark, skewed, 9)
    got = ordering.top_k_per_group(df, ["g"], [F.col("s").desc(), F.col("id").desc()], k, "r", salts).collect()
    want = []
    for group in {g for _, g, _, _ in skewed}:
        members = sorted((x for x in skewed if x[1] == group), key=lambda x: (x[2], x[0]), reverse=True)
        want += [(x[0], i + 1) for i, x in enumerate(members[:k])]
    assert sorted((r["id"], r["r"]) for r in got) == sorted(want)


def test_hot_groups_are_cut_before_the_shuffle(spark, skewed):
    df = ordering.top_k_per_group(frame(spark, skewed), ["g"], [F.col("s").desc(), F.col("id")], 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    first = ordering.first_per_key(frame(spark, skewed), ["g"], [F.col("id")])
    assert "Partial" in first._jdf.queryExecution().executedPlan().toString()


def test_first_per_key_and_limit_distinct(spark, skewed):
    df = frame(spark, skewed)
    got = ordering.first_per_key(df, ["g"], [F.col("id")]).collect()
    assert {r["g"]: r["id"] for r in got} == {g: min(i for i, h, _, _ in skewed if h == g) for _, g, _, _ in skewed}
    few = ordering.limit_distinct(df, "g", 2)
    names = sorted({g for _, g, _, _ in skewed})[:2]
    assert few.count() == sum(g in names for _, g, _, _ in skewed)
    assert ordering.limit_distinct(df, "g", 0).count() == len(skewed)


def test_heavy_ties_keep_the_plan_small(spark):
    """Many values that each fill several ranges."""
    import time

    df = spark.range(40_000).select(F.lit("g").alias("g"), (F.col("id") % 400).cast("double").alias("s"), "id")
    start = time.time()
    ranged = ordering.with_range(df, ["s", "id"], 4000)
    ranged._jdf.queryExecution().executedPlan()
    assert time.time() - start < 20
    edges = ranged.groupBy("_range").agg(F.min(F.struct("s", "id")).alias("lo"), F.max(F.struct("s", "id")).alias("hi")).orderBy("_range").collect()
    assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(edges, edges[1:])) and len(edges) > 1000
    got = ordering.rank_within_group(df, "g", "s", "id").collect()
    want = {i: k + 1 for k, i in enumerate(sorted(range(40_000), key=lambda i: (-(i % 400), i)))}
    assert {r.id: r["rank"] for r in got} == want
