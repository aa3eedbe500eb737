import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscreen.operators import sequences


def sliding(n, width, stride):
    if n <= width:
        return [0]
    out, start = [], 0
    while start < n:
        out.append(start)
        if start + width >= n:
            break
        start += stride
    return out


def anchored(n, width, stride):
    if n <= width:
        return [0]
    out = list(range(0, n - width + 1, stride))
    return out if out[-1] == n - width else out + [n - width]


@pytest.mark.parametrize("width, stride", [(8, 4), (8, 8), (7, 3), (4, 6), (1, 1)])
def test_window_starts(spark, width, stride):
    df = spark.range(1, 60).select(F.col("id").cast("int").alias("n"))
    for tail, rule in ((False, sliding), (True, anchored)):
        got = df.select("n", sequences.window_starts(F.col("n"), width, stride, tail).alias("s")).collect()
        assert all(r["s"] == rule(r["n"], width, stride) for r in got)


def test_windows_hold_the_text(spark):
    text = "ABCDEFGHIJé中Z"
    df = spark.createDataFrame([(1, text), (2, "AB")], "id int, seq string")
    got = sequences.sequence_windows(df, "seq", 5, 3).orderBy("id", "window").collect()
    assert [(r["id"], r["start"], r["piece"]) for r in got] == [
        *[(1, s, text[s:s + 5]) for s in sliding(len(text), 5, 3)], (2, 0, "AB")]
    stats = sequences.encoding_stats(sequences.sequence_windows(df, "seq", 5, 3), "id").first()
    assert tuple(stats) == (2, 1, len(sliding(len(text), 5, 3)) + 1)


def test_valid_sequences(spark):
    rows = [(0, "2", "mk"), (1, "2.0", "second"), (2, "x", "mk"), (3, "4", " \n"), (4, "5", "nan"), (5, "6", None), (6, "1e1", "a b")]
    df = spark.createDataFrame(rows, "row_id int, id string, seq string")
    got = sequences.valid_sequences(df, "id", "seq", row_id="row_id").orderBy("id").collect()
    assert [(r["id"], r["seq"]) for r in got] == [(2, "MK"), (10, "AB")]
    with pytest.raises(Exception, match="empty sequence"):
        sequences.valid_sequences(df.filter("row_id = 3"), "id", "seq", strict=True).collect()
    with pytest.raises(Exception, match="unusable id"):
        sequences.valid_sequences(df.filter("row_id = 2"), "id", "seq", strict=True).collect()


@pytest.fixture(scope="module")
def tokens(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key, length in ((1, 30), (2, 5)):
        for w, start in enumerate(anchored(length, 8, 5)):
            for offset in range(min(8, length)):
                rows.append((key, w, start, offset, rng.normal(size=3).tolist()))
    return rows


SCHEMA = "id int, window int, start int, offset int, vec array<double>"


def test_pooling(spark, tokens):
    df = spark.createDataFrame(tokens, SCHEMA).withColumn("residue", F.col("start") + F.col("offset")).repartition(4)
    for pool in ("mean", "cls"):
        got = {r["id"]: r["vec"] for r in sequences.pool_mean(df, "id", pool=pool).collect()}
        for key in (1, 2):
            per = [[np.array(t[4]) for t in tokens if t[0] == key and t[1] == w] for w in {t[1] for t in tokens if t[0] == key}]
            want = np.mean([v[0] if pool == "cls" else np.mean(v, axis=0) for v in per], axis=0)
            assert np.allclose(got[key], want)
    with pytest.raises(ValueError):
        sequences.pool_mean(df, "id", pool="max")


def test_stitching(spark, tokens):
    df = spark.createDataFrame(tokens, SCHEMA).repartition(4)
    lengths = spark.createDataFrame([(1, 30), (2, 5)], "id int, length int")
    got = {(r["id"], r["residue_idx"]): r["vec"] for r in sequences.stitch_windows(df, "id", lengths).collect()}
    assert len(got) == 35
    for (key, i), v in got.items():
        assert np.allclose(v, np.mean([t[4] for t in tokens if t[0] == key and t[2] + t[3] == i], axis=0))
    for gap in ("not (id = 1 and start = 10)", "not (id = 1 and start = 5 and offset = 3)", "id = 2"):
        holes = df.filter(gap)
        if gap.startswith("not (id = 1 and start = 10"):
            holes = holes.filter("not (id = 1 and start in (5, 15))")
        with pytest.raises(ValueError, match="uncovered"):
            sequences.stitch_windows(holes, "id", lengths)


def test_stitching_by_element(spark, tokens):
    """Sums by element give what the gathered vectors give, NULL vectors and elements included."""
    rows = [(9, 0, 0, 0, [1.0, None, 3.0]), (9, 1, 0, 0, None), (9, 1, 0, 1, None), (9, 1, 0, 2, [-2.0, 0.5, 4.0])]
    df = spark.createDataFrame(tokens, SCHEMA).repartition(4).unionByName(spark.createDataFrame(rows, SCHEMA))
    found = sequences.stitch_windows(df, "id", dims=3)
    assert sorted(map(str, found.collect())) == sorted(map(str, sequences.stitch_windows(df, "id").collect()))
    chosen = found.join(F.broadcast(spark.createDataFrame([(2,)], "id int")), "id", "left_semi")
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")  # chosen before they are stitched
    with pytest.raises(Exception, match="must have 2 elements"):
        sequences.stitch_windows(df, "id", dims=2).collect()


def test_words_are_split_once_a_text(spark, tmp_path):
    from catalog.features import stitched_tokens

    spark.createDataFrame([(1, "a b c"), (2, " ".join("w" * 90))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = stitched_tokens(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_center_crop_never_sorts_residues(spark, monkeypatch):
    monkeypatch.setattr(sequences, "KEYS_SENT", 0)
    df = spark.createDataFrame([(k, i) for k, n in ((1, 30), (2, 5), (None, 7)) for i in range(n)], "id int, i int")
    found = sequences.center_crop(df, "id", "i", 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, [
        *[(1, i) for i in range(13, 17)], *[(2, i) for i in range(4)], *[(None, i) for i in range(1, 5)]]))


@pytest.mark.parametrize("limit", [1, 4, 5, 30, 99])
def test_center_crop(spark, limit):
    df = spark.createDataFrame([(k, i) for k, n in ((1, 30), (2, 5)) for i in range(n)], "id int, i int")
    got = {}
    for r in sequences.center_crop(df, "id", "i", limit).collect():
        got.setdefault(r["id"], []).append(r["i"])
    for key, n in ((1, 30), (2, 5)):
        start = max(0, (n - limit) // 2)
        assert sorted(got[key]) == list(range(n))[start:start + limit]


def test_manifest_completeness(spark, tokens):
    df = spark.createDataFrame(tokens, SCHEMA)
    manifest = sequences.token_manifest(df, ["id"])
    assert [tuple(r) for r in manifest.collect()][1] == (2, 5, 3)
    bank = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert [r[0] for r in sequences.unmapped_bank_rows(bank, manifest, "id").collect()] == [3]
