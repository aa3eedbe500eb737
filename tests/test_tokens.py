import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscreen.operators import scoring, sequences
from pairscreen.plans.screen import attach_tokens, screen
from test_scoring import D, DRUGS, N, T, TARGETS, drugs, library, lists, proteins, targets

RNG = np.random.default_rng(9)
LENGTHS = [1, 4, 9, 30, 2]
RESIDUES = [RNG.integers(-2, 3, (n, 3)).astype(float) for n in LENGTHS]
LIMIT = 5


def tokens(spark):
    rows = [(f"f{t}", i, v.tolist()) for t, m in enumerate(RESIDUES) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "token_file string, residue_idx long, vec array<float>").repartition(3)


def manifest(spark):
    """Odd targets are found by key, even ones by id."""
    rows = [(str(t) if t % 2 == 0 else "none", f"t::{t}" if t % 2 else "other", f"f{t}", n) for t, n in enumerate(LENGTHS)]
    return spark.createDataFrame(rows, "prot_id string, protein_key string, token_file string, length long")


def middle(t):
    lo = max(0, (LENGTHS[t] - LIMIT) // 2)
    return RESIDUES[t][lo:lo + LIMIT]


def models():
    return [scoring.dot_model("dot", D), scoring.ResidueModel("residues", 0.5)]


def expected():
    match = [DRUGS[:, :3] @ middle(t).T * 0.5 for t in range(T)]
    dot = DRUGS @ TARGETS.T
    return (np.stack([dot, np.stack([m.max(1) for m in match], 1)], 2),
            np.stack([dot, np.stack([m.mean(1) for m in match], 1)], 2))


@pytest.mark.parametrize("block", [1, 64 << 20])
def test_screen_with_residues(spark, monkeypatch, block):
    """A tiny block size makes one pass per target."""
    monkeypatch.setattr(scoring, "TARGET_BLOCK_BYTES", block)
    got = screen(library(spark), drugs(spark), targets(spark), proteins(spark), models(), top_k=9, bottom_k=4, beta=0.5,
                 tokens=tokens(spark), manifest=manifest(spark), max_tokens=LIMIT)
    cls, rank = expected()
    final = rank.mean(2) - 0.5 * rank.std(2)
    top = lists(got.top)
    for t in range(T):
        best = sorted(((round(final[i, t], 9), i) for i in range(N)), reverse=True)[:9]
        assert sorted(round(final[i, t], 9) for i in top[t]) == sorted(s for s, _ in best)
    for r in got.top.collect():
        t = int(r["protein_key"].split("::")[1])
        assert r["cls_logit_mean"] == pytest.approx(cls[r["drug_id"], t].mean())
        assert r["final_score"] == pytest.approx(final[r["drug_id"], t])


def test_targets_need_one_record_with_residues(spark):
    with pytest.raises(Exception, match="single token record"):
        attach_tokens(targets(spark), manifest(spark).unionByName(manifest(spark).withColumn(
            "token_file", F.lit("again"))), tokens(spark), LIMIT).collect()
    one = attach_tokens(targets(spark), manifest(spark), tokens(spark), LIMIT)
    assert {r["protein_key"]: len(r["tokens"]) for r in one.collect()} == {f"t::{t}": min(LIMIT, n) for t, n in enumerate(LENGTHS)}
    less = tokens(spark).filter("token_file <> 'f2'")
    with pytest.raises(ValueError, match="without residues"):
        screen(library(spark), drugs(spark), targets(spark), proteins(spark), models(), tokens=less,
               manifest=manifest(spark), max_tokens=LIMIT)
    with pytest.raises(ValueError, match="have no tokens"):
        screen(library(spark), drugs(spark), targets(spark), proteins(spark), models())


@pytest.mark.parametrize("size", [3, 1024])
def test_pairs_with_residues(spark, monkeypatch, size):
    """One protein holds most pairs; the last has no residues and its pairs fall away."""
    monkeypatch.setattr(scoring, "PAIRS_PER_CHUNK", size)
    rows = [(n, n % N, 0 if n % 3 else n % T) for n in range(400)]
    pairs = spark.createDataFrame(rows, "row_id long, drug_idx long, prot_idx long").repartition(5)
    bank = drugs(spark).withColumnRenamed("drug_id", "idx")
    cropped = sequences.center_crop(tokens(spark), "token_file", "residue_idx", LIMIT)
    held = sequences.gather_tokens(cropped, "token_file", "residue_idx").select(
        F.substring("token_file", 2, 9).cast("long").alias("idx"), "tokens").filter(f"idx < {T - 1}")
    got = scoring.score_pairs(pairs, bank, proteins(spark), models(), tokens=held).collect()
    cls, rank = expected()
    assert sorted(r["row_id"] for r in got) == [n for n, _, t in rows if t < T - 1]
    for r in got:
        assert r["cls_logits"] == pytest.approx(cls[r["drug_idx"], r["prot_idx"]].tolist())
        assert r["rank_logits"] == pytest.approx(rank[r["drug_idx"], r["prot_idx"]].tolist())
    with pytest.raises(ValueError, match="no tokens are given"):
        scoring.score_pairs(pairs, bank, proteins(spark), models())
