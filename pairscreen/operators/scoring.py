"""Scoring of pairs and of whole libraries against targets.

A *model* turns vectors into two logits per pair (classification, ranking).
It is any object with two methods over NumPy arrays:

``grid(drugs[n, d], targets[t, p]) -> (cls[n, t], rank[n, t])``
``pairs(drugs[n, d], proteins[n, p]) -> (cls[n], rank[n])``

``LinearModel`` covers dot products and the linear heads that
``operators.training`` fits; a frozen network plugs in the same way.

A model may say more of itself in two attributes. ``outputs`` names further numbers of a pair
(view weights, gates) that ``pairs`` returns behind the two logits, an array each; they are carried
through predictions and ensembles. ``uses_domain`` asks for the pairs' domains (0 human, 1 virus) as a
third argument of both methods; a screen's targets are all viral. ``uses_tokens`` asks for the proteins'
residues: ``grid`` gets ``tokens[t, l, k]`` and ``mask[t, l]`` by keyword, padded with zeros where the
mask is false, and ``pairs`` the same for each of its rows' one protein, ``tokens[l, k]`` and ``mask[l]``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairscreen.functions.vectors import sigmoid, vec_mean, vec_std
from pairscreen.operators.joins import attach_metadata, salted_join
from pairscreen.operators.ordering import number_rows, top_k_per_group
from pairscreen.session import materialize

# Bounds on what a task holds: one block of targets (vectors and shortlists),
# and the scores of one tile of rows.
TARGET_BLOCK_BYTES = 64 << 20
TILE_CELLS = 2_000_000
PAIRS_PER_CHUNK = 1024
SLACK = 1e-9
VIRUS = 1  # as infer_domain numbers it
OUTPUT = "_output_"


@dataclass(frozen=True)
class LinearHead:
    """``bias + drug.w + protein.v + sum_i cross_i drug_i protein_i +
    sum_i gap_i |drug_i - protein_i| + sum_k bilinear_k (drug_map drug)_k
    (protein_map protein)_k``; unset parts count as zero."""

    bias: float = 0.0
    drug: Sequence[float] | None = None
    protein: Sequence[float] | None = None
    cross: Sequence[float] | None = None
    gap: Sequence[float] | None = None
    bilinear: Sequence[float] | None = None
    drug_map: Sequence[Sequence[float]] | None = None
    protein_map: Sequence[Sequence[float]] | None = None

    def _mapped(self, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weighted = d @ np.asarray(self.drug_map, dtype=float).T * np.asarray(self.bilinear, dtype=float)
        return weighted, p @ np.asarray(self.protein_map, dtype=float).T

    def grid(self, d: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.full((len(d), len(p)), float(self.bias))
        if self.drug is not None:
            out += (d @ np.asarray(self.drug, dtype=float))[:, None]
        if self.protein is not None:
            out += (p @ np.asarray(self.protein, dtype=float))[None, :]
        if self.cross is not None:
            out += (d * np.asarray(self.cross, dtype=float)) @ p.T
        if self.gap is not None:
            weights = np.asarray(self.gap, dtype=float)
            for j in range(len(p)):
                out[:, j] += np.abs(d - p[j]) @ weights
        if self.bilinear is not None:
            left, right = self._mapped(d, p)
            out += left @ right.T
        return out

    def pairs(self, d: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.full(len(d), float(self.bias))
        if self.drug is not None:
            out += d @ np.asarray(self.drug, dtype=float)
        if self.protein is not None:
            out += p @ np.asarray(self.protein, dtype=float)
        if self.cross is not None:
            out += np.einsum("ij,ij,j->i", d, p, np.asarray(self.cross, dtype=float))
        if self.gap is not None:
            out += np.abs(d - p) @ np.asarray(self.gap, dtype=float)
        if self.bilinear is not None:
            out += np.einsum("ij,ij->i", *self._mapped(d, p))
        return out


@dataclass(frozen=True)
class LinearModel:
    """Two linear heads under a name and seed."""

    name: str
    cls: LinearHead
    rank: LinearHead
    seed: int = -1

    def grid(self, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.cls.grid(d, p), self.rank.grid(d, p)

    def pairs(self, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.cls.pairs(d, p), self.rank.pairs(d, p)


@dataclass(frozen=True)
class DomainModel:
    """One model for human and one for viral proteins, with the outputs that both have."""

    name: str
    human: object
    virus: object
    seed: int = -1
    uses_domain = True

    @property
    def outputs(self) -> tuple[str, ...]:
        theirs = outputs_of([self.virus])
        return tuple(n for n in outputs_of([self.human]) if n in theirs)

    def grid(self, d: np.ndarray, p: np.ndarray, domain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        human, virus = self.human.grid(d, p), self.virus.grid(d, p)
        return tuple(np.where(domain[None, :] == VIRUS, b, a) for a, b in zip(human, virus))

    def pairs(self, d: np.ndarray, p: np.ndarray, domain: np.ndarray) -> tuple[np.ndarray, ...]:
        both = []
        for model in (self.human, self.virus):
            values = model.pairs(d, p)
            named = dict(zip(getattr(model, "outputs", ()), values[2:]))
            both.append([values[0], values[1], *[named[n] for n in self.outputs]])
        return tuple(np.where(domain == VIRUS, b, a) for a, b in zip(*both))


@dataclass(frozen=True)
class ResidueModel:
    """How well a compound's first dimensions match a protein's residues: the classification logit is
    the best match by dot product, the ranking logit the mean of all, both times ``scale``."""

    name: str
    scale: float = 1.0
    seed: int = -1
    uses_tokens = True

    def pairs(self, d: np.ndarray, p: np.ndarray, tokens: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        real = tokens[mask]
        match = d[:, :real.shape[1]] @ real.T * self.scale
        return match.max(axis=1), match.mean(axis=1)

    def grid(self, d: np.ndarray, p: np.ndarray, tokens: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = [self.pairs(d, p, t, m) for t, m in zip(tokens, mask)]
        return tuple(np.stack([x[h] for x in each], axis=1) for h in (0, 1))


def outputs_of(models: Sequence) -> list[str]:
    """Names of all further outputs, each once, in the models' order."""
    return list(dict.fromkeys(n for m in models for n in getattr(m, "outputs", ())))


def _pair_values(model, names: Sequence[str], d: np.ndarray, p: np.ndarray, domain: np.ndarray | None,
                 residues: dict[str, np.ndarray] | None = None) -> list[np.ndarray]:
    """Both logits of a model and its outputs under ``names``; NaN for those it has not."""
    args = [d, p, domain] if getattr(model, "uses_domain", False) else [d, p]
    found = model.pairs(*args, **(residues if getattr(model, "uses_tokens", False) else {}))
    own = tuple(getattr(model, "outputs", ()))
    if len(found) != 2 + len(own):
        raise ValueError(f"model {model.name} declares {len(own)} outputs and returns {len(found) - 2}")
    named = dict(zip(own, found[2:]))
    return [*found[:2], *[np.asarray(named[n], float) if n in named else np.full(len(d), np.nan) for n in names]]


def _grid_values(model, d: np.ndarray, p: np.ndarray, residues: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    args = [d, p, np.full(len(p), VIRUS)] if getattr(model, "uses_domain", False) else [d, p]
    return model.grid(*args, **(residues if getattr(model, "uses_tokens", False) else {}))


def _token_models(models: Sequence) -> bool:
    return any(getattr(m, "uses_tokens", False) for m in models)


def _padded(residues: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
    """Residue matrices of several proteins as one block with its mask."""
    longest, width = max(len(r) for r in residues), residues[0].shape[1]
    tokens, mask = np.zeros((len(residues), longest, width)), np.zeros((len(residues), longest), dtype=bool)
    for i, r in enumerate(residues):
        tokens[i, :len(r)], mask[i, :len(r)] = r, True
    return {"tokens": tokens, "mask": mask}


def dot_model(name: str, width: int, active: int | None = None, seed: int = -1) -> LinearModel:
    """Both logits are the dot product over the first ``active`` dimensions."""
    kept = width if active is None else active
    head = LinearHead(cross=[1.0] * kept + [0.0] * (width - kept))
    return LinearModel(name, head, head, seed)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as one matrix, without Python objects."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(flat) == 0:
        return np.zeros((0, 0))
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def _tiles(batch: pa.RecordBatch, cells_per_row: int) -> Iterable[pa.RecordBatch]:
    rows = max(1, TILE_CELLS // max(1, cells_per_row))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, m = matrix.shape
    offsets = pa.array(np.arange(0, n * m + 1, m, dtype=np.int32) if m else np.zeros(n + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).reshape(-1)))


# -- labelled pairs ---------------------------------------------------------------------

def score_pairs(pairs: DataFrame, drugs: DataFrame, proteins: DataFrame, models: Sequence,
                drug_idx: str = "drug_idx", prot_idx: str = "prot_idx", domain: str = "domain_id",
                tokens: DataFrame | None = None) -> DataFrame:
    """Add ``cls_logits, rank_logits`` and ``_output_<name>`` for every declared output (one element
    per model; NaN where a model has no such output) to pairs that carry bank indices, and
    the ``domain`` column if a model uses it.

    Pairs meet each bank in a join on its index, salted for hot entities;
    vectors do not travel through a shuffle with the pairs except where a
    second join must follow, so the protein side (the smaller bank, which
    Spark broadcasts while it is small) comes last.

    With a model that uses residues, ``tokens`` (``idx, tokens``) gives them by protein. The pairs of a
    protein are then cut by hash into chunks of about ``PAIRS_PER_CHUNK``, and residues and
    protein vector meet each chunk once instead of every pair. Pairs without residues fall away, like those
    without a vector; rows alike in all columns share a chunk.
    """
    if _token_models(models):
        if tokens is None:
            raise ValueError("a model uses residues, but no tokens are given")
        return _score_chunks(pairs, drugs, proteins.join(tokens, "idx"), models, drug_idx, prot_idx, domain)
    with_drug = salted_join(pairs, drugs.select(F.col("idx").alias(drug_idx), F.col("vec").alias("_d")),
                            [drug_idx], "inner")
    both = salted_join(with_drug, proteins.select(F.col("idx").alias(prot_idx), F.col("vec").alias("_p")),
                       [prot_idx], "inner", hot_from=pairs)
    kept = pairs.columns
    names, frozen = outputs_of(models), tuple(models)
    by_domain = any(getattr(m, "uses_domain", False) for m in models)
    if by_domain and domain not in kept:
        raise ValueError(f"a model uses the pairs' domain, but they have no column {domain}")
    added = ["cls_logits", "rank_logits", *[f"{OUTPUT}{n}" for n in names]]
    schema = T.StructType([pairs.schema[c] for c in kept] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in added])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            width = len(batch.column("_d")[0]) + len(batch.column("_p")[0]) if batch.num_rows else 0
            for b in _tiles(batch, width):
                d, p = _matrix(b.column("_d")), _matrix(b.column("_p"))
                of = b.column(domain).to_numpy(zero_copy_only=False) if by_domain else None
                values = [_pair_values(m, names, d, p, of) for m in frozen]
                arrays = [b.column(c) for c in kept]
                arrays += [_lists(np.stack([x[h] for x in values], axis=1)) for h in range(len(added))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *added])

    return both.select(*kept, "_d", "_p").mapInArrow(run, schema)


def _score_chunks(pairs: DataFrame, drugs: DataFrame, proteins: DataFrame, models: Sequence,
                  drug_idx: str, prot_idx: str, domain: str) -> DataFrame:
    """``score_pairs`` for models that use residues. Counts by protein fix the
    number of its chunks before any vector moves."""
    kept, names, frozen = pairs.columns, outputs_of(models), tuple(models)
    by_domain = any(getattr(m, "uses_domain", False) for m in models)
    if by_domain and domain not in kept:
        raise ValueError(f"a model uses the pairs' domain, but they have no column {domain}")
    added = ["cls_logits", "rank_logits", *[f"{OUTPUT}{n}" for n in names]]
    sizes = pairs.groupBy(prot_idx).agg(F.ceil(F.count("*") / PAIRS_PER_CHUNK).alias("_chunks"))
    dealt = salted_join(pairs, sizes, [prot_idx], "inner").withColumn(
        "_chunk", F.pmod(F.xxhash64(*kept), F.col("_chunks")))
    with_drug = salted_join(dealt, drugs.select(F.col("idx").alias(drug_idx), F.col("vec").alias("_d")), [drug_idx], "inner")
    chunks = with_drug.groupBy(F.col(prot_idx).alias("_prot"), "_chunk").agg(
        F.collect_list(F.struct(*kept, "_d")).alias("_rows"))
    met = chunks.join(proteins.select(F.col("idx").alias("_prot"), F.col("vec").alias("_p"), "tokens"), "_prot")
    schema = T.StructType([pairs.schema[c] for c in kept] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in added])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for chunk in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            rows = pa.RecordBatch.from_struct_array(chunk.column("_rows").flatten())
            p = _matrix(chunk.column("_p"))
            residues = _matrix(chunk.column("tokens").flatten())
            block = {"tokens": residues, "mask": np.ones(len(residues), dtype=bool)}
            for b in _tiles(rows, max(len(residues), p.shape[1])):
                d = _matrix(b.column("_d"))
                of = b.column(domain).to_numpy(zero_copy_only=False) if by_domain else None
                values = [_pair_values(m, names, d, np.repeat(p, len(d), axis=0), of, block) for m in frozen]
                arrays = [b.column(c) for c in kept]
                arrays += [_lists(np.stack([x[h] for x in values], axis=1)) for h in range(len(added))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *added])

    return met.filter(F.size("tokens") > 0).select("_rows", "_p", "tokens").mapInArrow(run, schema)


def prediction_table(scored: DataFrame, models: Sequence) -> DataFrame:
    """One row per pair and model with logits, probabilities and the models' outputs; the
    ``logit`` and ``prob`` columns are the classification head's."""
    names = F.array(*[F.struct(F.lit(m.name).alias("checkpoint"), F.lit(m.seed).alias("seed")) for m in models])
    extra = [c for c in scored.columns if c.startswith(OUTPUT)]
    each = scored.select(
        "*", F.explode(F.arrays_zip(names.alias("m"), F.col("cls_logits").alias("c"),
                                    F.col("rank_logits").alias("r"), *extra)).alias("_x"))
    others = [c for c in scored.columns if c not in ("cls_logits", "rank_logits", *extra)]
    c, r = F.col("_x.c"), F.col("_x.r")
    return each.select(
        F.col("_x.m.checkpoint").alias("checkpoint"), F.col("_x.m.seed").alias("seed"), *others,
        c.alias("logit"), sigmoid(c).alias("prob"), c.alias("cls_logit"), sigmoid(c).alias("cls_prob"),
        r.alias("rank_logit"), sigmoid(r).alias("rank_prob"), *[F.col(f"_x.{c}").alias(c.removeprefix(OUTPUT)) for c in extra])


def ensemble_columns() -> dict[str, Column]:
    """Mean and population deviation over models; probabilities belong to
    the mean logit."""
    cls, rank = F.col("cls_logits"), F.col("rank_logits")
    return {
        "cls_logit_mean": vec_mean(cls), "cls_prob_mean": sigmoid(vec_mean(cls)),
        "rank_logit_mean": vec_mean(rank), "rank_prob_mean": sigmoid(vec_mean(rank)),
        "cls_logit_std": vec_std(cls), "rank_logit_std": vec_std(rank),
    }


def ensemble_stats(scored: DataFrame) -> DataFrame:
    """Ensemble of scores held side by side: no shuffle. An output's ``<name>_mean`` is over
    the models that have a finite value of it."""
    extra = [c for c in scored.columns if c.startswith(OUTPUT)]

    def mean(c: str) -> Column:
        known = F.filter(F.col(c), lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return F.when(F.size(known) > 0, vec_mean(known))

    means = {f"{c.removeprefix(OUTPUT)}_mean": mean(c) for c in extra}
    return scored.withColumns(ensemble_columns() | means).drop("cls_logits", "rank_logits", *extra)


def ensemble_align(predictions: DataFrame, keys: Sequence[str], n_models: int | None = None) -> DataFrame:
    """Ensemble of stored predictions, one row per (pair, checkpoint),
    aligned by row id. A pair without exactly ``n_models`` rows is an error."""
    out = predictions.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.avg("cls_logit").alias("cls_logit_mean"), F.avg("rank_logit").alias("rank_logit_mean"),
        F.stddev_pop("cls_logit").alias("cls_logit_std"), F.stddev_pop("rank_logit").alias("rank_logit_std"))
    if n_models is not None:
        out = out.filter(F.when(F.col("_n") == n_models, F.lit(True)).otherwise(
            F.raise_error(F.lit("predictions of the models do not line up")).cast("boolean")))
    return out.drop("_n").withColumns({
        "cls_prob_mean": sigmoid(F.col("cls_logit_mean")), "rank_prob_mean": sigmoid(F.col("rank_logit_mean"))})


# -- a library against targets --------------------------------------------------------------

def _target_blocks(targets: DataFrame, listed: int) -> Iterator[tuple[pa.Table, bool]]:
    """Targets in blocks, and whether there are several. A block's vectors,
    residues and shortlists (up to ``4 * listed`` scores for each target and side) fit
    ``TARGET_BLOCK_BYTES``, each target counted with as many residues as the longest.

    Only (key, id, vector, residues) of one block at a time reach the driver; more
    targets mean more blocks, each scored in its own pass over the library.
    """
    more = [c for c in ("tokens",) if c in targets.columns]
    columns = targets.select("protein_key", "pdb_id", "vec", *more)
    numbers = F.size("vec") + (F.size("tokens") * F.size(F.get("tokens", F.lit(0))) if more else F.lit(0))
    total, width = columns.select(F.count("*"), F.max(numbers)).first()
    per_block = max(1, TARGET_BLOCK_BYTES // (8 * ((width or 1) + 4 * listed)))
    if total <= per_block:
        if total:
            yield columns.orderBy("protein_key").toArrow(), False
        return
    numbered = materialize(number_rows(columns, [], ["protein_key"], "_n"), "targets")
    for lo in range(0, total, per_block):
        yield numbered.filter((F.col("_n") >= lo) & (F.col("_n") < lo + per_block)).orderBy("_n").toArrow(), True


def check_targets(targets: DataFrame) -> None:
    """Reject repeated or unresolved targets before any scoring."""
    bad = targets.groupBy("protein_key").agg(
        F.count("*").alias("n"), F.count_if(F.col("vec").isNull()).alias("m")).filter("n > 1 or m > 0")
    rows = bad.limit(5).collect()
    if rows:
        raise ValueError(f"targets repeated or without a vector: {[r['protein_key'] for r in rows]}")
    if "tokens" in targets.columns:
        bare = targets.filter(F.col("tokens").isNull() | (F.size("tokens") <= 0)).select("protein_key").limit(5).collect()
        if bare:
            raise ValueError(f"targets without residues: {[r['protein_key'] for r in bare]}")


class _Shortlist:
    """Per target, which rows of a partition can still be among its best
    ``k``. Holds at most twice k of the best values seen so far, so its memory
    does not grow with the partition; it is cut back to k when it is full, and the
    bar rises only then. Rounding never rejects a row of the final answer: the bar
    is set by ``sure`` rows and lowered by ``SLACK`` for the ``possible`` ones.
    Scores that are no finite numbers are never admitted."""

    def __init__(self, k: int, n_targets: int):
        self.k = k
        self.held: list[np.ndarray] = []
        self.rows = 0
        self.bar = np.full(n_targets, -np.inf)

    def _cut(self) -> None:
        pool = np.concatenate(self.held)
        if len(pool) > self.k:
            pool = np.partition(pool, len(pool) - self.k, axis=0)[-self.k:]
        self.held, self.rows = [pool], len(pool)
        if len(pool) == self.k:
            floor = pool.min(axis=0)
            self.bar = np.where(np.isfinite(floor), floor - SLACK * np.maximum(1.0, np.abs(floor)), -np.inf)

    def admit(self, sure: np.ndarray, possible: np.ndarray) -> np.ndarray:
        if self.k <= 0:
            return np.zeros(sure.shape, dtype=bool)
        self.held.append(np.where(np.isfinite(sure), sure, -np.inf))
        self.rows += len(sure)
        if self.rows >= 2 * self.k:
            self._cut()
        return np.isfinite(possible) & (possible >= self.bar)


def cross_score(library: DataFrame, targets: DataFrame, models: Sequence, beta: float = 0.0,
                top: int | None = None, bottom: int | None = None, cls_min_prob: float = 0.0,
                drug_id: str = "drug_id") -> DataFrame:
    """Scores of every compound against every target.

    ``library`` has ``drug_id, vec`` (and optionally a boolean ``eligible``);
    ``targets`` has ``protein_key, pdb_id, vec`` and, for models that use residues, ``tokens``. The library streams past a
    block of target vectors as matrix products, so no pair row is built
    before it has a score and nothing is shuffled. With several blocks each is
    written before the next is fetched, so the driver holds one.

    With ``top``/``bottom`` set, each task passes on only rows that can still
    reach a target's best or worst K (the gate and eligibility apply to the
    top side): a superset of the answer, about K rows per target and task
    instead of every pair. A pair whose final score is no finite number makes
    no list, pruned or not; without pruning its row stays.
    """
    check_targets(targets)
    by_tokens = _token_models(models)
    if by_tokens and "tokens" not in targets.columns:
        raise ValueError("a model uses residues, but the targets have no tokens")
    targets = targets if by_tokens else targets.drop("tokens")
    has_flag = "eligible" in library.columns
    prune = top is not None or bottom is not None
    schema = T.StructType([
        library.schema[drug_id], T.StructField("protein_key", T.StringType()),
        T.StructField("pdb_id", T.StringType()), T.StructField("eligible", T.BooleanType()),
        T.StructField("cls_logits", T.ArrayType(T.DoubleType())),
        T.StructField("rank_logits", T.ArrayType(T.DoubleType()))])
    source = library.select(drug_id, "vec", *(["eligible"] if has_flag else []))
    frozen = tuple(models)
    out = None
    for block, several in _target_blocks(targets, (top or 0) + (bottom or 0)):
        matrix = _matrix(block.column("vec"))
        keys, pdbs = (block.column(c).cast(pa.string()).combine_chunks() for c in ("protein_key", "pdb_id"))
        ragged = [_matrix(t.values) for t in block.column("tokens")] if by_tokens else None

        def run(batches: Iterable[pa.RecordBatch], matrix=matrix, keys=keys, pdbs=pdbs, ragged=ragged) -> Iterable[pa.RecordBatch]:
            residues = _padded(ragged) if ragged else None
            cells = max(len(matrix) * len(frozen), residues["mask"].shape[1] if residues else 0)
            best, worst = _Shortlist(top or 0, len(matrix)), _Shortlist(bottom or 0, len(matrix))
            for b in (tile for batch in batches for tile in _tiles(batch, cells)):
                logits = [_grid_values(m, _matrix(b.column("vec")), matrix, residues) for m in frozen]
                cls, rank = (np.stack([x[h] for x in logits], axis=2) for h in (0, 1))
                flag = (b.column("eligible").to_numpy(zero_copy_only=False).astype(bool)
                        if has_flag else np.ones(b.num_rows, dtype=bool))
                if prune:
                    with np.errstate(invalid="ignore", over="ignore"):
                        final = rank.mean(axis=2) - beta * rank.std(axis=2)
                        prob = 1.0 / (1.0 + np.exp(-cls.mean(axis=2)))
                    sure, possible = (
                        np.where(flag[:, None] & (prob >= cls_min_prob + edge), final, -np.inf) for edge in (SLACK, -SLACK))
                    if cls_min_prob <= 0.0:
                        sure = possible
                    keep = best.admit(sure, possible) | worst.admit(-final, -final)
                else:
                    keep = np.ones(cls.shape[:2], dtype=bool)
                row, col = np.nonzero(keep)
                if len(row) == 0:
                    continue
                where, target = pa.array(row), pa.array(col)
                yield pa.RecordBatch.from_arrays(
                    [b.column(drug_id).take(where), keys.take(target), pdbs.take(target), pa.array(flag[row]),
                     _lists(cls[row, col]), _lists(rank[row, col])], names=schema.names)

        part = source.mapInArrow(run, schema)
        if several:
            part = materialize(part, "target-block")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else library.sparkSession.createDataFrame([], schema)


def final_score(beta: float = 0.0) -> Column:
    return F.col("rank_logit_mean") - F.lit(float(beta)) * F.col("rank_logit_std")


def screening_table(grid: DataFrame, beta: float = 0.0) -> DataFrame:
    """Ensemble columns and ``final_score``. A final score, or a probability to
    be gated on, that is no finite number is NULL: such pairs make no list."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    scored = ensemble_stats(grid).withColumn("final_score", finite(final_score(beta)))
    return scored.withColumn("cls_prob_mean", finite(F.col("cls_prob_mean")))


def score_gate(scores: DataFrame, cls_min_prob: float) -> DataFrame:
    return scores.filter(F.col("cls_prob_mean") >= cls_min_prob)


def top_k_per_target(scores: DataFrame, k: int, drug_id: str = "drug_id") -> DataFrame:
    """Highest ``final_score`` per target, NULL left out; ties go to the larger id."""
    order = [F.col("final_score").desc(), F.col(drug_id).desc()]
    return top_k_per_group(scores.filter("final_score is not null"), ["protein_key"], order, k, name="rank")


def bottom_k_per_target(scores: DataFrame, k: int, drug_id: str = "drug_id") -> DataFrame:
    """Lowest ``final_score`` per target, NULL left out; ties go to the smaller id."""
    order = [F.col("final_score").asc(), F.col(drug_id).asc()]
    return top_k_per_group(scores.filter("final_score is not null"), ["protein_key"], order, k, name="rank")


def top_hits(scores: DataFrame, k: int, cls_min_prob: float = 0.0) -> DataFrame:
    """Top K among eligible, gated rows."""
    return top_k_per_target(score_gate(scores.filter("eligible"), cls_min_prob), k)


def with_library_columns(hits: DataFrame, library: DataFrame, drug_id: str = "drug_id") -> DataFrame:
    return attach_metadata(hits, library, drug_id)
