"""Registry and the roles that the given tables play.

A role is one plain SQL text. Spark runs it over the parquet files and the
SQL twin of a query over views, so both sides start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscreen.session import spread

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

ROLES = {
    "pairs": """
        SELECT CAST(l_partkey AS STRING) AS drug_id, CAST(l_suppkey AS STRING) AS prot_id,
               CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END AS label,
               CASE WHEN l_suppkey % 2 = 0 THEN 'human' ELSE 'virus' END AS prot_domain
        FROM {lineitem}""",
    # the same pairs as an export would spell them
    "messy_pairs": """
        SELECT CASE l_partkey % 3 WHEN 0 THEN CAST(l_partkey AS STRING) || '.0'
                    WHEN 1 THEN ' ' || CAST(l_partkey AS STRING) ELSE CAST(l_partkey AS STRING) END AS drug_id,
               CASE l_suppkey % 2 WHEN 0 THEN CAST(l_suppkey AS STRING) || '.0' ELSE CAST(l_suppkey AS STRING) END
                   AS prot_id,
               CASE l_returnflag WHEN 'R' THEN '1.0' WHEN 'A' THEN '0' ELSE '-1' END AS label,
               CASE WHEN l_suppkey % 2 = 0 THEN ' Human' ELSE 'VIRUS ' END AS prot_domain
        FROM {lineitem}""",
    "split_pairs": """
        SELECT CAST(l_partkey AS STRING) AS drug_id, CAST(l_suppkey AS STRING) AS prot_id,
               CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END AS label,
               CASE WHEN l_suppkey % 2 = 0 THEN 'human' ELSE 'virus' END AS prot_domain,
               CASE WHEN l_suppkey % 10 < 7 THEN 'train' WHEN l_suppkey % 10 < 9 THEN 'val' ELSE 'test' END AS split,
               CAST(l_partkey % 50 AS STRING) AS scaffold, CAST(l_suppkey % 20 AS STRING) AS cluster
        FROM {lineitem}""",
    "scored": """
        SELECT event_id AS row_id, CAST(user_id AS STRING) AS protein,
               CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 WHEN 'click' THEN 0 ELSE -1 END AS label,
               value AS score
        FROM {events}""",
    "predictions": """
        SELECT row_id, drug, protein, label, cls_logit, 1e0 / (1e0 + exp(-cls_logit)) AS cls_prob,
               rank_logit, 1e0 / (1e0 + exp(-rank_logit)) AS rank_prob, w
        FROM (
            SELECT event_id AS row_id, CAST(event_id AS STRING) AS drug, CAST(user_id AS STRING) AS protein,
                   CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 WHEN 'click' THEN 0 ELSE -1 END AS label,
                   value / 20e0 - 2.5e0 AS cls_logit,
                   CAST(event_id * 7919 % 1000 AS DOUBLE) / 250e0 - 2e0 AS rank_logit,
                   CAST(event_id % 11 AS DOUBLE) AS w
            FROM {events}) AS e""",
    # the same pairs as another epoch scores them
    "late_predictions": """
        SELECT row_id, drug, protein, label, cls_logit, 1e0 / (1e0 + exp(-cls_logit)) AS cls_prob,
               rank_logit, 1e0 / (1e0 + exp(-rank_logit)) AS rank_prob, w
        FROM (
            SELECT event_id AS row_id, CAST(event_id AS STRING) AS drug, CAST(user_id AS STRING) AS protein,
                   CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 WHEN 'click' THEN 0 ELSE -1 END AS label,
                   CAST(event_id * 6133 % 1000 AS DOUBLE) / 400e0 - 1e0 AS cls_logit,
                   2e0 - value / 25e0 AS rank_logit, CAST(event_id % 11 AS DOUBLE) AS w
            FROM {events}) AS e""",
    "history": """
        SELECT run, stage, CAST(row_number() OVER (PARTITION BY run, stage ORDER BY event_id) AS INT) AS epoch,
               CASE WHEN event_id % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS cls_aupr,
               CAST(event_id * 7919 % 1000 AS DOUBLE) AS combo_cls_rank
        FROM (SELECT event_id, value, user_id AS run,
                     CASE WHEN event_type IN ('purchase', 'view') THEN 'pretrain' ELSE 'cls_train' END AS stage
              FROM {events}) AS e""",
    "compounds": """
        SELECT p_partkey,
               'C' || CAST(p_partkey AS STRING) AS chembl_id,
               CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_brand END AS name,
               CASE WHEN p_partkey % 11 = 0 THEN 'Protein' WHEN p_partkey % 2 = 0 THEN 'Small molecule'
                    ELSE ' small Molecule' END AS type,
               CASE WHEN p_partkey % 6 = 0 THEN 'None' ELSE CAST(p_partkey % 5 AS STRING) END AS max_phase,
               CASE WHEN p_partkey % 37 = 0 THEN 'unknown' ELSE CAST(p_partkey % 1000 AS STRING) || '.5' END AS chembl_mw,
               CAST(p_size % 7 AS STRING) AS targets,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 13 AS STRING) END AS bioactivities,
               CAST(p_partkey % 14 - 4 AS STRING) AS chembl_alogp,
               CAST(p_partkey % 240 AS STRING) AS chembl_tpsa,
               CAST(p_size % 18 AS STRING) AS chembl_hba,
               CAST(p_size % 10 AS STRING) AS chembl_hbd,
               '0' AS chembl_ro5_violations,
               CAST(p_partkey % 23 AS STRING) AS chembl_rotb,
               CASE WHEN p_partkey % 17 = 0 THEN 'SEQ' WHEN p_partkey % 3 = 0 THEN 'mol' ELSE 'MOL' END AS structure_type,
               CASE WHEN p_partkey % 19 = 0 THEN '1' ELSE '-1' END AS inorganic_flag,
               CASE WHEN p_partkey % 9 = 0 THEN 'NaN' ELSE CAST(p_size + 6 AS STRING) END AS chembl_heavy_atoms,
               CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_name || '-' || CAST(p_size AS STRING) END AS SMILES,
               CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE 'K' || CAST(p_partkey AS STRING) END AS inchi_key,
               CASE WHEN p_partkey % 29 = 0 THEN 'True' WHEN p_partkey % 2 = 0 THEN 'False' ELSE 'N' END AS withdrawn_flag
        FROM {part}""",
    "structures": """
        SELECT p_partkey, CASE WHEN p_partkey % 41 = 0 THEN ' ' ELSE p_name END AS SMILES,
               p_partkey % 37 <> 0 AS parsed, p_partkey % 31 <> 0 AS standardized, p_partkey % 29 <> 0 AS finalized,
               CAST(1 + (CASE WHEN p_partkey % 23 = 0 THEN 1 ELSE 0 END) AS INT) AS n_components,
               CASE WHEN p_partkey % 19 = 0 THEN 'C,N,U' WHEN p_partkey % 17 = 0 THEN 'C,Zn' ELSE 'C,H,Cl' END AS element_list,
               CASE WHEN p_partkey % 13 = 0 THEN 'PAINS_A anil,Brenk thiol' WHEN p_partkey % 12 = 0 THEN 'brenk nitro'
                    ELSE 'other' END AS alert_list,
               p_retailprice - 850e0 AS MolWt, CAST(p_size + 4 AS DOUBLE) AS HeavyAtoms,
               CAST(p_size AS DOUBLE) / 5e0 - 1e0 AS LogP,
               CASE WHEN p_partkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(p_size % 10 AS DOUBLE) END AS HBD,
               CAST(p_size % 17 AS DOUBLE) AS HBA, CAST(p_size AS DOUBLE) * 4.5e0 AS TPSA,
               CAST(p_partkey % 22 AS DOUBLE) AS RotB,
               CASE WHEN p_partkey % 43 = 0 THEN '' ELSE upper(p_name) END AS SMILES_Std
        FROM {part}""",
    "sequences": """
        SELECT doc_id AS prot_id, source AS protein_key, lang,
               '>' || source || ' ' || lang || chr(10) || text || chr(10) || '  >tail' AS seq
        FROM {documents}""",
    "targets": """
        SELECT CAST(min(vec_id) AS STRING) AS prot_id, 'label::' || CAST(label AS STRING) AS protein_key,
               'P' || CAST(label AS STRING) AS pdb_id
        FROM {embeddings} GROUP BY label""",
}


class _Paths(dict):
    def __init__(self, folder: str):
        super().__init__({t: f"parquet.`{folder}/{t}.parquet`" for t in TABLES})


def table(spark: SparkSession, sf: str, name: str, spread_by: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, spread_by) if spread_by else df


def role(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.sql(ROLES[name].format_map(_Paths(sf)))


_VIEWS = {t: t for t in TABLES}
_TWINS = {**_VIEWS, **{name: f"({text.format_map(_VIEWS)})" for name, text in ROLES.items()}}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``{role}`` in its SQL twin stands for a subquery."""

    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = (fn, sql.format_map(_TWINS) if sql else None)
        return fn

    return add


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded value. The first step removes summation noise, so that exact
    halves round alike everywhere; adding 0.0 turns -0.0 into 0.0."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(F.round(col.cast("double"), 10), digits) + F.lit(0.0)


def long_vector(df: DataFrame, keys: list[str], vec: str, digits: int = 6) -> DataFrame:
    """Vectors as comparable rows."""
    return df.select(*keys, F.posexplode(vec).alias("pos", "_v")).select(
        *keys, "pos", rounded("_v", digits).alias("value"))


# SQL rounding that matches ``rounded``.
def r(expr: str, digits: int = 6) -> str:
    return f"(ROUND(ROUND(CAST({expr} AS DOUBLE), 10), {digits}) + 0.0)"
