"""Pair hygiene, lookups, set operations, split audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, r, role, rounded, table
from pairscreen.functions.text import drug_name, infer_domain, norm_keys, normalize_id, protein_name
from pairscreen.operators import audit, joins, ordering, pairs
from pairscreen.session import scratch_path
from pairscreen.sources import scans, sinks

# -- scans ------------------------------------------------------------------------


@query("scan_pairs", "SELECT drug_id, prot_id, CAST(label AS STRING) AS label, prot_domain FROM {pairs} AS p")
def scan_pairs(spark, sf):
    path = sinks.write_table(role(spark, sf, "pairs"), scratch_path(spark, "pairs"), "csv")
    return scans.scan_pairs(spark, path)


@query("scan_projected", "SELECT l_partkey, l_suppkey FROM lineitem")
def scan_projected(spark, sf):
    return scans.scan_projected(spark, f"{sf}/lineitem.parquet", ["l_partkey", "l_suppkey"])


# -- identifiers ---------------------------------------------------------------------

@query("normalize_id", "SELECT DISTINCT raw, regexp_replace(trim(raw), '\\.0$', '') AS id "
                       "FROM (SELECT drug_id AS raw FROM {messy_pairs} AS p)")
def normalized_ids(spark, sf):
    raw = role(spark, sf, "messy_pairs").select(F.col("drug_id").alias("raw")).distinct()
    return raw.withColumn("id", normalize_id(F.col("raw")))


_KEYS = """
    SELECT raw, key, CAST(row_number() OVER (PARTITION BY raw ORDER BY o) - 1 AS INTEGER) AS priority FROM (
        SELECT raw, trim(raw) AS key, 0 AS o FROM v WHERE trim(raw) <> '' AND lower(trim(raw)) <> 'nan'
        UNION ALL
        SELECT raw, CAST(TRY_CAST(TRY_CAST(trim(raw) AS DOUBLE) AS BIGINT) AS STRING), 1 FROM v
        WHERE TRY_CAST(trim(raw) AS DOUBLE) = trunc(TRY_CAST(trim(raw) AS DOUBLE))
          AND TRY_CAST(TRY_CAST(trim(raw) AS DOUBLE) AS BIGINT) IS NOT NULL
          AND CAST(TRY_CAST(TRY_CAST(trim(raw) AS DOUBLE) AS BIGINT) AS STRING) <> trim(raw))"""


@query("norm_keys", "WITH v AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN '00' || CAST(p_partkey AS STRING) "
                    "WHEN 1 THEN CAST(p_partkey AS STRING) || '.0' WHEN 2 THEN CAST(p_partkey AS STRING) || 'e2' "
                    "WHEN 3 THEN p_name ELSE 'NaN' END AS raw FROM part)" + _KEYS)
def lookup_keys(spark, sf):
    key = F.col("p_partkey").cast("string")
    raw = (F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("00"), key))
           .when(F.col("p_partkey") % 5 == 1, F.concat(key, F.lit(".0")))
           .when(F.col("p_partkey") % 5 == 2, F.concat(key, F.lit("e2")))
           .when(F.col("p_partkey") % 5 == 3, F.col("p_name")).otherwise("NaN"))
    values = table(spark, sf, "part").select(raw.alias("raw")).distinct()
    return values.select("raw", F.posexplode(norm_keys(F.col("raw"))).alias("priority", "key"))


@query("entity_names", """
    SELECT p_partkey, COALESCE(CASE WHEN p_size > 25 THEN p_brand END, CAST(p_partkey AS STRING)) AS drug,
           COALESCE(CASE WHEN p_size > 40 THEN p_type END, 'unknown_protein') AS protein FROM part""")
def entity_names(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("drug_key"),
        F.col("p_partkey").alias("drug_id"), F.when(F.col("p_size") > 40, F.col("p_type")).alias("UniProt_ID"))
    return df.select("p_partkey", drug_name(df).alias("drug"), protein_name(df).alias("protein"))


@query("infer_domain", "SELECT prot_domain, CAST(count(*) AS BIGINT) AS n, CAST(CASE WHEN lower(prot_domain) "
                       "LIKE '%virus%' THEN 1 ELSE 0 END AS INTEGER) AS domain FROM {messy_pairs} AS p GROUP BY ALL")
def inferred_domain(spark, sf):
    df = role(spark, sf, "messy_pairs")
    return df.groupBy("prot_domain", infer_domain(df).alias("domain")).agg(F.count("*").alias("n"))


# -- hygiene -----------------------------------------------------------------------------

_EVIDENCE = """
    SELECT drug_id, prot_id, prot_domain, count(*) AS n_rows, count(*) FILTER (label = 1) AS n_pos,
           count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = -1) AS n_gray
    FROM {pairs} AS p GROUP BY ALL"""


@query("clean_pairs", f"""
    SELECT drug_id, prot_id, CAST(CASE WHEN n_pos > 0 THEN 1 WHEN n_neg > 0 THEN 0 ELSE -1 END AS INTEGER) AS label,
           prot_domain FROM ({_EVIDENCE})
    WHERE NOT (n_pos > 0 AND n_neg > 0) AND NOT (n_gray > 0 AND n_pos + n_neg > 0)""")
def clean(spark, sf):
    return pairs.clean_pairs(role(spark, sf, "messy_pairs"), on_mixture="drop").drop("row_id")


@query("clean_pairs_carry", f"""
    SELECT drug_id, prot_id, label, drug_id || '/' || prot_id || '/' || CAST(label AS STRING) AS tag FROM (
        SELECT drug_id, prot_id, CASE WHEN n_pos > 0 THEN 1 WHEN n_neg > 0 THEN 0 ELSE -1 END AS label
        FROM ({_EVIDENCE}) WHERE NOT (n_pos > 0 AND n_neg > 0) AND NOT (n_gray > 0 AND n_pos + n_neg > 0))""")
def clean_carrying(spark, sf):
    """Another column of the surviving row, without a row id."""
    df = role(spark, sf, "pairs").withColumn("tag", F.concat_ws("/", "drug_id", "prot_id", F.col("label").cast("string")))
    return pairs.clean_pairs(df, on_mixture="drop", carry=["tag"]).select("drug_id", "prot_id", "label", "tag")


@query("clean_pairs_keep_hard", f"""
    SELECT drug_id, prot_id, CAST(CASE WHEN n_pos > 0 THEN 1 WHEN n_neg > 0 THEN 0 ELSE -1 END AS INTEGER) AS label,
           prot_domain FROM ({_EVIDENCE}) WHERE NOT (n_pos > 0 AND n_neg > 0)""")
def clean_keep_hard(spark, sf):
    return pairs.clean_pairs(role(spark, sf, "pairs"), on_mixture="keep_hard").drop("row_id")


@query("clean_pairs_stats", """
    WITH p AS {pairs}, e AS (
        SELECT drug_id, prot_id, count(*) AS n, count(DISTINCT label) AS k,
               bool_or(label = 1) AND bool_or(label = 0) AS conflict,
               bool_or(label = -1) AND (bool_or(label = 1) <> bool_or(label = 0)) AS mixture
        FROM p GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS input_rows, count(*) FILTER (conflict) AS conflicting_pairs_removed,
           CAST(sum(n) FILTER (conflict) AS BIGINT) AS conflicting_rows_removed,
           CAST(sum(n - k) FILTER (NOT conflict) AS BIGINT) AS duplicate_rows_removed,
           CAST(sum(k) FILTER (mixture) AS BIGINT) AS mixture_rows_removed,
           CAST(sum(k) FILTER (NOT conflict AND NOT mixture) AS BIGINT) AS output_rows FROM e""")
def clean_stats(spark, sf):
    return pairs.clean_pairs_stats(role(spark, sf, "pairs"))


@query("conflict_exclusion", """
    WITH p AS {pairs} SELECT drug_id, prot_id, CAST(label AS INTEGER) AS label, prot_domain FROM p
    WHERE (drug_id, prot_id) NOT IN (
        SELECT (drug_id, prot_id) FROM p WHERE label IN (0, 1) GROUP BY drug_id, prot_id
        HAVING count(DISTINCT label) > 1)""")
def without_conflicts(spark, sf):
    return pairs.conflict_exclusion(role(spark, sf, "pairs")).drop("row_id")


@query("validate_pairs", """
    WITH p AS (SELECT CASE WHEN l_linenumber = 1 THEN ' ' ELSE CAST(l_partkey AS STRING) END AS drug_id,
                      CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_suppkey AS STRING) END AS prot_id,
                      l_linenumber - 3 AS label, l_returnflag AS prot_domain FROM lineitem)
    SELECT count(*) FILTER (trim(drug_id) = '') AS empty_drug_id, count(*) FILTER (prot_id IS NULL) AS empty_prot_id,
           count(*) FILTER (label NOT IN (-1, 0, 1)) AS bad_label, count(*) AS bad_domain FROM p""")
def violations(spark, sf):
    n = F.col("l_linenumber")
    return pairs.pair_violations(table(spark, sf, "lineitem").select(
        F.when(n == 1, " ").otherwise(F.col("l_partkey").cast("string")).alias("drug_id"),
        F.when(n != 2, F.col("l_suppkey").cast("string")).alias("prot_id"),
        (n - 3).alias("label"), F.col("l_returnflag").alias("prot_domain")))


@query("label_filter", "SELECT drug_id, prot_id, CAST(label AS INTEGER) AS label FROM {pairs} AS p WHERE label IN (0, 1)")
def binary_rows(spark, sf):
    return pairs.label_filter(role(spark, sf, "messy_pairs"), "binary").select(
        normalize_id(F.col("drug_id")).alias("drug_id"), normalize_id(F.col("prot_id")).alias("prot_id"), "label")


@query("domain_filter", "SELECT drug_id, prot_id, CAST(label AS INTEGER) AS label FROM {pairs} AS p "
                        "WHERE prot_domain = 'virus'")
def virus_rows(spark, sf):
    return pairs.domain_filter(role(spark, sf, "pairs"), "virus").drop("prot_domain")


@query("definitive_pairs", "SELECT row_id, protein, CAST(label AS INTEGER) AS label FROM {scored} AS s WHERE label >= 0")
def definitive(spark, sf):
    return pairs.definitive_pairs(role(spark, sf, "scored")).drop("score")


@query("stage_datasets", """
    WITH p AS {pairs} SELECT s.stage, prot_domain, CAST(label AS INTEGER) AS label, count(*) AS n
    FROM p JOIN (VALUES ('pretrain', 'human', -1), ('cls_train', 'virus', -1), ('rank_train', 'virus', 0),
                        ('val', 'virus', 0), ('test', 'virus', 0)) AS s(stage, domain, low)
      ON prot_domain = s.domain AND label >= s.low GROUP BY ALL""")
def stages(spark, sf):
    df = role(spark, sf, "pairs")
    out = None
    for name in pairs.STAGES:
        part = pairs.stage_dataset(df, name).groupBy("prot_domain", "label").agg(F.count("*").alias("n"))
        part = part.withColumn("stage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("pos_weight", f"SELECT {r('count(*) FILTER (label = 0) / count(*) FILTER (label = 1)')} AS pos_weight "
                     "FROM {scored} AS s")
def weight(spark, sf):
    return pairs.pos_weight(role(spark, sf, "scored")).select(rounded("pos_weight").alias("pos_weight"))


@query("valid_groups", """
    SELECT protein, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM {scored} AS s
    GROUP BY protein HAVING n_pos > 0 AND n_neg > 0""")
def two_class_groups(spark, sf):
    return pairs.valid_groups(role(spark, sf, "scored"), "protein")


# -- lookups against a bank ------------------------------------------------------------------
# The bank of compounds answers to a number, a brand or a name; brands and
# names repeat, so alias precedence matters.

_BANK = """bank AS (
    SELECT p_partkey AS idx, p_partkey, p_brand, p_name FROM part),
  flat AS (
    SELECT idx, 0 AS c, CAST(p_partkey AS STRING) AS alias FROM bank UNION ALL
    SELECT idx, 1, p_brand FROM bank UNION ALL SELECT idx, 2, p_name FROM bank),
  alias AS (SELECT alias, CAST(arg_min(idx, c * 1000000000 + idx) AS BIGINT) AS idx FROM flat GROUP BY alias)"""


def _alias_index(spark, sf):
    bank = table(spark, sf, "part").withColumn("idx", F.col("p_partkey"))
    return joins.alias_index(bank, ["p_partkey", "p_brand", "p_name"])


def _named_rows(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
        .alias("drug_id"),
        F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Brand#"), (F.col("o_custkey") % 40).cast("string")))
        .otherwise("red bolt").alias("drug_key"))


@query("alias_lookup", f"""
    WITH {_BANK}, o AS (
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS STRING) END AS a,
               CASE WHEN o_orderkey % 3 = 1 THEN 'Brand#' || CAST(o_custkey % 40 AS STRING) ELSE 'red bolt' END AS b
        FROM orders)
    SELECT o_orderkey, COALESCE(x.idx, y.idx) AS idx FROM o
    LEFT JOIN alias AS x ON x.alias = a LEFT JOIN alias AS y ON y.alias = b""")
def looked_up(spark, sf):
    found = joins.alias_lookup(_named_rows(spark, sf), ["drug_id", "drug_key"], _alias_index(spark, sf), "idx")
    return found.select("o_orderkey", "idx")


def _attached(spark, sf):
    bank = scans.scan_bank(table(spark, sf, "embeddings"), ["vec_id"])
    index = scans.bank_index(bank)
    return joins.attach_features(pairs.label_filter(role(spark, sf, "pairs")), index, index)


@query("attach_features", """
    WITH p AS {pairs}, b AS (SELECT CAST(vec_id AS STRING) AS id FROM embeddings),
    j AS (SELECT d.id AS d, t.id AS t FROM p LEFT JOIN b AS d ON d.id = drug_id LEFT JOIN b AS t ON t.id = prot_id
          WHERE label IN (0, 1))
    SELECT count(*) FILTER (d IS NULL) AS missing_ecfp, count(*) FILTER (t IS NULL) AS missing_prot,
           count(*) FILTER (d IS NULL OR t IS NULL) AS missing_any FROM j""")
def attached_misses(spark, sf):
    return joins.missing_counts(_attached(spark, sf))


@query("attach_features_matched", """
    WITH p AS {pairs}, b AS (
        SELECT CAST(vec_id AS STRING) AS id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings)
    SELECT drug_id, prot_id, CAST(label AS INTEGER) AS label, CAST(d.idx AS BIGINT) AS drug_idx,
           CAST(t.idx AS BIGINT) AS prot_idx
    FROM p JOIN b AS d ON d.id = drug_id JOIN b AS t ON t.id = prot_id WHERE label IN (0, 1)""")
def attached_rows(spark, sf):
    return joins.matched(_attached(spark, sf)).drop("prot_domain")


@query("dataset_summary", f"""
    WITH p AS {{pairs}}, s AS (SELECT * FROM p WHERE label IN (0, 1)),
    f AS (SELECT s.* FROM s SEMI JOIN (SELECT CAST(vec_id AS STRING) AS drug_id FROM embeddings) USING (drug_id)
          WHERE prot_id IN (SELECT CAST(vec_id AS STRING) FROM embeddings))
    SELECT (SELECT count(*) FROM p) AS raw_rows, (SELECT count(*) FROM s) AS selected_rows, count(*) AS final_rows,
           count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg, count(*) FILTER (label = -1) AS gray,
           {r("count(*) FILTER (label = 1) / count(*)")} AS pos_rate_01, count(DISTINCT prot_id) AS n_proteins FROM f""")
def summary(spark, sf):
    raw = role(spark, sf, "pairs")
    out = pairs.dataset_summary(raw, pairs.label_filter(raw), joins.matched(_attached(spark, sf)))
    return out.withColumn("pos_rate_01", rounded("pos_rate_01"))


@query("group_ids", """
    SELECT row_id, protein, CAST(dense_rank() OVER (ORDER BY first) - 1 AS BIGINT) AS group_id
    FROM (SELECT row_id, protein, min(row_id) OVER (PARTITION BY protein) AS first FROM {scored} AS s)""")
def numbered_groups(spark, sf):
    return ordering.group_ids(role(spark, sf, "scored"), "protein", "row_id").select("row_id", "protein", "group_id")


@query("dedup_keep_first", """
    SELECT protein, CAST(label AS INTEGER) AS label, min(row_id) AS row_id FROM {scored} AS s GROUP BY protein, label""")
def deduplicated(spark, sf):
    return joins.keep_first(role(spark, sf, "scored"), ["protein", "label"], "row_id").drop("score")


# -- ids and set operations --------------------------------------------------------------------

@query("require_ids", "SELECT count(DISTINCT l_partkey) AS missing FROM lineitem "
                      "WHERE l_partkey NOT IN (SELECT vec_id FROM embeddings)")
def required(spark, sf):
    have = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    need = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return joins.missing_ids(need, have, "id").agg(F.count("*").alias("missing"))


@query("missing_ids", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT vec_id FROM embeddings)")
def absent(spark, sf):
    have = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return joins.missing_ids(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")), have, "id")


@query("assert_same_ids", """
    WITH a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer),
         b AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey % 7, c_custkey) - 1 AS pos FROM customer)
    SELECT COALESCE(a.id, b.id) AS id, CAST(a.pos AS BIGINT) AS pos_a, CAST(b.pos AS BIGINT) AS pos_b
    FROM a FULL JOIN b ON a.id = b.id WHERE a.pos IS DISTINCT FROM b.pos""")
def id_differences(spark, sf):
    key = F.col("c_custkey")
    a = table(spark, sf, "customer").select(key.alias("id"), key.alias("o"))
    b = table(spark, sf, "customer").select(key.alias("id"), (key % 7 * 1_000_000_000 + key).alias("o"))
    return joins.id_order_differences(a, b, "id", "o")


@query("union_training_ids", """
    SELECT DISTINCT drug_id FROM {split_pairs} AS s WHERE split IN ('train', 'val')""")
def training_ids(spark, sf):
    df = role(spark, sf, "split_pairs")
    return joins.union_ids(df.filter("split = 'train'"), df.filter("split = 'val'"), key="drug_id")


@query("limit_distinct", """
    SELECT drug_id, prot_id FROM {pairs} AS p WHERE drug_id IN (
        SELECT DISTINCT drug_id FROM {pairs} AS q ORDER BY drug_id LIMIT 25)""")
def first_keys(spark, sf):
    return ordering.limit_distinct(role(spark, sf, "pairs"), "drug_id", 25).select("drug_id", "prot_id")


@query("assign_dense_ids", """
    SELECT c_name, CAST(row_number() OVER (ORDER BY c_name) - 1 AS BIGINT) AS id FROM customer""")
def dense_ids(spark, sf):
    return ordering.assign_dense_ids(table(spark, sf, "customer").select("c_name"), "c_name", "id")


@query("incremental_build", """
    SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def todo(spark, sf):
    done = scratch_path(spark, "done")
    sinks.append_outputs(table(spark, sf, "labels").select("doc_id"), done)
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return joins.incremental_todo(docs, spark.read.parquet(done), "doc_id")


# -- split audits ---------------------------------------------------------------------------------

@query("split_stats", """
    WITH p AS {split_pairs}, c AS (
        SELECT split, drug_id, prot_id FROM p WHERE label IN (0, 1) GROUP BY ALL HAVING count(DISTINCT label) > 1)
    SELECT split, count(*) AS rows,
           count(*) - count(DISTINCT (drug_id, prot_id, label, prot_domain)) AS exact_duplicate_rows,
           (SELECT count(*) FROM c WHERE c.split = p.split) AS conflicting_pairs,
           count(*) FILTER (label = -1) AS label_gray, count(*) FILTER (label = 0) AS label_neg,
           count(*) FILTER (label = 1) AS label_pos, count(DISTINCT drug_id) AS unique_drugs,
           count(DISTINCT prot_id) AS unique_proteins FROM p GROUP BY split""")
def stats_by_split(spark, sf):
    return audit.split_stats(role(spark, sf, "split_pairs"))


@query("split_overlap", """
    WITH p AS {split_pairs}, v AS (
        SELECT DISTINCT 'pairs' AS axis, drug_id || '/' || prot_id AS value, split FROM p UNION
        SELECT 'drugs', drug_id, split FROM p UNION SELECT 'proteins', prot_id, split FROM p UNION
        SELECT 'scaffolds', scaffold, split FROM p UNION SELECT 'clusters', cluster, split FROM p),
    s AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) AS t(a, b))
    SELECT x.axis, s.a AS split_a, s.b AS split_b, CAST(count(y.value) AS BIGINT) AS shared
    FROM s JOIN (SELECT DISTINCT axis FROM v) AS x ON TRUE
    LEFT JOIN (SELECT l.axis, l.value, l.split AS a, m.split AS b FROM v AS l JOIN v AS m
               ON l.axis = m.axis AND l.value = m.value) AS y ON y.axis = x.axis AND y.a = s.a AND y.b = s.b
    GROUP BY ALL""")
def overlaps(spark, sf):
    return audit.split_overlap(role(spark, sf, "split_pairs"), ["train", "val", "test"])


@query("split_overlap_messy", """
    WITH p AS {split_pairs}, v AS (
        SELECT DISTINCT 'pairs' AS axis, drug_id || '/' || prot_id AS value, split FROM p UNION
        SELECT 'drugs', drug_id, split FROM p UNION SELECT 'proteins', prot_id, split FROM p),
    s AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) AS t(a, b))
    SELECT x.axis, s.a AS split_a, s.b AS split_b, CAST(count(y.value) AS BIGINT) AS shared
    FROM s JOIN (SELECT DISTINCT axis FROM v) AS x ON TRUE
    LEFT JOIN (SELECT l.axis, l.value, l.split AS a, m.split AS b FROM v AS l JOIN v AS m
               ON l.axis = m.axis AND l.value = m.value) AS y ON y.axis = x.axis AND y.a = s.a AND y.b = s.b
    GROUP BY ALL""")
def messy_overlaps(spark, sf):
    """Ids spelled another way in each split are still the same ids."""
    spelled = F.when(F.col("split") == "train", F.concat("drug_id", F.lit(".0"))).when(
        F.col("split") == "val", F.concat(F.lit(" "), "drug_id")).otherwise(F.col("drug_id"))
    df = role(spark, sf, "split_pairs").withColumn("drug_id", spelled)
    return audit.split_overlap(df, ["train", "val", "test"], ["pairs", "drugs", "proteins"])


@query("holdout_leakage", """
    WITH p AS {split_pairs}
    SELECT 'train' AS split, 'scaffolds' AS axis, count(DISTINCT scaffold) AS heldout_in_training FROM p
    WHERE split = 'train' AND scaffold IN (SELECT scaffold FROM p WHERE split <> 'train')
    UNION ALL
    SELECT 'train', 'clusters', count(DISTINCT cluster) FROM p
    WHERE split = 'train' AND cluster IN (SELECT cluster FROM p WHERE split <> 'train')""")
def leakage(spark, sf):
    return audit.holdout_leakage(role(spark, sf, "split_pairs"), ["val", "test"], ["train"])


@query("precision_coverage", f"""
    WITH g AS (SELECT protein, count(*) AS n, count(*) FILTER (label = 1) AS pos FROM {{scored}} AS s
               WHERE label >= 0 GROUP BY protein)
    SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (n >= k) AS eligible_proteins,
           {r("avg(pos / n) FILTER (n >= k)")} AS positive_prevalence
    FROM g JOIN (VALUES (10), (50)) AS t(k) ON TRUE GROUP BY k""")
def coverage(spark, sf):
    out = audit.precision_coverage(role(spark, sf, "scored"), "protein")
    return out.withColumn("positive_prevalence", rounded("positive_prevalence"))
