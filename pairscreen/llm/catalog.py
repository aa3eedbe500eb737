"""Registered queries of this package, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscreen.llm import embeddings, language, minhash, quality, spotsigs, suffix_tree
from pairscreen.llm.divergence import divergences
from pairscreen.llm.exact import exact_duplicates
from pairscreen.llm.mixing import decide, plan_mix
from pairscreen.llm.packing import pack
from pairscreen.llm.phrases import collocations
from pairscreen.llm.token_counts import count_tokens
from pairscreen.llm.urls import judge, url_host_path

REGISTRY: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Weights of sources in turn, and the mix's words as a share of all.
MIX_WEIGHTS, MIX_SHARE = (3, 1, 2), 1.5

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with the digest of their ids."""
    return pack(docs, word_tokenizer()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Documents: the ``lang`` column is the declaration, the source the host."""
    return language.identify(table(spark, sf, "documents"), "doc_id")


@query("language_id_pages")
def language_id_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages: text without markup, the language of the html tag, and the host."""
    pages = table(spark, sf, "pages")
    text = F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1)
    read = pages.select("page_id", text.alias("text"), declared.alias("declared"), url_host_path(F.col("url"))[0].alias("host"))
    return language.identify(read, "page_id", declared_col="declared", host_col="host")


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    rows, plan = plan_mix(table(spark, sf, "documents"), MIX_WEIGHTS, MIX_SHARE)
    return decide(rows, plan).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
        (F.col("copies") * F.col("_size")).alias("taken"), F.col("_source").alias("source"), "copies")


@query("op3_quality")
def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op4_url_filter", """
    WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
                 FROM pages),
    split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
    parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split),
    ruled AS (SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM parts)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled""")
def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


@query("op5_packing")
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"))


@query("op6_embeddings")
def op6_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op7_minhash")
def op7_minhash(spark: SparkSession, sf: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf, "documents"), k=2, percent=80)
    return minhash.mark(found).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "kept")


@query("op8_suffix_tree")
def op8_suffix_tree(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return suffix_tree.score(table(spark, sf, "documents"), held_out)


@query("op9_spotsigs")
def op9_spotsigs(spark: SparkSession, sf: str) -> DataFrame:
    return spotsigs.compare_with_next(table(spark, sf, "documents"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"), word_tokenizer()).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query("op11_exact_dedup", """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
           sha256(text) AS text_sha256 FROM t WINDOW same AS (PARTITION BY text)""")
def op11_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact_duplicates(table(spark, sf, "documents"), carried={"text_sha256": digest})


@query("op12_phrases", r"""
    WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    pieces AS (SELECT doc, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS part
               FROM (SELECT doc, lang, regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+') AS p FROM d)),
    words AS (SELECT doc, lang, part, unnest(w) AS word, generate_subscripts(w, 1) AS pos
              FROM (SELECT doc, lang, part, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)),
    totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
    runs AS (SELECT lang, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS ahead
             FROM words WINDOW o AS (PARTITION BY doc, part ORDER BY pos)),
    grams AS (SELECT lang, ahead[1:size] AS gram, size, count(*) AS f FROM runs, range(1, 6) s(size) WHERE ahead[size] IS NOT NULL
              GROUP BY ALL HAVING count(*) >= 100),
    parts AS (SELECT lang, gram, size, f AS a, k, gram[1:k] AS one, gram[k + 1:] AS two FROM grams, range(1, 5) c(k) WHERE k < size),
    cuts AS (SELECT p.lang, p.gram, p.size, a, k, x.f AS l, y.f AS r, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
             FROM parts p JOIN totals USING (lang) JOIN grams x ON x.lang = p.lang AND x.gram = one
             JOIN grams y ON y.lang = p.lang AND y.gram = two),
    best AS (SELECT lang, gram, size, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
    inner_ AS (SELECT lang, part, max(f) AS f FROM (
                   SELECT lang, gram[1:size - 1] AS part, f FROM grams WHERE size > 2
                   UNION ALL SELECT lang, gram[2:], f FROM grams WHERE size > 2) GROUP BY lang, part),
    named AS (SELECT b.lang, array_to_string(gram, ' ') AS phrase, a, l, r, n, score
              FROM best b JOIN totals USING (lang) LEFT JOIN inner_ i ON i.lang = b.lang AND i.part = b.gram
              WHERE i.f IS NULL OR i.f < a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
    FROM named QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""")
def op12_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"))


@query("op13_divergence", r"""
    WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    words AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
    langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    sources AS (SELECT DISTINCT lang, source FROM d),
    own AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    totals AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
    cells AS (SELECT s.lang, s.source, k.term, coalesce(o.n, 0) AS n,
                     1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p,
                     1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
              FROM sources s JOIN kept k USING (lang) JOIN langs l USING (lang)
              LEFT JOIN own o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term
              LEFT JOIN totals t ON t.lang = s.lang AND t.source = s.source),
    apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
              FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
              FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM cells WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
               FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""")
def op13_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergences(table(spark, sf, "documents")).select(
        "lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
