"""The queries opN_<name> over the driver's tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import embeddings, fingerprints, lm, minhash, mixing, packing, secrets, suffix, tokens, toxicity
from tesserae.llm._ship import ship

#: The public tokenizer that op5 counts with.
TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    machine = toxicity.fit(docs, labels.select("doc_id", "toxic"), held_out)
    return toxicity.score_documents(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_substrings(table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets.train(secrets.labelled_samples(spark, docs))
    scanned = secrets.scan_secrets(docs.select("doc_id", "text"), model)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_lm_scores": op4_lm_scores,
    "op5_token_counts": op5_token_counts,
    "op6_secret_scans": op6_secret_scans,
    "op7_source_mix": op7_source_mix,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_minhash": op10_minhash,
}

_COMPONENTS = """
reach AS (
    SELECT a AS node, a AS seen FROM (SELECT a FROM links UNION SELECT b FROM links)
    UNION
    SELECT r.node, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON l.a = r.seen
),
labels AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": f"""
WITH RECURSIVE unit AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings
),
links AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM unit p JOIN unit q ON p.vec_id < q.vec_id AND p.n > 0 AND q.n > 0
    WHERE list_dot_product(p.v, q.v) / (p.n * q.n) >= 0.95
),
{_COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id OR b = vec_id) AS n_links,
    coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN labels ON node = vec_id""",
    "op7_source_mix": r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
),
sources AS (
    SELECT source, sum(size)::BIGINT AS total, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM sized GROUP BY source
),
fill AS (
    SELECT 0 AS step, CAST(-1 AS DOUBLE) AS rate
    UNION ALL
    SELECT step + 1, (SELECT (sum(total) - coalesce(sum(3 * total) FILTER (3.0 * total / w < f.rate), 0)) / sum(w) FILTER (3.0 * total / w >= f.rate) FROM sources)
    FROM fill f WHERE step < 200
),
goal AS (
    SELECT source, total, CASE WHEN 3.0 * total / w >= r THEN w * r ELSE 3.0 * total END AS target
    FROM sources, (SELECT rate AS r FROM fill WHERE step = 200)
),
queued AS (
    SELECT s.*, g.total, g.target, sum(size) OVER (PARTITION BY s.source ORDER BY substr(digest, 1, 13), size ROWS UNBOUNDED PRECEDING) AS cum
    FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
),
turns AS (SELECT *, CASE WHEN target > 0 THEN (e * total + cum)::DOUBLE / target ELSE 0 END AS finish FROM queued, (VALUES (0), (1), (2)) AS x(e)),
cut AS (
    SELECT max(finish) AS last FROM (SELECT finish, sum(size) OVER (ORDER BY finish) AS run FROM turns)
    WHERE run <= (SELECT sum(size) FROM sized)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, total AS source_size, CAST(max(target) AS DOUBLE) AS target,
    CAST(coalesce(sum(size) FILTER (finish <= last), 0) AS BIGINT) AS taken
FROM turns, cut GROUP BY doc_id, size, total""",
    "op10_minhash": rf"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, hash(w[i : i + 4]) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY 1, 2)
    JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN labels ON node = d.doc_id""",
}
