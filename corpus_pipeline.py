"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

1. toxicity: documents whose score is at or above the threshold go.
2. near_dedup: one document of each group of near-duplicates (5-word shingles, Jaccard 0.75) stays.
3. secrets: secret spans are replaced by a mark; no document goes.
4. mix: documents are taken 0 to 3 times so that sources meet their target weights.
5. pack: documents are cut and packed into sequences; one row per piece.

All stages but the last return the columns of `documents`; other columns of the input go. A null text is an empty one
to every stage and stays null; repeated rows and rows without doc_id are documents, of which near_dedup keeps one of
each group; an empty table gives no rows. SQL cannot express the classifier, so there is no
ORACLE_SQL; tests hold the pipeline against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import minhash, mixing, packing, secrets, toxicity
from tesserae.llm._ship import ship
from tesserae.llm._store import cleared, remove, stored, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Dropped doc_ids up to which they are broadcast (8 bytes each); beyond it the join is shuffled.
MOST_BROADCAST = 4_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return toxicity.keep_clean(docs.select(*COLUMNS), toxicity.fit(docs, labels, held_out))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: of the smallest doc_id, and of rows that share it the one with the least text.

    Rows without a doc_id go by a number made of their text, above all usual ids, so they are grouped like others and
    a row with an id is preferred to them.
    """
    ship(spark)
    stand_in = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    named = docs.select(*COLUMNS, F.coalesce(F.col("doc_id"), stand_in).alias("_id"))
    found = stored(minhash.near_duplicates(named.select(F.col("_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("_id"), "kept"), "pipeline-groups")
    gone = found.where("NOT kept").select("_id").distinct()
    few = gone.count() <= MOST_BROADCAST
    left = named.join(F.broadcast(gone) if few else gone, "_id", "left_anti")
    again = stored(found.where("kept").groupBy("_id").count().where("count > 1").select("_id"), "pipeline-again")
    if again.isEmpty():
        return left.select(*COLUMNS)
    several = left.join(again, "_id").withColumn("_at", F.row_number().over(Window.partitionBy("_id").orderBy("text", "source", "lang", "n_chars")))
    return left.join(again, "_id", "left_anti").select(*COLUMNS).union(several.where("_at = 1").select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_samples(spark, docs))
    clean = secrets.redact(secrets.scan_secrets(docs.select(*COLUMNS), model))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_copies(mixing.mix_sources(docs.select(*COLUMNS))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result lies in the shared folder before the next stage reads it.

    What a stage has written on the way, and its input, is deleted once its result is there; the last result stays.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with cleared(spark) as kept:
            docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.add(path)
        if before:
            remove(spark, before)
        before = path
    return docs
