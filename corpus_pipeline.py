"""From raw documents to token ids: language ID, near-duplicates, benchmark leaks, secrets, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``docs``. No row is rejected for a null: a text that is null or has no letter is of no language and goes at the
first stage; rows without doc_id can't be named by a group of copies, so they stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushql.llm import bpe, decontam, langid, nearcopies, secrets
from hushql.llm.common import shared_folder, table, whole_text


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised with the calibrated score asked for."""
    model = langid.learn(docs)
    return docs.where(~langid.identified(whole_text(), model)["rejected"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: that of its least doc_id, then of its least text hash.

    Near copies meet by SimHash fingerprints at anchors or by bands of minima, and have five-word shingles of similarity 0.8.
    """
    kept = nearcopies.dedup(docs).where("low is not null").groupBy("root").agg(F.min(F.struct("low", "node")).alias("one")).select("one.*")
    # The columns of docs travel as one, so none of them can clash.
    rows = docs.select(F.col("doc_id").alias("id"), nearcopies.node().alias("own"), F.struct(*docs.columns).alias("doc"))
    one = rows.join(kept, (rows["id"] == kept["low"]) & (rows["own"] == kept["node"]), "left_semi").dropDuplicates(["id", "own"])
    return one.union(rows.where("id is null")).select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents into which no benchmark item leaks."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with secrets masked in their texts."""
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids (little-endian unsigned 32-bit integers), their number and digests."""
    return bpe.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("byte_bpe", encode),
]

#: Fitted models and token ids are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
