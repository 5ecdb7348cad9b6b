"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows with a text that go to a Python worker at once.
BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that all machines share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, Spark on one machine (local mode, as in tests) takes a temporary folder; a cluster has no place
    that its executors share, so there it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small_batches(df: DataFrame) -> None:
    """Texts go to Python workers BATCH at a time, unless the session asks for another number than Spark's own.

    Spark's 10,000 rows are made for numbers: of texts they take hundreds of MB in the executor, in the worker and between.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; a null key counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(rows: DataFrame, group: str, most: Column | int, *key: str) -> DataFrame:
    """At most ``most`` rows of each group, one for each value of ``key``, chosen by a hash of the key.

    A first bar on the hash, from the group's number of rows, leaves about twice as many and twenty; repeated keys then become one
    and the least hashes stay. The choice depends on values alone, so a lost task makes it again, and its bound holds
    however often a key repeats. Rows of one key are taken to be equal.
    """
    kept, most = rows.columns, F.lit(most) if isinstance(most, int) else most
    sizes = rows.groupBy(F.col(group).alias("group_")).agg(F.count("*").alias("n_"))
    # One row a group, as the caller's model has them; without the broadcast all rows, with their texts, would move to be joined.
    rows = rows.withColumn("hash_", F.xxhash64(*key, F.lit(42))).join(F.broadcast(sizes), F.col(group).eqNullSafe(F.col("group_")))
    rows = rows.where(F.expr("shiftrightunsigned(hash_, 11)") / float(1 << 53) < (2 * most + 20) / F.col("n_")).dropDuplicates([group, "hash_", *key])
    order = Window.partitionBy(group).orderBy("hash_", *key)
    return rows.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= most).select(*kept)


def labelled(documents: DataFrame, labels: DataFrame, label: str, learn_from: Column, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` labelled rows a class.

    Keys are chosen first, from the labels alone: they have that bound, so they are broadcast and the texts are filtered
    where they are read. A key of several rows gives each of its texts, within the same bound. A key with several labels
    counts with the largest.
    """
    rows = labels.where(learn_from & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    ids = bounded_sample(rows, "y", per_class, "doc_id")
    texts = documents.select("doc_id", whole_text().alias("text"), F.xxhash64(whole_text()).alias("text_hash")).join(F.broadcast(ids), "doc_id")
    return bounded_sample(texts, "y", per_class, "doc_id", "text_hash").select("doc_id", "text", "y")


def first_at(array: str, holds: str) -> str:
    """SQL: place, from 1, of the first element ``y`` of a sorted array for which ``holds``, as all after it do; by halving."""
    half = f"element_at(transform(array(cast((b.lo + b.hi) div 2 as int)), h -> if(element_at(transform(array(element_at({array}, h)), y -> {holds}), 1), named_struct('lo', b.lo, 'hi', h), named_struct('lo', h + 1, 'hi', b.hi))), 1)"
    return f"if(size({array}) = 0, 1, aggregate(sequence(1, cast(ceil(log2(size({array}) + 1)) as int)), named_struct('lo', 1, 'hi', size({array}) + 1), (b, round_) -> if(b.lo >= b.hi, b, {half}), b -> b.lo))"
