"""Bounded samples of labelled rows, and the shared folder."""

import pytest
from pyspark.sql import functions as F

from hushql.llm import common, langid


def test_a_hot_key_stays_within_the_bound(spark):
    docs = spark.range(60_000).select(F.when(F.col("id") < 50_000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    docs = docs.union(docs.limit(1000)).union(spark.createDataFrame([(7, "same", "en")] * 3000, "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(7, 1), (7, 0)] + [(i, i % 2) for i in range(50_000, 60_000)], "doc_id long, quality int")
    rows = common.labelled(docs, labels, "quality", F.lit(True), 300)
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    assert sizes[0] == 300 and 200 <= sizes[1] <= 300
    assert rows.distinct().count() == rows.count()
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, common.labelled(docs.repartition(7), labels, "quality", F.lit(True), 300).collect()))
    few = common.bounded_sample(docs.select("doc_id", "lang"), "lang", 100, "doc_id")
    assert 0 < few.count() <= 100


def test_many_languages_all_stay(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_ROWS", 900)
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('l', id % 700) as lang", "concat('word', id % 700, ' and more') as text")
    assert len(langid.learn(docs, 5).languages) == 700


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, other: other)})

    with pytest.raises(RuntimeError):
        common.shared_folder(Session())
