"""The TPC-H-like tables and their labels."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from hushql.labels import Catalog

PERSONAL = {"customer": ["c_custkey"], "orders": ["o_custkey"], "lineitem": ["l_suppkey", "l_partkey"], "supplier": ["s_suppkey"], "events": ["user_id"]}
PUBLIC = ["region", "nation", "part"]


def load(spark: SparkSession, sf_dir: str, sql: str | None = None) -> Catalog:
    """Register the tables as views and label them; given a statement, those that it names."""
    catalog = Catalog(spark)
    names = [name for name in [*PERSONAL, *PUBLIC] if sql is None or re.search(rf"\b{name}\b", sql, re.IGNORECASE)]
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        if name in PERSONAL:
            catalog.mark_personal(name, *PERSONAL[name])
        else:
            catalog.mark_public(name)
    return catalog
