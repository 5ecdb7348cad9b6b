"""Sharding by a k-d tree over row metadata, in built-in expressions only.

A node with room for several shards is split along its widest dimension at the weighted quantile that shares its bytes
by the shards of its two sides (the median where those are equal); all nodes of a level are measured together. Each
dimension is a 24-bit grid between the least and the largest value: doc_id, logarithm of the size, and language and source
in the order of their first three bytes. Ties on a dimension go by a 24-bit hash of a row number that the checkpoint of
the metadata fixes, so also rows that are equal in everything are cut wherever the bytes ask for it. A cut is found by
reading the 48-bit key twelve bits at a time, so the driver gets at most 4096 sums for each node of a level.

Null texts have no bytes and checksum 0; null ids, languages and sources stand at the low end. Repeated rows are rows of
their own. An empty table has no shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushql.llm.common import cut

GRID = 24
DIGIT = 12
DIMENSIONS = ("d_id", "d_size", "d_lang", "d_source")
#: Rows that one task numbers.
NUMBERED = 50_000


@dataclass
class Node:
    shards: int
    first: int
    dimension: str = ""
    bar: int = 0
    low: Node | None = None
    high: Node | None = None


def _grid(column: Column, low, high) -> Column:
    width = F.greatest(F.lit(high).cast("double") - F.lit(low).cast("double"), F.lit(1e-9))
    at = F.floor((column.cast("double") - F.lit(low).cast("double")) / width * ((1 << GRID) - 1))
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit((1 << GRID) - 1), at)), F.lit(0)).cast("long")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, row (a number of its own), tie and the dimensions; a lacking lang or source counts as null."""
    head = lambda c: F.expr(f"cast(conv(rpad(substring(hex(encode(cast({c} as string), 'utf-8')), 1, 6), 6, '0'), 16, 10) as bigint)")
    named = lambda c: head(c) if c in docs.columns else F.lit(None).cast("bigint")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), named("lang").alias("lang_"), named("source").alias("source_"))
    ends = rows.agg(F.max("size").alias("size"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("doc_id", "lang_", "source_") for f in (F.min, F.max)]).first()
    scaled = lambda c: _grid(F.col(c), ends[f"min_{c}"] or 0, ends[f"max_{c}"] or 0)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return rows.select(
        "doc_id", "size", "text_crc32", "row", F.expr(f"shiftrightunsigned(xxhash64(row), {64 - GRID})").alias("tie"),
        scaled("doc_id").alias("d_id"), _grid(F.log2(F.col("size")), 3.0, float((ends["size"] or 8).bit_length())).alias("d_size"), scaled("lang_").alias("d_lang"), scaled("source_").alias("d_source"),
    )


def _key(dimension: str) -> Column:
    return F.shiftleft(F.col(dimension), GRID).bitwiseOR(F.col("tie"))


def placed(node: Node, leaf) -> Column:
    """``leaf`` of the node that a row falls in, as one nested condition."""
    if node.low is None:
        return leaf(node)
    return F.when(_key(node.dimension) < node.bar, placed(node.low, leaf)).otherwise(placed(node.high, leaf))


def _cuts(rows: DataFrame, weight: str, nodes: list[Node], root: Node) -> dict[int, tuple[str, int]]:
    """For each node to split its widest dimension and the least key of the high side."""
    at = {id(n): i for i, n in enumerate(nodes)}
    mine = rows.withColumn("node", placed(root, lambda n: F.lit(at.get(id(n), -1)))).where("node >= 0")
    spans = mine.groupBy("node").agg(F.sum(weight).alias("all"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()
    if not spans:
        return {}
    widest = {r.node: max(DIMENSIONS, key=lambda d: (r[d], -DIMENSIONS.index(d))) for r in spans}
    goal = {r.node: r.all * (nodes[r.node].shards // 2) / nodes[r.node].shards for r in spans}
    prefix, passed = dict.fromkeys(goal, 0), dict.fromkeys(goal, 0)
    key = F.coalesce(*[F.when(F.col("node") == n, _key(d)) for n, d in widest.items()])
    for shift in range(2 * GRID - DIGIT, -1, -DIGIT):
        high = shift + DIGIT
        open_ = F.coalesce(*[F.when(F.col("node") == n, F.lit(p)) for n, p in prefix.items()])
        sums = mine.withColumn("k_", key).where(F.shiftright("k_", high) == open_).groupBy("node", F.shiftright("k_", shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).agg(F.sum(weight).alias("w")).collect()
        by: dict[int, list] = {n: [] for n in goal}
        for r in sums:
            by[r.node].append((r.digit, r.w))
        for n, got in by.items():
            last = 0
            for digit, w in sorted(got):
                last = digit
                if passed[n] + w >= goal[n]:
                    # At the last digits the cut goes to the nearer side of the key that crosses the goal.
                    if shift == 0 and passed[n] + w - goal[n] < goal[n] - passed[n]:
                        last, passed[n] = digit + 1, passed[n] + w
                    break
                passed[n] += w
            prefix[n] = (prefix[n] << DIGIT) + last
    return {n: (widest[n], prefix[n]) for n in goal}


def tree(rows: DataFrame, shards: int, weight: str = "size") -> Node:
    root = Node(shards, 0)
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        found = _cuts(rows, weight, level, root)
        below = []
        for i, node in enumerate(level):
            dimension, bar = found.get(i, (DIMENSIONS[0], 0))
            half = node.shards // 2
            low, high = Node(half, node.first), Node(node.shards - half, node.first + half)
            below.append((node, dimension, bar, low, high))
        for node, dimension, bar, low, high in below:
            node.dimension, node.bar, node.low, node.high = dimension, bar, low, high
        level = [x for b in below for x in b[3:]]
    return root


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """Slots without gaps from 0 in each shard. Parts of a shard are numbered apart, then moved by what stands before."""
    n = rows.count()
    parts = max(1, -(-n // (shards * NUMBERED)))
    rows = rows.withColumn("part_", F.expr(f"pmod(xxhash64(row, 1), {parts}L)"))
    sizes = rows.groupBy("shard", "part_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("shard").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", "part_", before.alias("start_"))
    own = Window.partitionBy("shard", "part_").orderBy("row")
    return rows.withColumn("own_", F.row_number().over(own)).join(starts, ["shard", "part_"]).withColumn("slot", F.col("start_") + F.col("own_") - 1)


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard; shards of nearly equal bytes.

    Give the number of shards, or the bytes that a leaf should reach.
    """
    rows = cut(metadata(docs))
    if shards is None:
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        shards = max(1, -(-total // target_bytes))
    root = tree(rows, shards)
    made = numbered(rows.withColumn("shard", placed(root, lambda n: F.lit(n.first))), shards)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
