"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in expressions only.

The sketch of a text keeps the k least distinct hashes of its shingles of five words (a shorter text is one shingle, an
empty one has none) and how many distinct shingles were seen, exactly while there are at most k. Sketches of parts merge
into the sketch of the whole; two sketches estimate resemblance and containment, one estimates the distinct count.

Null texts count as empty, and only texts of white space have an empty sketch. Two sketches without hashes have resemblance
1, one without and one with have 0. Rows that are equal in doc_id and text follow each other in any order, which changes
no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushql.llm.common import first_at, whole_text

K = 64
WORDS = 5
SPACE = float(2**64)
#: Most rows, about, that one task puts in order.
RANGE_ROWS = 20_000


def hashes(text: str, words: int = WORDS) -> str:
    """SQL: distinct shingle hashes of a text; each chains the XXH64 of its words. Letter case and space are folded.

    Words are runs of letters and digits; a text without any is read as it stands, split at white space.
    """
    parts = f"filter(if(rlike({text}, '[\\\\p{{L}}\\\\p{{N}}]'), split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), split({text}, '\\\\s+')), w -> w <> '')"
    chain = ", ".join(f"w[i + {k}]" for k in range(words))
    one = "xxhash64(array_join(w, ' '))"
    return f"flatten(transform(array({parts}), w -> if(size(w) = 0, cast(array() as array<bigint>), if(size(w) < {words}, array({one}), array_distinct(transform(sequence(0, size(w) - {words}), i -> xxhash64({chain})))))))"


def sketch(text: str, k: int = K, words: int = WORDS) -> Column:
    """Ascending array of the k least distinct shingle hashes; signed longs, so the order is that of signed numbers."""
    return F.expr(f"slice(sort_array({hashes(text, words)}), 1, {k})")


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Share of the k least hashes of both that both have."""
    union = f"slice(array_sort(array_union({a}, {b})), 1, {k})"
    both = f"size(array_intersect({union}, array_intersect({a}, {b})))"
    return F.expr(f"if(size({a}) = 0 and size({b}) = 0, 1D, if(size({a}) = 0 or size({b}) = 0, 0D, cast({both} as double) / size({union})))")


def distinct_shingles(a: str, k: int = K) -> Column:
    """Estimated distinct shingles: exact below k hashes, else from the place of the k-th hash."""
    return F.expr(f"if(size({a}) < {k}, cast(size({a}) as double), ({k} - 1) / ((element_at({a}, {k}) + 9223372036854775808D) / {SPACE:.1f}D))")


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.least(F.lit(1.0), F.when(n == 0, F.lit(1.0)).otherwise(j * (n + m) / (1 + j) / n))


def merge(sketches: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group, that of all its parts.

    Hashes become distinct before they are ranked, and a hash is ranked within parts of a group before the whole, so a
    hot group never stands in one task with all its rows.
    """
    rows = sketches.select(*by, F.explode(column).alias("h_")).distinct()
    part = Window.partitionBy(*by, F.expr("pmod(xxhash64(h_), 64)")).orderBy("h_")
    least = rows.withColumn("r_", F.row_number().over(part)).where(f"r_ <= {k}")
    whole = least.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy("h_"))).where(f"r_ <= {k}")
    made = whole.groupBy(*by).agg(F.sort_array(F.collect_list("h_")).alias(column))
    groups = sketches.select(*by).distinct()
    same = [groups[c].eqNullSafe(made[c]) for c in by]
    joined = groups.join(made, same, "left").select(*[groups[c] for c in by], F.coalesce(made[column], F.expr("cast(array() as array<bigint>)")).alias(column))
    return joined


def as_text(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, h -> lpad(lower(hex(h)), 16, '0')), '')")


def _ranges(keys: DataFrame, n: int) -> tuple[Column, int]:
    """Ascending array of bounds that deal ``keys(key)`` into ranges of some RANGE_ROWS rows or fewer, and how many ranges.

    Bounds are every eighth of a sample that the keys' hashes choose, eight for a range; a scalar subquery, so that they
    stay in Spark.
    """
    spread = 4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // min(RANGE_ROWS, max(256, n // spread))))
    sample = keys.where(F.expr(f"pmod(xxhash64(key), {max(1, n // (8 * parts))}L) = 0"))
    bounds = sample.agg(F.expr("filter(array_sort(collect_list(key)), (y, i) -> i % 8 = 7)").alias("bounds"))
    return bounds.scalar(), parts


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, key, range_ and ghost_: with each range's rows the first row of the range after it, as a ghost.

    The order is descending by doc_id, then by the text's hash, null ids last, and after the last row comes the first.
    Rows are dealt into ranges of a bounded size by that order and, among equal rows, by a number of the row, so neither
    a hot id nor equal rows stand in one task, and no task sees all rows.
    """
    n = docs.count()
    base = docs.select("doc_id", whole_text().alias("text"))
    base = base.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("r")))
    bounds, _ = _ranges(base.select("key"), n)
    base = base.withColumn("bounds_", bounds).select("doc_id", "text", "key", F.expr(first_at("bounds_", "y > key")).alias("range_"))
    first = base.groupBy("range_").agg(F.max_by("text", "key").alias("text"), F.max_by("doc_id", "key").alias("doc_id"), F.max("key").alias("key"))
    ids = first.select(F.col("range_").alias("from_"))
    order = Window.orderBy(F.desc("from_"))
    above = ids.select("from_", F.coalesce(F.lag("from_").over(order), F.min("from_").over(Window.partitionBy())).alias("to_"))
    copies = first.join(above, F.col("range_") == F.col("from_")).select("doc_id", "text", "key", F.col("to_").alias("range_"), F.lit(True).alias("ghost_"))
    return base.select("doc_id", "text", "key", "range_", F.lit(False).alias("ghost_")).union(copies)


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Sketches of every text and of its edited text, with the likenesses the query reports."""
    rows = with_next(docs).withColumn("sketch_", sketch("text", k))
    w = Window.partitionBy("range_").orderBy("ghost_", F.desc("key"))
    rows = rows.select("doc_id", "text", "sketch_", "ghost_", F.lead("text").over(w).alias("next_text"), F.lead("sketch_").over(w).alias("next_sketch")).where("not ghost_")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next_text, 1, cast(n_chars div 3 as int)))"))
    return rows.withColumn("edited_sketch", sketch("edited_", k))


def report(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and distinct shingles."""
    return edited(docs, k).select(
        "doc_id", "n_chars", F.sha2(F.col("edited_").cast("binary"), 256).alias("edited_sha256"), as_text("sketch_").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch_", "edited_sketch", k).alias("near_edited"), resemblance("sketch_", "next_sketch", k).alias("near_next"), distinct_shingles("sketch_", k).alias("shingles"),
    )
