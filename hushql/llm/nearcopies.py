"""Near copies by SimHash and overlap of word shingles: pairs of texts whose five-word shingles have Jaccard similarity
SIMILAR or more.

Every text has a SimHash fingerprint of its distinct shingles. Fingerprints within three bits meet by op8's anchor-point
covering, which loses no such pair. That radius does not reach SIMILAR: texts of similarity 0.8 differ in up to 17 of 64
bits, and no covering of 64 bits by anchors is selective that far. So pairs that are farther apart meet at bands of minima
as well: ROWS least values under as many hash functions make a key, and a text stands at BANDS keys. Two texts of
similarity s meet at a key with s ** ROWS, so a pair of similarity 0.8 misses all with (1 - 0.8 ** 6) ** 36 = 1.8e-5.

Texts that meet are first joined into candidate groups: each text by one link to the least text of a key or of its fingerprint, and
fingerprints by a spanning forest of an anchor, so that no square of pairs is made. Every group then gathers the shingles of its texts, once each, and all its pairs are counted exactly, as a
matrix product. A group of more than ROOM texts or WEIGHT shingles is dealt into blocks, and every two blocks meet in a
task of their own, so a task's memory has a bound however large a group is. What leaves a task is a spanning forest.

Equal texts are one node, named by the XXH64 of the text. Null texts count as empty; texts without words are alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushql.llm import simhash
from hushql.llm.common import cut, small_batches, whole_text
from hushql.llm.components import components

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 36, 6
#: Most texts and most shingles that a task compares at once.
ROOM, WEIGHT = 1024, 1 << 20
CHUNK = 2048
ODD = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of all shingles, ascending; a shorter text is one shingle, one without words has none."""
    digest = xxhash.xxh64_intdigest
    own = np.array([digest(w) for w in text.encode("utf-8", "replace").lower().split()], np.uint64)
    if not len(own):
        return own
    size = min(words, len(own))
    made = np.zeros(len(own) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            made = (made ^ own[k : k + len(made)]) * MIX
            made ^= made >> np.uint64(29)
    return np.unique(made)


def band_keys(hashes: np.ndarray) -> list[int]:
    """The keys at which a text with these shingles stands, as signed longs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), CHUNK):
            np.minimum(least, ((hashes[at : at + CHUNK] ^ ODD[1][:, None]) * ODD[0][:, None]).min(1), out=least)
    keys = np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64)
    return keys.view(np.int64).tolist()


def overlaps(sets: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """Matrix of how many hashes each two sets share; only hashes in two sets or more are multiplied."""
    n = len(sets)
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    column = np.cumsum(np.r_[False, every[1:] != every[:-1]]) if len(every) else np.zeros(0, int)
    shared = np.bincount(column)[column] > 1 if len(every) else np.zeros(0, bool)
    column, owner = column[shared], owner[shared]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    out, step = np.zeros((n, n), np.float32), max(1, cells // n)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        x, y = np.searchsorted(column, [start, start + step])
        has = np.zeros((n, min(step, int(column[y - 1]) - start + 1)), np.float32)
        has[owner[x:y], column[x:y] - start] = 1
        out += has @ has.T
    return out


def forest(alike: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a symmetric matrix."""
    new, out = np.ones(len(alike), bool), []
    for seed in range(len(alike)):
        if not new[seed]:
            continue
        new[seed] = False
        queue = [seed]
        while queue:
            at = queue.pop()
            found = np.flatnonzero(alike[at] & new).tolist()
            new[found] = False
            out += [(at, x) for x in found]
            queue += found
    return out


def similar(sets: list[np.ndarray], least: float = SIMILAR) -> np.ndarray:
    both, size = overlaps(sets), np.array([len(s) for s in sets], np.float32)
    return both >= least * (size[:, None] + size[None, :] - both) - 1e-4


def _compared(batches):
    """Rows (room, node, set) in order of room, to the links (a, b) of a forest for each room."""

    def links(nodes: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
        return [(nodes[x], nodes[y]) for x, y in forest(similar([np.frombuffer(s, np.uint64) for s in sets]))]

    room, nodes, sets = None, [], []
    for batch in batches:
        out = []
        for at, node, made in zip(batch["room"].tolist(), batch["node"].tolist(), batch["made"]):
            if at != room:
                out += links(nodes, sets) if len(nodes) > 1 else []
                room, nodes, sets = at, [], []
            nodes.append(node)
            sets.append(made)
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    if len(nodes) > 1:
        yield pd.DataFrame(links(nodes, sets), columns=["a", "b"], dtype="int64")


def node() -> Column:
    return F.xxhash64(whole_text())


def print_of(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of these shingles, as a signed long."""
    blocks = (hashes[at : at + CHUNK] for at in range(0, len(hashes), CHUNK))
    return int(np.uint64(simhash.majority(blocks)).view(np.int64))


def anchored(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join the nodes of ``rows(node, fp)`` whose fingerprints are within simhash.BITS bits."""
    prints = rows.groupBy("fp").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    equal = rows.join(prints.where("hub < last"), "fp").where("node > hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    near = cut(simhash.linked(prints.select("fp")))
    one, two = prints.select(F.col("fp").alias("a"), F.col("hub").alias("one")), prints.select(F.col("fp").alias("b"), F.col("hub").alias("two"))
    return equal.union(near.join(one, "a").join(two, "b").select("one", "two"))


def candidates(docs: DataFrame) -> DataFrame:
    """node, root (the least node of its candidate group) and size (its shingles) of every text that meets another."""

    @F.pandas_udf("keys array<long>, fp long, size long")
    def stand(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            rows.append((band_keys(own := shingles(t)), print_of(own), len(own)))
        return pd.DataFrame(rows, columns=["keys", "fp", "size"])

    # Equal texts have equal keys, so any of them will do, and each task hands on one.
    rows = docs.select(node().alias("node"), stand(whole_text()).alias("s")).groupBy("node").agg(F.any_value("s").alias("s"))
    rows = cut(rows.select("node", "s.*"))
    at = rows.select("node", F.explode("keys").alias("key"))
    hubs = at.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    links = at.join(hubs, "key").where("node > hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    roots = components(links.union(anchored(rows.select("node", "fp")))).withColumnRenamed("node", "member")
    return cut(roots.join(rows, F.col("member") == F.col("node")).select("node", "root", "size"))


def linked(docs: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that join all similar texts that meet."""

    @F.pandas_udf("binary")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)

    small_batches(docs)
    met = candidates(docs)
    groups = met.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    blocks = F.when((F.col("n") <= ROOM) & (F.col("weight") <= WEIGHT), F.lit(1)).otherwise(F.greatest(F.ceil(2 * F.col("n") / ROOM), F.ceil(2 * F.col("weight") / WEIGHT)).cast("int"))
    met = met.join(groups.select("root", blocks.alias("m")), "root").select("node", "root", "m")
    # Copies become one within each task before they travel; the join then finds them dealt out by node already.
    texts = docs.select(node().alias("node"), whole_text().alias("text")).groupBy("node").agg(F.any_value("text").alias("text")).join(met.select("node"), "node", "left_semi")
    own = F.expr("cast(pmod(xxhash64(node, 1), m) as int)")
    rooms = F.expr("if(m = 1, array(root), transform(sequence(0, m - 1), j -> xxhash64(root, least(c, j), greatest(c, j))))")
    rows = met.join(texts.select("node", made("text").alias("made")), "node").withColumn("c", own).select("node", F.explode(rooms).alias("room"), "made")
    return rows.repartition("room").sortWithinPartitions("room").mapInPandas(_compared, "a long, b long")


def dedup(docs: DataFrame) -> DataFrame:
    """node, low (its least doc_id) and root (the node that names its component) for every distinct text of ``docs``."""
    least = cut(docs.groupBy(node().alias("node")).agg(F.min("doc_id").alias("low")))
    roots = components(linked(docs)).withColumnRenamed("node", "member")
    return cut(least.join(roots, least["node"] == roots["member"], "left").select("node", "low", F.coalesce("root", "node").alias("root")))
