"""SimHash fingerprints linked by anchor-point covering.

A pair within three bits differs in at most one bit of the first or of the second 31 bits. Each of the two parts is
covered by the perfect Hamming code of length 31: every part lies within one bit (the covering radius) of exactly one
code word, its home anchor. Each fingerprint is replicated to every anchor within radius plus threshold, that is
within two bits; a pair with at most one differing bit in the part meets at the home anchor of either. So only
fingerprints at one anchor are compared, and on all 64 bits. (One covering code for all 64 bits would need about ten
thousand replicas a fingerprint for three bits.)

Null and empty texts have fingerprint zero and are linked like any other. Equal rows, ties and null ids are allowed:
links run between distinct fingerprints, and a group's id is its least id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushql.llm.common import cut, small_batches, whole_text
from hushql.llm.components import components

WORDS = 3
BITS = 3
SEED = 42
#: An anchor with more fingerprints is dealt out by parts of the other bits, then by pairs of blocks.
CROWDED = 4096
BLOCK = 2048


def majority(blocks: Iterable[np.ndarray]) -> int:
    """Bits set in over half of all unsigned 64-bit hashes; zero for none."""
    n, counts = 0, np.zeros(64, np.int64)
    for hashes in blocks:
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str, words: int = WORDS) -> int:
    """Majority bits of the XXH64 of all shingles of a text, repeats included."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    blocks = ([parts[at + k : at + k + min(n - at, 65536)] for k in range(min(words, len(parts)))] for at in range(0, n, 65536))
    return majority(np.array([digest(b" ".join(s), SEED) for s in zip(*some)], dtype="<u8") for some in blocks)


def simhash(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or "", words) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text)


def _anchors(part: int) -> str:
    """SQL: anchors of a fingerprint for one part as an array of struct(key, home)."""
    value = f"(shiftrightunsigned(fp, {31 * part}) & 2147483647L)"
    masks = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]
    syndrome = " | ".join(f"shiftleft(bit_count({value} & {m}L) & 1, {k})" for k, m in enumerate(masks))
    tag = f"{part << 31}L"
    near = f"transform(filter(sequence(1, 31), i -> (i ^ s) > i), i -> named_struct('key', ({value} ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1)) | {tag}, 'home', false))"
    home = f"named_struct('key', if(s = 0, {value}, {value} ^ shiftleft(1L, s - 1)) | {tag}, 'home', true)"
    return f"flatten(transform(array(cast({syndrome} as int)), s -> if(s = 0, array({home}), concat(array({home}), {near}))))"


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def spanning(homes: np.ndarray, others: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a forest that spans what ``homes`` and ``others`` link within ``bits``; all arrays of unsigned longs."""
    nodes = np.unique(np.concatenate([homes, others]))
    parent = np.arange(len(nodes))
    right = np.searchsorted(nodes, others)
    out = []
    for value in np.unique(homes):
        at = int(np.searchsorted(nodes, value))
        for j in right[np.bitwise_count(others ^ value) <= bits]:
            a, b = _find(parent, at), _find(parent, int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(nodes[at]), int(nodes[j])))
    return out


def _compare(bits: int):
    """Rows (key, fp, home) in order of key, to links. Small groups of a batch are compared at once."""

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        key, fp, home = frame["key"].to_numpy(), frame["fp"].to_numpy().view(np.uint64), frame["home"].to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        rows = np.flatnonzero(home & (size <= 64))
        left = np.repeat(rows, size[rows])
        ends = np.cumsum(size[rows])
        right = np.repeat(start[rows], size[rows]) + np.arange(len(left)) - np.repeat(ends - size[rows], size[rows])
        close = (fp[left] != fp[right]) & (np.bitwise_count(fp[left] ^ fp[right]) <= bits)
        a, b = [fp[left[close]]], [fp[right[close]]]
        for s, n in zip(starts[sizes > 64], sizes[sizes > 64]):
            group, at_home = fp[s : s + n], home[s : s + n]
            pairs = np.array(spanning(group[at_home], group, bits), dtype=np.uint64).reshape(-1, 2)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    def run(batches):
        rest = None
        for batch in batches:
            if rest is not None and len(rest):
                batch = pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            key = batch["key"].to_numpy()
            before = np.flatnonzero(key != key[-1])
            whole = int(before[-1]) + 1 if len(before) else 0
            if whole:
                yield links(batch.iloc[:whole].reset_index(drop=True))
            rest = batch.iloc[whole:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield links(rest)

    return run


def _split(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows at keys of at most ``most`` rows, and the others with their number; sizes are counted where the rows are made."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return rows.join(sizes, "key", "left_anti"), rows.join(sizes, "key")


def _meeting(rows: DataFrame) -> DataFrame:
    """Rows of keys at which a fingerprint at home meets another; ``rows`` has no large key."""
    w = Window.partitionBy("key")
    return rows.select("*", F.count("*").over(w).alias("m"), F.max("home").over(w).alias("at_home")).where("m > 1 and at_home")


def _met(rows: DataFrame, bits: int) -> DataFrame:
    return rows.select("key", "fp", "home").sortWithinPartitions("key").mapInPandas(_compare(bits), "a long, b long")


def linked(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``prints(fp)`` that join all within ``bits`` <= 3 bits.

    Anchors with more than CROWDED fingerprints are dealt out by the value of each quarter of the other bits (a pair
    within three bits agrees in one), and what is crowded still by pairs of blocks; no pair is lost or emitted twice
    over as a square: groups yield the links of a spanning forest.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two parts cover thresholds up to three bits")
    # A small table of fingerprints may stand in a task or two; its anchors are some thirty times as many.
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = prints.select("fp", F.explode(F.expr(f"concat({_anchors(0)}, {_anchors(1)})")).alias("at")).select("fp", "at.*")
    few, many = _split(rows, CROWDED)
    found = _met(_meeting(few), bits)
    other = "if(key < 2147483648L, shiftrightunsigned(fp, 31), (fp & 2147483647L) | shiftleft(shiftrightunsigned(fp, 62), 31))"
    quarter = f"transform(sequence(0, 3), j -> xxhash64(key, j, shiftrightunsigned({other}, j * 8) & if(j = 3, 511L, 255L)))"
    few, many = _split(many.select("fp", "home", F.explode(F.expr(quarter)).alias("key")), CROWDED)
    found = found.union(_met(_meeting(few), bits))
    blocks = F.expr(f"cast(ceil(n / {BLOCK}) as int)")
    crowded = many.select("fp", "home", "key", blocks.alias("m")).withColumn("c", F.expr("cast(pmod(xxhash64(fp), m) as int)"))
    pairs = crowded.select("fp", "home", F.explode(F.expr("transform(sequence(0, m - 1), j -> xxhash64(key, least(c, j), greatest(c, j)))")).alias("key"))
    return found.union(_met(_meeting(pairs), bits)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def dedup(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fp long, fingerprint (16 hex digits), component_id of every row of ``docs``."""
    small_batches(docs)
    prints = cut(docs.select("doc_id", simhash(whole_text(), words).alias("fp")))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(linked(least.select("fp"), bits))
    # Checkpoints between the joins: each then stands on plain shuffles, of which Spark can split a hot fingerprint's or component's.
    member = cut(least.join(roots, least["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    ids = cut(member.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    own = cut(member.join(ids, "root", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")))
    return prints.join(own, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
