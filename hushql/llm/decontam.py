"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are read as lower-case words. Shared seeds of five words find the items worth tiling;
running Karp-Rabin then marks the longest matches that overlap no earlier one, again and again. An item leaks where
tiles cover at least 80 % of it, in whatever order its parts stand, or where one tile has LONG words. An item of fewer than
five words has itself as its seed and leaks where it stands as a whole.

Null and empty texts leak nothing. Equal items and equal documents are each reported. Text lengths have no limit. A
benchmark of at most BLOCK_BYTES, which is measured, goes to every worker as an index of its seeds. A larger one is never
gathered: seeds of documents and of items are joined, pairs that share too few seeds for the cover go, and each pair left
is tiled in a row of its own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushql.llm.common import cut, small_batches, whole_text

SEED_WORDS = 5
COVERED = 0.8
LONG = 50
#: UTF-8 bytes of benchmark text up to which all of it goes to the workers.
BLOCK_BYTES = 8 << 20
#: Characters of documents whose words are in memory at once.
CHARS = 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"\w+").findall
LEAKS = "array<struct<item_id:bigint,covered:double,matched:int,tiles:array<struct<item_start:int,start:int,words:int>>>>"


def words(text: str | None) -> list[str]:
    return WORD((text or "").lower())


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        return -1


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n ids."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * BASE + ids[k : k + len(out)].astype(np.uint64)
    return out


def _scan(a: np.ndarray, b: np.ndarray, open_a: np.ndarray, open_b: np.ndarray, n: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The longest open match, and all open matches of n words or more that can't be begun earlier; stops at one of over 2n."""

    def windows(ids: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        closed = np.r_[0, np.cumsum(~free)]
        at = np.flatnonzero(closed[n:] == closed[:-n]) if len(ids) >= n else np.zeros(0, int)
        return at, rolling(ids, n)[at]

    table = defaultdict(list)
    for i, h in zip(*map(np.ndarray.tolist, windows(a, open_a))):
        table[h].append(i)
    longest, found = 0, []
    at, hashes = windows(b, open_b)
    known = np.isin(hashes, np.fromiter(table, np.uint64, len(table)))
    for j, h in zip(at[known].tolist(), hashes[known].tolist()):
        for i in table[h]:
            if i and j and open_a[i - 1] and open_b[j - 1] and a[i - 1] == b[j - 1]:
                continue
            k = 0
            while i + k < len(a) and j + k < len(b) and open_a[i + k] and open_b[j + k] and a[i + k] == b[j + k]:
                k += 1
            if k > 2 * n:
                return k, []
            if k >= n:
                found.append((k, i, j))
                longest = max(longest, k)
    return longest, found


def tile(a: np.ndarray, b: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Tiles (start in a, start in b, words) by running Karp-Rabin greedy string tiling; ids below 0 match nothing."""
    open_a, open_b = a >= 0, b >= 0
    tiles, n = [], max(least, 20)
    while True:
        longest, found = _scan(a, b, open_a, open_b, n)
        if longest > 2 * n:
            n = longest
            continue
        queue = sorted(found, key=lambda m: (-m[0], m[1], m[2]))
        while queue:
            k, i, j = queue.pop(0)
            free = open_a[i : i + k] & open_b[j : j + k]
            if free.all():
                tiles.append((i, j, k))
                open_a[i : i + k] = open_b[j : j + k] = False
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, free, False]))
            rest = [(int(y - x), i + int(x), j + int(x)) for x, y in zip(edges[::2], edges[1::2]) if y - x >= n]
            if rest:
                queue = sorted(queue + rest, key=lambda m: (-m[0], m[1], m[2]))
        if n > 2 * least:
            n //= 2
        elif n > least:
            n = least
        else:
            return sorted(tiles)


class Index:
    """Seeds of benchmark items that are held in memory."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = _Ids()
        self.items = []
        for item, text in items:
            if got := words(text):
                self.items.append((item, np.array([dict.setdefault(self.ids, w, len(self.ids)) for w in got], np.int64)))
        #: For each seed length the sorted hashes and their items.
        self.seeds: dict[int, tuple[np.ndarray, list[int]]] = {}
        for n in sorted({min(SEED_WORDS, len(ids)) for _, ids in self.items}):
            pairs = sorted((h, k) for k, (_, ids) in enumerate(self.items) if min(SEED_WORDS, len(ids)) == n for h in set(rolling(ids, n).tolist()))
            self.seeds[n] = np.array([h for h, _ in pairs], np.uint64), [k for _, k in pairs]

    def leaks(self, texts: list[str]) -> list[list[tuple]]:
        """For each text its tiled items with their cover."""
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.seeds:
            return out
        ids, begin = [], [0]
        for text in texts:
            ids += map(self.ids.__getitem__, words(text))
            ids.append(-1)
            begin.append(len(ids))
        ids = np.array(ids, np.int64)
        unknown = np.r_[0, np.cumsum(ids < 0)]
        for n, (known, owner) in self.seeds.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            hashes = np.zeros(len(at), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    hashes = hashes * BASE + ids[at + k].astype(np.uint64)
            first, last = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
            hit = first < last
            at, first, last = at[hit], first[hit], last[hit]
            text_of = np.searchsorted(begin, at, "right") - 1
            for doc in np.unique(text_of).tolist():
                mine = text_of == doc
                seeds = defaultdict(list)
                for j, x, y in zip(at[mine].tolist(), first[mine].tolist(), last[mine].tolist()):
                    for k in owner[x:y]:
                        seeds[k].append(j)
                for k, starts in seeds.items():
                    item, pattern = self.items[k]
                    out[doc].append((item, *cover(pattern, ids, np.array(starts), begin[doc])))
        return out


def cover(pattern: np.ndarray, ids: np.ndarray, starts: np.ndarray, begin: int = 0) -> tuple[float, int, list[tuple[int, int, int]]]:
    """Share and number of an item's words that tiles cover, and the tiles (start in the item, in the text, words).

    ``starts`` are the places of shared seeds: nothing but what they cover can be in a match of that many words.
    """
    n = min(SEED_WORDS, len(pattern))
    covered = np.unique((starts[:, None] + np.arange(n)).ravel())
    gap = np.flatnonzero(np.diff(covered) > 1) + 1
    places = np.insert(covered, gap, -1)
    tiles = tile(pattern, np.where(places < 0, -1, ids[places]), n)
    matched = sum(n for _, _, n in tiles)
    return matched / len(pattern), matched, [(i, int(places[j]) - begin, n) for i, j, n in tiles]


def leaked(share: float, tiles: list[tuple[int, int, int]], covered: float) -> bool:
    return share >= covered or any(n >= LONG for _, _, n in tiles)


def content_seeds(text: str, sizes: list[int]) -> dict[int, int]:
    """Hashes of a text's seeds of these sizes by their content, as signed longs, and how often each stands there."""
    own = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words(text)], np.uint64)
    out: dict[int, int] = {}
    for n in sizes:
        if len(own) >= n:
            found, times = np.unique(rolling(own, n) * np.uint64(2 * n + 1), return_counts=True)
            out |= zip(found.view(np.int64).tolist(), times.tolist())
    return out


def tiled(item: str, text: str) -> tuple[float, int, list[tuple[int, int, int]]]:
    """Cover of one item by one text."""
    ids: dict[str, int] = {}
    pattern = np.array([ids.setdefault(w, len(ids)) for w in words(item)], np.int64)
    there = np.array([ids.get(w, -1) for w in words(text)], np.int64)
    n = min(SEED_WORDS, len(pattern))
    starts = np.flatnonzero(np.isin(rolling(there, n), rolling(pattern, n))) if len(there) >= n else np.zeros(0, int)
    return cover(pattern, there, starts) if len(starts) else (0.0, 0, [])


def _leak(item_id, share: float, matched: int, tiles: list) -> dict:
    return {"item_id": item_id, "covered": share, "matched": matched, "tiles": [{"item_start": i, "start": j, "words": n} for i, j, n in tiles]}


def _chunks(texts: pd.Series):
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size >= CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


def leaks(text: Column, items: list[tuple[int, str]], covered: float = COVERED) -> Column:
    """Array of the items that leak into a text, for a benchmark that is held in memory."""

    @F.pandas_udf(LEAKS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(items)
        for texts in batches:
            rows = []
            for some in _chunks(texts):
                for found in index.leaks(some):
                    rows.append([_leak(*f) for f in sorted(found, key=lambda f: (f[0] is None, f[0])) if leaked(f[1], f[3], covered)])
            yield pd.Series(rows, dtype=object)

    # An explode of the array brings a filter on it with it; Spark would find the leaks once more for that.
    return run.asNondeterministic()(text)


def joined_leaks(texts: DataFrame, items: DataFrame, covered: float = COVERED) -> DataFrame:
    """text_hash and leaks of texts(text_hash, text) by a join of seeds with those of items(item_id, text)."""

    @F.pandas_udf("long")
    def size(column: pd.Series) -> pd.Series:
        return pd.Series([len(words(t)) for t in column], dtype="int64")

    def seeds(sizes: list[int]):
        @F.pandas_udf("array<struct<seed:long,times:int>>")
        def run(column: pd.Series) -> pd.Series:
            return pd.Series([[{"seed": h, "times": n} for h, n in content_seeds(t, sizes).items()] for t in column], dtype=object)

        return run

    @F.pandas_udf("covered double, matched int, tiles array<struct<item_start:int,start:int,words:int>>")
    def run(item: pd.Series, text: pd.Series) -> pd.DataFrame:
        made = [_leak(None, *tiled(i, t)) for i, t in zip(item, text)]
        return pd.DataFrame([{k: m[k] for k in ("covered", "matched", "tiles")} for m in made], columns=["covered", "matched", "tiles"])

    items = cut(items.select("item_id", whole_text().alias("item")).withColumn("item_hash", F.xxhash64("item")).withColumn("m", size("item")).where("m > 0"))
    kinds = items.groupBy("item_hash").agg(F.any_value("item").alias("item"), F.max("m").alias("m"))
    sizes = [r.n for r in kinds.select(F.least("m", F.lit(SEED_WORDS)).alias("n")).distinct().orderBy("n").collect()]
    of = {n: seeds([n]) for n in sizes}
    own = reduce(DataFrame.union, [kinds.where(F.least("m", F.lit(SEED_WORDS)) == n).select("item_hash", "m", F.explode(of[n]("item")).alias("s")) for n in sizes]) if sizes else None
    if own is None:
        return texts.select("text_hash", F.lit(None).cast(LEAKS).alias("leaks")).limit(0)
    own = own.select("item_hash", "m", F.col("s.seed").alias("seed"), F.col("s.times").alias("times"))
    there = texts.select("text_hash", F.explode(seeds(sizes)("text")).alias("s")).select("text_hash", F.col("s.seed").alias("seed"))
    # Tiles of five words or more that cover the share asked for hold a seed for each five words of it at least.
    least = F.least(F.ceil(F.col("m") * covered / SEED_WORDS), F.lit(LONG - SEED_WORDS + 1))
    pairs = there.join(own, "seed").groupBy("text_hash", "item_hash").agg(F.sum("times").alias("shared"), F.max("m").alias("m")).where(F.col("shared") >= least)
    rows = pairs.select("text_hash", "item_hash").join(kinds.select("item_hash", "item"), "item_hash").join(texts, "text_hash")
    made = rows.select("text_hash", "item_hash", run("item", "text").alias("made"))
    made = made.where((F.col("made.covered") >= covered) | F.exists("made.tiles", lambda t: t["words"] >= LONG)).join(items.select("item_id", "item_hash"), "item_hash")
    one = F.struct(F.col("item_id").isNull().alias("none"), "item_id", F.col("made.covered").alias("covered"), F.col("made.matched").alias("matched"), F.col("made.tiles").alias("tiles"))
    return made.groupBy("text_hash").agg(F.array_sort(F.collect_list(one)).alias("a")).select("text_hash", F.transform("a", lambda x: F.struct(x["item_id"], x["covered"], x["matched"], x["tiles"])).cast(LEAKS).alias("leaks"))


def leaking(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """doc (all columns of ``docs``) and leaks, an array of what leaks into each row's whole text."""
    small_batches(docs)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), whole_text().alias("text"))
    benchmark = benchmark.select("item_id", "text").where(F.length("text") > 0)
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if total <= BLOCK_BYTES:
        items = [(i, t) for i, t in benchmark.collect()]
        return rows.select("doc", leaks(F.col("text"), items, covered).alias("leaks"))
    rows = rows.select("doc", "text", F.xxhash64("text").alias("own_hash"))
    texts = cut(rows.groupBy(F.col("own_hash").alias("text_hash")).agg(F.any_value("text").alias("text")))
    found = joined_leaks(texts, benchmark, covered)
    return rows.join(found, F.col("own_hash") == F.col("text_hash"), "left").select("doc", F.coalesce("leaks", F.expr(f"cast(array() as {LEAKS})")).alias("leaks"))


def report(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """doc_id, item_id, covered, matched words and tiles: one row for each item that leaks into a document."""
    found = leaking(docs.select("doc_id", "text"), benchmark, covered)
    return found.select("doc.doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def clean(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """The rows of ``docs`` into which no item leaks."""
    return leaking(docs, benchmark, covered).where(F.size("leaks") == 0).select("doc.*")
