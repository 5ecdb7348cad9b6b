"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are all words, their first four and their first seven letters, hashed to 64 bits. A term weighs the square of its
frequency times its inverse document frequency, and a text's norm is that of the whole text. Terms in more than STOP of
the texts are stop words and weigh nothing; terms that no example has count as seen in none. Examples stand in an inverted
index whose blocks of BLOCK examples know each term's largest weight: a search scores blocks from the highest bound down
and stops when the next bound can't reach the k-th best, so its neighbours are exact. Votes weighted by distance are
calibrated on learning rows kept out of the index.

Null and empty texts, and texts without any term of an example, get the learned rate of such texts. With no labelled rows
every score is 0.5. Learning takes a bounded, documented sample (PER_CLASS rows a class), in which each class counts as often as it
is labelled; all rows are scored, whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushql.llm.common import crc_fold, labelled, small_batches, whole_text

FOLDS, HELD = 3, 1
PER_CLASS = 1500
STOP = 0.05
NEIGHBOURS = 15
BLOCK = 256
#: Blocks that a search scores before it looks at the bounds again.
AT_FIRST = 2
PRIOR = 0.2
TOXIC_FROM = 0.7
WORD = re.compile(r"\w+").findall
EVIDENCE = 3
#: Lengths of the beginnings that are terms beside the whole word (0).
KINDS = (0, 4, 7)
#: Distinct words whose terms a worker keeps; beyond it they are forgotten and found again.
CACHE = 200_000


class _Terms(dict):
    """Hashes of the terms of a word, found on first use."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE:
            self.clear()
        digest = xxhash.xxh64_intdigest
        out = self[word] = tuple(digest(word[:kind] if kind else word, kind) for kind in KINDS if len(word) > kind)
        return out


def counted(text: str, of: _Terms) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's terms, ascending, and how often each occurs."""
    words = Counter(WORD(text.lower()))
    hashes, times = [], []
    for word, n in words.items():
        got = of[word]
        hashes += got
        times += [n] * len(got)
    terms, place = np.unique(np.array(hashes, np.uint64), return_inverse=True)
    return terms, np.bincount(place, times, len(terms))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Inverted index with block maxima over unit vectors (terms, weights), terms as numbers below ``n_terms``."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        # Examples of one heaviest term stand together, so that a block's bounds are near its own weights.
        heaviest = [(int(t[w.argmax()]) if len(t) else -1) for t, w in rows]
        self.order = np.array(sorted(range(len(rows)), key=lambda i: (heaviest[i], i)), np.int64)
        self.n = len(rows)
        self.blocks = -(-self.n // BLOCK)
        sizes = [len(rows[i][0]) for i in self.order]
        term = np.concatenate([rows[i][0] for i in self.order]) if self.n else np.zeros(0, np.int64)
        weight = np.concatenate([rows[i][1] for i in self.order]) if self.n else np.zeros(0)
        place = np.repeat(np.arange(self.n), sizes)
        by = np.lexsort((place, term))
        term, self.place, self.weight = term[by], place[by].astype(np.int32), weight[by].astype(np.float32)
        pair = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (self.place[1:] // BLOCK != self.place[:-1] // BLOCK)]) if len(term) else np.zeros(0, np.int64)
        #: One for each term and block: its block, largest weight and postings.
        self.block, self.start = (self.place[pair] // BLOCK).astype(np.int32), pair.astype(np.int32)
        self.size = np.diff(np.r_[pair, len(term)]).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, pair) if len(pair) else np.zeros(0, np.float32)
        self.first = np.searchsorted(term[pair], np.arange(n_terms + 1)).astype(np.int32)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The k examples of highest positive cosine with the query, ties by the lower index; exact."""
        sizes = self.first[terms + 1] - self.first[terms]
        pairs = ranges(self.first[terms], sizes)
        if not len(pairs):
            return []
        query = np.repeat(weights, sizes)
        of = self.block[pairs]
        bound = np.bincount(of, query * self.top[pairs], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, scores, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        chosen = np.zeros(self.blocks, bool)
        # The blocks of the highest bounds give a k-th best; then those that can still reach it.
        for some in (order[:AT_FIRST], order[AT_FIRST:]):
            some = some[bound[some] >= least - 1e-9]
            if not len(some):
                break
            chosen[:] = False
            chosen[some] = True
            mine = np.flatnonzero(chosen[of])
            count = self.size[pairs[mine]]
            posts = ranges(self.start[pairs[mine]], count)
            got = np.bincount(self.place[posts], np.repeat(query[mine], count) * self.weight[posts], self.n)
            hit = np.flatnonzero(got > 0)
            found, scores = np.r_[found, self.order[hit]], np.r_[scores, np.round(got[hit], 12)]
            if len(scores) >= k:
                least = float(-np.partition(-scores, k - 1)[k - 1])
                kept = scores >= least
                found, scores = found[kept], scores[kept]
        best = np.lexsort((found, -scores))[:k]
        return list(zip(found[best].tolist(), scores[best].tolist()))


class Model:
    """Examples as (doc_id, label, hashes, times); ``share`` weighs an example of each label."""

    def __init__(self, examples: list[tuple], share: tuple[float, float]):
        self.examples = examples
        self.of = _Terms()
        counts = [np.full(len(e[2]), share[e[1]]) for e in examples]
        self.n = float(sum(share[e[1]] for e in examples))
        every = np.concatenate([e[2] for e in examples]) if examples else np.zeros(0, np.uint64)
        self.terms, place = np.unique(every, return_inverse=True)
        seen = np.bincount(place, np.concatenate(counts), len(self.terms)) if examples else np.zeros(0)
        self.idf = np.where(seen > STOP * self.n, 0.0, np.log((1 + self.n) / (1 + seen)) + 1)
        self.unseen = float(np.log(1 + self.n) + 1)
        self.index = Index([self.unit(e[2], e[3]) for e in examples], len(self.terms))
        self.slope, self.shift, self.rate = 1.0, 0.0, 0.5

    def unit(self, hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms that weigh, as numbers, with their share of the whole text's unit vector."""
        at = np.minimum(np.searchsorted(self.terms, hashes), max(0, len(self.terms) - 1))
        known = self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), bool)
        weight = np.where(known, self.idf[at] if len(self.terms) else 0.0, self.unseen) * times**2
        norm = float(np.sqrt((weight**2).sum()))
        use = known & (weight > 0)
        return at[use].astype(np.int64), weight[use] / max(norm, 1e-300)

    def vote(self, near: list[tuple[int, float]]) -> float:
        """Votes for label 1 against label 0 as log odds, weighted by 1 / (distance + 0.1)."""
        sums = [PRIOR, PRIOR]
        for i, cosine in near:
            sums[self.examples[i][1]] += 1 / (1.1 - min(1.0, cosine))
        return float(np.log(sums[1] / sums[0]))

    def near(self, hashes: np.ndarray, times: np.ndarray) -> list[tuple[int, float]]:
        return self.index.search(*self.unit(hashes, times), NEIGHBOURS)

    def calibrate(self, rows: list[tuple], share: tuple[float, float]) -> None:
        """Fit the logistic map of the votes, and the rate of texts without neighbours, to rows kept out of the index."""
        found = [(self.near(h, t), y) for _, y, h, t in rows]
        plain = [y for near, y in found if not near]
        self.rate = (sum(share[1] for y in plain if y) + 0.5 * min(share)) / max(1e-9, sum(share[y] for y in plain) + min(share))
        data = [(self.vote(near), y) for near, y in found if near]
        if len({y for _, y in data}) == 2:
            x, y = np.array([d[0] for d in data]), np.array([d[1] for d in data], float)
            w = np.where(y > 0, share[1], share[0])
            w /= w.mean()
            theta = np.array([1.0, 0.0])
            a = np.stack([x, np.ones_like(x)], 1)
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
                grad = a.T @ (w * (p - y)) + 0.1 * (theta - [1.0, 0.0])
                hess = (a * (w * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
                theta = theta - np.linalg.solve(hess, grad)
            if theta[0] > 0:
                self.slope, self.shift = float(theta[0]), float(theta[1])

    def score(self, text: str) -> tuple[float, str]:
        """Score and evidence (doc_id:label:cosine of the nearest examples)."""
        near = self.near(*counted(text, self.of))
        if not near:
            return self.rate, ""
        evidence = ",".join(f"{self.examples[i][0]}:{self.examples[i][1]}:{c:.4f}" for i, c in near[:EVIDENCE])
        return float(1 / (1 + np.exp(-(self.slope * self.vote(near) + self.shift)))), evidence


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Learn from labelled rows whose crc32(doc_id) modulo FOLDS isn't HELD; a quarter of them calibrates."""
    from_ = crc_fold("doc_id", FOLDS) != HELD
    small_batches(docs)

    @F.pandas_udf("hashes binary, times binary")
    def terms(texts: pd.Series) -> pd.DataFrame:
        of = _Terms()
        made = [counted(t, of) for t in texts]
        return pd.DataFrame({"hashes": [h.tobytes() for h, _ in made], "times": [t.astype(np.int32).tobytes() for _, t in made]})

    rows = labelled(docs, labels, "toxic", from_, per_class).select("doc_id", "y", F.expr("pmod(xxhash64(doc_id, 7), 4) = 0").alias("apart"), terms("text").alias("t"))
    got = sorted((r.doc_id, r.y, r.apart, bytes(r.hashes), bytes(r.times)) for r in rows.select("doc_id", "y", "apart", "t.*").collect())
    made = [(d, y, apart, np.frombuffer(h, np.uint64), np.frombuffer(t, np.int32).astype(float)) for d, y, apart, h, t in got]
    del got
    examples, others = ([(d, y, h, t) for d, y, apart, h, t in made if apart == side] for side in (False, True))
    if len({e[1] for e in examples}) < 2:
        return None
    totals = {r.y: r.n for r in labels.where(from_ & F.col("toxic").isin(0, 1)).groupBy(F.col("toxic").alias("y")).agg(F.count("*").alias("n")).collect()}
    seen = Counter(y for _, y, *_ in made)
    share = tuple(totals.get(y, 1) / max(1, seen[y]) for y in (0, 1))
    del made
    model = Model(examples, share)
    model.calibrate(others or examples, share)
    # What a search needs of an example is in the index; its name and label stay.
    model.examples = [(d, y) for d, y, _, _ in examples]
    return model


def scored(text: Column, model: Model | None) -> Column:
    """struct(score, evidence) of a text."""

    @F.pandas_udf("score double, evidence string")
    def run(texts: pd.Series) -> pd.DataFrame:
        made = [model.score(t or "") if model else (0.5, "") for t in texts]
        return pd.DataFrame(made, columns=["score", "evidence"])

    return run(text)


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row's whole text."""
    model = model or learn(docs, labels)
    made = docs.select("doc_id", (crc_fold("doc_id", FOLDS) == HELD).alias("held_out"), scored(whole_text(), model).alias("made"))
    return made.select("doc_id", "held_out", F.col("made.score").alias("score"), (F.col("made.score") >= TOXIC_FROM).cast("int").alias("predicted"), F.col("made.evidence").alias("evidence"))
