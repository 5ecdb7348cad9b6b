"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are the runs of two to four code points of the lower-cased text, with everything but letters read as the word
boundary; a run never spans a boundary. Each is hashed to an embedding, a text is their mean.

Texts that are null or have no letter are `und` with score 0. The softmax is calibrated by a temperature fitted on
learning rows kept apart; ``rejected`` says whether the calibrated score is below the bar or the text is `und`.
Learning takes a bounded, documented sample (PER_LANGUAGE rows a language, MOST_ROWS in all); no language is left out, and with
no rows to learn from all is `und`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushql.llm.common import bounded_sample, crc_fold, small_batches, whole_text

BUCKETS = 1 << 15
DIM = 12
SIZES = (2, 3, 4)
FOLDS = 5
#: Rows that are learned from, of a language and (one of each at least) of all languages.
PER_LANGUAGE, MOST_ROWS = 500, 50_000
EPOCHS = 6
REJECT_BELOW = 0.5
#: Code points that are hashed at once.
PIECE = 1 << 20
PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code points that are letters or marks as they are, all others as a space."""
    return np.array([i if unicodedata.category(chr(i))[0] in "LM" else 32 for i in range(0x110000)], np.uint32)


def codes(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


def subwords(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the places and buckets of the subwords."""
    space = code == 32
    with np.errstate(over="ignore"):
        for n in SIZES:
            m = len(code) - n + 1
            if m <= 0:
                continue
            keep = ~(space[:m] & space[n - 1 :])
            for k in range(1, n - 1):
                keep &= ~space[k : k + m]
            at = np.flatnonzero(keep)
            h = np.full(len(at), n, np.uint32)
            for k in range(n):
                h = (h ^ code[at + k]) * PRIMES[k]
                h ^= h >> np.uint32(15)
            yield at, h & np.uint32(BUCKETS - 1)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text with how often each occurs."""
    counts = np.zeros(BUCKETS, np.int64)
    text = f" {text} "
    for start in range(0, len(text), PIECE):
        code = codes(text[start : start + PIECE + SIZES[-1] - 1])
        for at, h in subwords(code):
            counts += np.bincount(h[at < PIECE], minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used, counts[used]


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, temperature: float):
        self.languages, self.table, self.temperature = languages, table, temperature

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, and whether a text has a letter."""
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        group, size = [], 0
        for i, text in enumerate(texts):
            if len(text) > PIECE:
                used, counts = bag(text)
                sums[i], n[i] = counts @ self.table[used], counts.sum()
                continue
            group.append(i)
            size += len(text) + 2
            if size >= PIECE:
                self._add(texts, group, sums, n)
                group, size = [], 0
        self._add(texts, group, sums, n)
        logits = sums / np.maximum(n, 1)[:, None] / self.temperature
        e = np.exp(logits - logits.max(1, initial=0, keepdims=True))
        return e / np.maximum(e.sum(1, keepdims=True), 1e-300), n > 0

    def _add(self, texts: list[str], group: list[int], sums: np.ndarray, n: np.ndarray) -> None:
        if not group:
            return
        # str.lower may change lengths, so each text is lowered before the places are counted.
        low = [texts[i].lower() for i in group]
        begins = np.r_[0, np.cumsum([len(t) + 2 for t in low])]
        code = codes(" " + "  ".join(low) + " ")
        for at, h in subwords(code):
            edges = np.searchsorted(at, begins)
            got = self.table[h]
            for j, (x, y) in enumerate(zip(edges, edges[1:])):
                if y > x:
                    sums[group[j]] += got[x:y].sum(0)
                    n[group[j]] += y - x

    def predict(self, texts: list[str], reject_below: float) -> tuple[list[str], list[float], list[bool]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        p, letters = self.scores(texts)
        best, top = p.argmax(1), p.max(1)
        # Marks alone make subwords too, but no letter.
        letters &= np.array([any(map(str.isalpha, t)) for t in texts], bool)
        names = [self.languages[b] if has else "und" for b, has in zip(best, letters)]
        score = np.where(letters, top, 0.0)
        return names, score.tolist(), (~letters | (top < reject_below)).tolist()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], apart: np.ndarray, seed: int = 42) -> Model:
    """SGD over the rows that aren't ``apart``; those fit the temperature. Rows without subwords are left out."""
    use = [i for i, (u, _) in enumerate(bags) if len(u)]
    names = sorted({langs[i] for i in use})
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0)
    y = {i: names.index(langs[i]) for i in use}
    rng = np.random.default_rng(seed)
    emb, lin = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)), rng.normal(0, 1 / np.sqrt(DIM), (DIM, len(names)))
    fit = [i for i in use if not apart[i]] or use
    weight = len(fit) / len(names) / np.maximum(1, np.bincount([y[i] for i in fit], minlength=len(names)))
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            rate = 1.0 * (1 - done / steps) + 0.01
            done += 1
            used, counts = bags[i]
            share = counts / counts.sum()
            x = share @ emb[used]
            g = _softmax(x @ lin)
            g[y[i]] -= 1
            g *= min(3.0, weight[y[i]])
            back = lin @ g
            lin -= 0.5 * rate * np.outer(x, g)
            # The mean spreads a step over all subwords of a text; a step by share times their number undoes that.
            emb[used] -= rate * min(len(used), 200) * share[:, None] * back
    table = (emb @ lin).astype(np.float32)
    check = [i for i in use if apart[i]] or fit
    logits = np.array([(c / c.sum()) @ table[u] for u, c in (bags[i] for i in check)])
    truth = np.array([y[i] for i in check])
    loss = {t: -np.log(_softmax(logits / t)[np.arange(len(check)), truth] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    return Model(names, table, float(min(loss, key=loss.get)))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from text and lang of rows whose crc32(doc_id) modulo FOLDS isn't 0.

    Workers hash the sampled texts; the driver gets at most BUCKETS counts for each, whole and for a short middle part
    that stands for short texts.
    """
    small_batches(docs)
    rows = docs.select("doc_id", "lang", whole_text().alias("text"), crc_fold("doc_id", FOLDS).alias("fold")).where("fold <> 0 and lang is not null")
    languages = rows.select("lang").distinct().count()
    rows = bounded_sample(rows.withColumn("text_hash", F.xxhash64("text")), "lang", max(1, min(per_language, MOST_ROWS // max(1, languages))), "doc_id", "text_hash")

    @F.pandas_udf("array<struct<used:binary,counts:binary>>")
    def bags(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            at = len(t) // 2
            made = [bag(t), bag(t[at : at + 40])]
            out.append([{"used": u.astype(np.int32).tobytes(), "counts": c.astype(np.int32).tobytes()} for u, c in made])
        return pd.Series(out, dtype=object)

    got = rows.select("doc_id", "lang", (F.col("fold") == 1).alias("apart"), bags("text").alias("bags")).collect()
    got.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang, bytes(r.bags[0].used)))
    read = lambda b: np.frombuffer(b, np.int32).astype(np.int64)
    return train([(read(b.used), read(b.counts)) for r in got for b in r.bags], [r.lang for r in got for _ in r.bags], np.array([r.apart for r in got for _ in r.bags], bool))


def identified(text: Column, model: Model, reject_below: float = REJECT_BELOW) -> Column:
    """struct(lang_pred, score, rejected) of a text."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        made = model.predict([t or "" for t in texts], reject_below)
        return pd.DataFrame(dict(zip(("lang_pred", "score", "rejected"), made)))

    return run(text)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row's whole text."""
    model = model or learn(docs)
    held = crc_fold("doc_id", FOLDS) == 0
    return docs.select("doc_id", held.alias("held_out"), identified(whole_text(), model).alias("made")).select("doc_id", "held_out", "made.*")
