"""The pipeline's near-copy stage against brute-force overlap of five-word shingles."""

import random

import pytest

import corpus_pipeline
from hushql.llm import nearcopies, simhash


def brute(rows):
    """Least doc_id of each component of texts whose shingles have similarity 0.8 or more."""

    def grams(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, group = {d: grams(t) for d, t in rows}, {d: {d} for d, _ in rows}
    for a in sets:
        for b in sets:
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and group[a] is not group[b]:
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    return sorted({min(g) for g in group.values()})


@pytest.mark.parametrize("room", [1024, 8])
def test_edited_copies_go(spark, monkeypatch, room):
    """Copies with a few words replaced, which differ in more than 3 bits, chains of them, and a large group."""
    monkeypatch.setattr(nearcopies, "ROOM", room)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, ""), (2, " "), (3, "one two"), (4, "One  two"), (5, "one three")]
    for base in range(6):
        text = rng.choices(words, k=rng.choice([60, 200, 400]))
        for _ in range(12):
            rows.append((len(rows) + 1, " ".join(text)))
            if base % 2:
                text = list(text)
            copy = text if base % 2 else list(text)
            for i in rng.sample(range(len(copy)), len(copy) // rng.choice([40, 60, 90])):
                copy[i] = rng.choice(words)
            rows.append((len(rows) + 1, " ".join(copy)))
    prints = [simhash.fingerprint(t) for _, t in rows]
    assert any((prints[5] ^ p).bit_count() > 3 for p in prints[6:9])
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    want = brute(rows)
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < len(rows) / 2


def test_rows_of_one_id_are_apart(spark):
    """A repeated doc_id with different texts loses no text; equal rows and near copies are still one."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=50)) for _ in range(40)]
    rows = [(7, t, "en", "s", len(t)) for t in texts] + [(7, texts[0], "en", "s", 0), (8, texts[1], "en", "s", 0), (None, texts[2], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.text for r in got if r.doc_id == 7) == sorted(texts)
    assert sorted(r.doc_id or 0 for r in got) == [0] + [7] * 40


def test_simhash_anchors_join_near_copies(spark, monkeypatch):
    """Without any band keys, texts within three bits of each other's fingerprint still meet at anchors and go."""
    monkeypatch.setattr(nearcopies, "band_keys", lambda hashes: [])
    rng = random.Random(3)
    words, rows = [f"w{i}" for i in range(3000)], []
    for _ in range(8):
        text = rng.choices(words, k=1500)
        rows.append((len(rows) + 1, " ".join(text)))
        for _ in range(5):
            copy = list(text)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 1, " ".join(copy)))
    prints = [nearcopies.print_of(nearcopies.shingles(t)) for _, t in rows]
    bits = lambda x, y: ((prints[x] ^ prints[y]) & (1 << 64) - 1).bit_count()
    group = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if bits(x, y) <= 3:
                group = [group[y] if g == group[x] else g for g in group]
    want = sorted(min(d for (d, _), g in zip(rows, group) if g == k) for k in set(group))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
    assert any(0 < bits(x, 0) <= 3 for x in range(1, 6)) and len(want) < len(rows) / 2
