"""The pipeline against its stages by brute force on a small table."""

from collections import Counter

import tiktoken

import corpus_pipeline
import public_tokenizers
from hushql.llm import bpe, decontam, langid
from hushql.llm.common import table
from tests.llm.test_nearcopies import brute

DATA = "/root/testdata/sf0.001"


def test_run(spark):
    docs = table(spark, DATA, "documents")
    model = langid.learn(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [(d, t) for d, t in rows if not model.predict([t or ""], langid.REJECT_BELOW)[2][0]]
    stay = set(brute(kept))
    kept = [(d, t) for d, t in kept if d in stay]
    index = decontam.Index([(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()])
    kept = [(d, t) for (d, t), leaks in zip(kept, index.leaks([t for _, t in kept])) if not any(decontam.leaked(x[1], x[3], decontam.COVERED) for x in leaks)]
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary()), special_tokens={})
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in kept)
    texts = dict(kept)
    secret = Counter()
    for r in got:
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        text = theirs.decode(ids)
        secret[text == texts[r.doc_id]] += 1
        assert text == texts[r.doc_id] or "[SECRET]" in text
        assert "AKIA" not in text
    assert secret[True] > 0 and len(got) < len(rows)


def test_stages_keep_awkward_rows(spark):
    docs = table(spark, DATA, "documents")
    more = spark.createDataFrame([(None, "the null id stays and is read", "en", None, None), (77_001, None, None, None, None), (77_002, "", "en", "s", 0)], docs.schema)
    names = ["fp", "rejected", "doc", "id", "own", "node", "low", "root", "leaks", "masked", "text_", "spans_", "made", "own_hash", "text_hash", "row"]
    docs = docs.union(more).selectExpr("*", *[f"'{n}' as `{n}`" for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        assert out.where("doc_id is null").count() == 1
