"""The pipeline's stages, each judged on its own input."""

from collections import Counter

import corpus_pipeline
from tests.llm.helpers import SF
from tests.llm.test_pairs import brute_components
from tests.llm.test_text_ops import brute_hits
from trellis.llm.common import shared_table, table
from trellis.llm.secrets_crf import base_spans


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, inputs, outputs = docs.columns, [], []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = shared_table(stage(spark, docs, SF), name)
        outputs.append(docs)
        assert name == "packing" or docs.columns == columns
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in outputs[0].collect()}
    good = [d for d, q in quality.items() if q]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum(d in kept for d, q in quality.items() if not q) <= 0.2 * (len(quality) - len(good))

    pairs = [(r.doc_id, r.text) for r in inputs[1].collect()]
    assert {r.doc_id for r in outputs[1].collect()} == {
        d for d, n, _, k in brute_components(pairs, 5, 80) if k or n == 0}

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    pairs = [(r.doc_id, r.text) for r in inputs[2].collect()]
    assert {r.doc_id for r in outputs[2].collect()} == {k[0] for k in brute_hits(pairs, items) if not k[5]}

    before = {r.doc_id: r.text for r in inputs[3].collect()}
    after = {r.doc_id: r for r in outputs[3].collect()}
    assert before.keys() == after.keys()
    for d, r in after.items():
        if base_spans(before[d]):
            assert not base_spans(r.text) and r.n_chars == len(r.text)
    assert sum(after[d].text != t for d, t in before.items() if not base_spans(t)) <= 0.02 * len(before)

    per = Counter()
    for r in outputs[4].collect():
        per[r.doc_id] += r.length
        assert r.offset + r.length <= 4096
    whole = {r.doc_id: r.doc_tokens for r in outputs[4].collect()}
    assert per == whole and whole.keys() == after.keys()
