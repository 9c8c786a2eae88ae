"""Token columns of the language-model scoring stay at four bytes a token."""

import numpy as np

from trellis.llm import lm_score as lm


def test_codes_in_four_bytes():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 2, 1, 40, 3])
    vocab = [b"w%d" % i for i in range(60)]
    classes = lm._block_classes(vocab, [lm.rare_class(w) for w in vocab], {b"w3": 1, b"w7": lm.TOP})
    assert classes.dtype == np.int32 and len(classes) == 61 and classes[0] == lm.END and classes[4] == 1 and classes[8] == lm.TOP
    c = classes[rng.integers(0, 61, lengths.sum())]
    codes = lm._codes(c, lengths)
    assert codes.dtype == np.int32 and lm.CLASSES ** 3 < np.iinfo(np.int32).max
    want, at = [], 0
    for n in lengths:
        text = [lm.END, lm.END, *c[at:at + n].tolist()]
        want += [(text[i] * lm.CLASSES + text[i + 1]) * lm.CLASSES + text[i + 2] for i in range(n)]
        at += n
    assert codes.tolist() == want


def test_row_groups_hold_few_blocks(spark, monkeypatch, tmp_path):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from trellis.llm.common import shared_table
    monkeypatch.setattr(lm, "BLOCK_CHARS", 2_000)
    monkeypatch.setitem(lm.BLOCK_FILES, "parquet.block.size", 20_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        texts = [(i, f"w{i % 7} common words and more w{i}" * 12 if i % 9 else None) for i in range(600)]
        docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
        packed = shared_table(lm.blocks(docs, F.lit(True), "doc_id", "text"), "lm-blocks-test", lm.BLOCK_FILES)
        groups = [g for f in packed.inputFiles() for g in [pq.ParquetFile(f.removeprefix("file://")).metadata]]
        sizes = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
        assert (sum(sizes), packed.count() > 50, max(sizes) < 30) == (packed.count(), True, True), sizes
        rows = packed.orderBy("block").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [i for r in rows for i in r.doc_ids] == [i for i, _ in texts]
    for r in rows:
        tokens = np.frombuffer(r.tokens, np.int32)
        assert sum(r.lengths) == len(tokens) and np.bincount(tokens, minlength=len(r.vocab) + 1)[1:].tolist() == r.counts
        at = 0
        for i, n in zip(r.doc_ids, r.lengths):
            assert [bytes(r.vocab[t - 1]) for t in tokens[at:at + n - 1]] == lm.words(texts[i][1]) and tokens[at + n - 1] == 0
            at += n
