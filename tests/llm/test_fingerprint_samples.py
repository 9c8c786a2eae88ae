"""The registered number of samples, held to the accuracy the README gives."""

from tests.llm.helpers import docs_frame, word_soup
from tests.llm.test_pairs import generalised_jaccard
from trellis.llm import fingerprint


def test_accuracy_at_the_default(spark):
    rows = [(k, word_soup(150 + k, k // 2, 60)) for k in range(120)]
    got = fingerprint.fingerprint_documents(docs_frame(spark, rows)).collect()
    text = dict(rows)
    error = []
    for r in got:
        t, nxt = text[r.doc_id], text[(r.doc_id + 1) % len(rows)]
        q = len(t) // 4
        error.append(r.near_edited - generalised_jaccard(t, t[:len(t) - q] + nxt[:q]))
        error.append(r.near_next - generalised_jaccard(t, nxt))
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 8 * fingerprint.SAMPLES >= 8 * 64
        same = [r.fingerprint[k:k + 8] == r.edited_fingerprint[k:k + 8] for k in range(0, len(r.fingerprint), 8)]
        assert r.near_edited == sum(same) / len(same)
    assert (sum(x * x for x in error) / len(error)) ** 0.5 < 0.0625


def test_bids_left_out_change_no_sample(spark):
    """Most bids are left out before they are worked out; where the bar was too low, the document is done again."""
    rows = [(k, word_soup(40 + 5 * k, k // 2, 60)) for k in range(40)] + [
        (100, ""), (101, None), (102, "one"), (103, "a " * 300), (104, " \t"), (None, "tn x0b rc")]
    docs = docs_frame(spark, rows)
    full = sorted(map(str, fingerprint.fingerprint_documents(docs, bar=None).collect()))
    for bar in (fingerprint.BAR, 3.0):   # 3: many samples are above it
        assert sorted(map(str, fingerprint.fingerprint_documents(docs, bar=bar).collect())) == full


def test_most_bids_are_left_out(spark):
    from pyspark.sql import functions as F
    terms = spark.range(500).select(F.xxhash64("id").alias("term"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    terms = terms.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("lane"))
    least = lambda x: sorted(fingerprint.bids(x, ["lane"]).groupBy("lane").agg(F.min("a"), F.min("b")).collect())
    barred = terms.withColumn("bar", F.lit(fingerprint.BAR / 500))
    assert least(barred) == least(terms)
    assert fingerprint.bids(barred, ["lane"]).count() < 0.25 * terms.count()
