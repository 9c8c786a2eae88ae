"""Document fingerprints by consistent weighted sampling.

A document is the weighted set of its word pairs (two neighbouring words, the
first one paired with the start of the text), a pair's weight being its count.
For each of ``samples`` independent hash functions a term draws
``r, c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)`` from its hash, and with weight ``S``
competes with ``t = floor(ln S / r + b)`` and ``ln a = ln c - r (t - b + 1)``;
the sample is the pair ``(term, t)`` of least ``a``. Two documents share a sample
with probability equal to their generalised Jaccard similarity
``sum min(S) / sum max(S)``.

Everything is built-in column functions: terms are exploded, counted per
document and reduced to one least packed value per hash function by hash
aggregation, so memory is bounded by the distinct terms of a task. All shuffles
are on the document key, which is unique, so no key is hot; a frequent word is
only ever counted inside its document.

Edge cases: a null text is empty; an empty text has no terms, the fingerprint
``''``, likeness 1 to another empty text and 0 to any other; rows that agree in
id and text are one document, and each of them gets its result row; rows that
share only the id are ordered by a hash of the text; a null id comes first; of a
single document the next one is itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import UPPER, shared_table
from trellis.operators.rank import with_next

#: a likeness has a standard error of at most 1 / (2 sqrt(SAMPLES))
SAMPLES = 64
TASK_CHARS = 3 << 20
#: bids above this many means of a text's least bid are not worked out; a sample is above with probability exp(-BAR)
BAR = 20.0
ROWS_PER_RANGE = 20_000
#: stands for a null id inside the job, so that joins and groups need no null-safe keys
NULL_ID = -(1 << 63)
_UNIT = float(1 << 21)


def _uniform(h: Column, shift: int) -> Column:
    """21 bits of a hash as a number inside (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) / F.lit(_UNIT)


def _score(ln_a: Column) -> Column:
    return F.floor((F.greatest(F.least(ln_a, F.lit(63.0)), F.lit(-63.0)) + 64.0) * F.lit(float(1 << 26)))


def bids(x: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, a, b``: the bid of ``term`` under hash function ``lane`` with weights of logarithm ``a`` and ``b``: its
    ``ln a`` in the high bits and 30 bits that name ``(term, t)`` below, so ``min`` picks the
    sample. Null where the weight is 0 (its logarithm is null). Each step names what the next
    ones use more than once, so that it is computed once.

    Rows with a ``bar`` are left out, mostly before any logarithm is taken, where ``exp(ln a)`` is not below ``bar``
    over the larger weight: ``t <= ln S / r + u``, so ``a >= c exp(-r) / S``, with ``exp(-r) = p`` and
    ``c = -ln q >= 1 - q >= 1 - q1``. (``bar`` is given times the larger weight; the task's number keeps
    Spark from moving a filter below the step that names its hash.)"""
    pruned = ["bar"] if "bar" in x.columns else []

    def below_bar(x: DataFrame, q: str) -> DataFrame:
        return x.where(((1.0 - F.col(q)) * F.col("p") <= F.col("bar")) & (F.col("task") >= 0)) if pruned else x

    x = x.select(*keep, "term", "a", "b", *pruned, F.xxhash64("term", "lane").alias("h1"))
    x = x.select(*keep, "term", "a", "b", *pruned, (_uniform(F.col("h1"), 0) * _uniform(F.col("h1"), 21)).alias("p"),
                 _uniform(F.col("h1"), 42).alias("q1"), F.spark_partition_id().alias("task"))
    x = below_bar(x, "q1").select(*keep, "a", "b", *pruned, "p", "q1", F.xxhash64("lane", "term").alias("h2"))
    x = x.select(*keep, "a", "b", *pruned, "p", "h2", (F.col("q1") * _uniform(F.col("h2"), 0)).alias("q"),
                 F.spark_partition_id().alias("task"))
    x = below_bar(x, "q").select(*keep, "a", "b", "h2", (-F.log("p")).alias("r"), F.log(-F.log("q")).alias("ln_c"),
                                 _uniform(F.col("h2"), 21).alias("u"))
    x = x.select(*keep, "h2", "r", "ln_c", "u", *[F.floor(F.col(s) / F.col("r") + F.col("u")).alias(f"t{s}") for s in "ab"])

    def packed(t: str) -> Column:
        score = _score(F.col("ln_c") - F.col("r") * (F.col(t) - F.col("u") + 1.0))
        # |t| < 2^28, so the product is exact; an odd factor keeps its low 30 bits apart for every t
        name = F.shiftrightunsigned("h2", 30).bitwiseXOR(F.col(t) * F.lit(2654435761))
        bid = F.shiftleft(score, 30).bitwiseOR(name.bitwiseAND(F.lit((1 << 30) - 1)))
        return F.when(F.col(t).isNotNull(), bid)

    # most terms weigh the same in both texts: one bid serves both
    x = x.select(*keep, "h2", "r", "ln_c", "u", "ta", "tb", packed("ta").alias("a"))
    return x.select(*keep, "a", F.when(F.col("tb") == F.col("ta"), F.col("a")).otherwise(packed("tb")).alias("b"))


def words(text: Column) -> Column:
    spaced = F.translate(text, UPPER + "\t\n\x0b\x0c\r", UPPER.lower() + "     ")
    return F.array_remove(F.split(spaced, " "), "")


def fingerprints(pairs: DataFrame, keys: list[str], samples: int = SAMPLES, bar: float | None = BAR) -> DataFrame:
    """``keys, sig_a, sig_b, sure_a, sure_b`` (arrays of ``samples`` ints, null without words) of the
    texts ``text_a`` and ``text_b`` in each row of ``pairs``. ``keys`` name the row; ``same`` is a
    count of code points that both texts have in common at their start, so that
    the shared words are exploded once.

    The least ``a`` of a text of weight ``W`` is exponential with mean ``1 / W``. Bids of ``a`` above ``bar / W``
    are not worked out (None: all are), and ``sure`` says that every sample is below that, so that
    no bid left out can be less."""
    start = F.array(F.lit(""))
    head = F.expr("substring(text_a, 1, same)")
    # words that end inside the shared start: up to its last white space
    whole = F.regexp_extract(head, r"(?s)^(.*[ \t\n\x0b\x0c\r])", 1)
    w = pairs.select(*keys, F.concat(start, words(F.col("text_a"))).alias("wa"),
                     F.concat(start, words(F.col("text_b"))).alias("wb"),
                     (F.size(words(whole)) + 1).alias("c"))
    left = F.expr("concat(slice(wa, 1, size(wa) - 1), slice(wb, c, size(wb) - c))")
    right = F.expr("concat(slice(wa, 2, size(wa) - 1), slice(wb, c + 1, size(wb) - c))")
    # words of the lighter text that has any, for the bar
    least = F.least(*[F.when(F.size(s) > 1, F.size(s) - 1) for s in ("wa", "wb")])
    x = w.select(*keys, "c", F.size("wa").alias("na"), least.alias("least"),
                 F.posexplode(F.arrays_zip(left.alias("l"), right.alias("r"))))
    in_a, shared = F.col("pos") < F.col("na") - 1, F.col("pos") < F.col("c") - 1
    x = x.select(*keys, "least", F.xxhash64("col.l", "col.r").alias("term"),
                 in_a.cast("long").alias("a"), (~in_a | shared).cast("long").alias("b"))
    x = x.groupBy(*keys, "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("least").alias("least"))
    lanes = F.explode(F.array(*[F.lit(v) for v in range(samples)])).alias("lane")
    # a hair above, so that rounding leaves no bid below the bar out
    pruned = [] if bar is None else [(F.greatest("a", "b") * F.lit(bar * 1.000001) / F.col("least")).alias("bar")]
    x = x.select(*keys, "least", "term", F.log("a").alias("a"), F.log("b").alias("b"), *pruned)  # once a term, not once a lane
    x = bids(x.select(*x.columns, lanes), [*keys, "least", "lane"])
    x = x.groupBy(*keys, "lane").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.max("least").alias("least"))
    limit = _score(F.log(F.lit(float(bar or 1)) / F.col("least")))
    sure = lambda s: F.lit(True) if bar is None else F.shiftright(s, 30) < limit
    x = x.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("lane", F.hash("a").alias("a"), F.hash("b").alias("b"),
                                             F.col("a").isNull().alias("no_a"), F.col("b").isNull().alias("no_b")))).alias("got"),
        *[(F.count_if(sure(s)) == samples).alias(f"sure_{s}") for s in "ab"])
    sig = lambda s: F.when(~F.col("got")[0][f"no_{s}"], F.col(f"got.{s}"))
    return x.select(*keys, sig("a").alias("sig_a"), sig("b").alias("sig_b"), "sure_a", "sure_b")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; two texts without words are alike."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)) / F.lit(float(samples))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def sig_text(sig: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(sig, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0").substr(9, 8)), ""),
                      F.lit(""))


def _with_neighbours(k: DataFrame) -> DataFrame:
    """``k`` (``id, h, ...``, one row per document) with the key ``nx_id, nx_h`` of the next document."""
    st = k.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"),
               F.min(F.struct("id", "h")).alias("first")).first()
    real = k.where(F.col("id") != NULL_ID).agg(F.min("id").alias("lo")).first()["lo"] or 0
    ranges = max(1, -(-st["n"] // ROWS_PER_RANGE))
    width = max(0, (st["hi"] or 0) - real) // ranges + 1
    rng = F.when(F.col("id") == NULL_ID, -1).otherwise(F.floor((F.col("id") - F.lit(real)) / F.lit(width)))
    x = with_next(k.withColumn("key", F.struct("id", "h")).withColumn("rng", rng), ["id", "h"], "rng", ["key"])
    first = st["first"] or (0, 0)
    nx = F.coalesce(F.col("next_key"), F.struct(F.lit(first[0]).cast("long").alias("id"),
                                                F.lit(first[1]).cast("long").alias("h")))
    return x.select(*k.columns, nx["id"].alias("nx_id"), nx["h"].alias("nx_h"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          samples: int = SAMPLES, bar: float | None = BAR) -> DataFrame:
    """Per input row: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``, the edited text being the
    text whose last quarter is replaced by the start of the next document. Documents
    with a sample above the ``bar`` of ``fingerprints`` get a second pass with all bids."""
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    k = shared_table(d.groupBy("id", "h").agg(F.count(F.lit(1)).alias("copies"),
                                              F.min(F.length("text")).alias("n")), "fp-keys")
    nb = _with_neighbours(k)
    repeated = k.where("copies > 1").limit(1).count() > 0
    one = d.groupBy("id", "h").agg(F.first("text").alias("text")) if repeated else d
    # tasks by the characters to handle, so that a task's terms fit in memory
    chars = k.agg(F.sum("n").alias("n")).first()["n"] or 0
    one = one.repartition(max(1, chars // TASK_CHARS), "id", "h")
    # what each document lends to its predecessor: a prefix of the length needed
    need = nb.select(F.col("nx_id").alias("id"), F.col("nx_h").alias("h"), F.col("id").alias("to_id"),
                     F.col("h").alias("to_h"), F.floor(F.col("n") / 4).cast("int").alias("q"))
    lent = one.join(need, ["id", "h"]).select(F.col("to_id").alias("id"), F.col("to_h").alias("h"), "q",
                                              F.expr("substring(text, 1, q)").alias("lent"))
    both = one.join(lent, ["id", "h"]).withColumn("same", (F.length("text") - F.col("q")).cast("int"))
    both = both.select("id", "h", "same", F.col("text").alias("text_a"),
                       F.concat(F.expr("substring(text, 1, same)"), "lent").alias("text_b"))
    wordy = lambda s: F.col(f"text_{s}").rlike(r"[^ \t\n\x0b\x0c\r]").alias(f"wordy_{s}")
    made = both.select("id", "h", F.sha2("text_b", 256).alias("edited_sha256"), wordy("a"), wordy("b")) \
        .join(fingerprints(both, ["id", "h"], samples, bar), ["id", "h"], "left")
    made = shared_table(made, "fp-signatures")
    unsure = [F.col(f"wordy_{s}") & ~F.coalesce(f"sure_{s}", F.lit(False)) for s in "ab"]
    unsure = unsure[0] | unsure[1]
    again = made.where(unsure).select("id", "h", "edited_sha256")
    if again.limit(1).count():
        rest = shared_table(fingerprints(both.join(again, ["id", "h"], "left_semi"), ["id", "h"], samples, None), "fp-again")
        made = made.where(~unsure).unionByName(again.join(rest, ["id", "h"]), allowMissingColumns=True)
    nxt = made.select(F.col("id").alias("nx_id"), F.col("h").alias("nx_h"), F.col("sig_a").alias("sig_next"))
    out = nb.join(made, ["id", "h"]).join(nxt, ["nx_id", "nx_h"])
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"),
                      F.col("n").cast("long").alias("n_chars"), "edited_sha256",
                      sig_text(F.col("sig_a")).alias("fingerprint"),
                      sig_text(F.col("sig_b")).alias("edited_fingerprint"),
                      likeness(F.col("sig_a"), F.col("sig_b"), samples).alias("near_edited"),
                      likeness(F.col("sig_a"), F.col("sig_next"), samples).alias("near_next"))
