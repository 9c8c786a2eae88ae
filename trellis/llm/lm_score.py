"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation.

Words are grouped into classes: the ``TOP`` most frequent words and the text's end have
a class each, the others share ``RARE`` classes by their last two bytes. The log-bilinear
model predicts the class of a token from the classes of the two tokens before it:
``s(w | h) = (C1 r[h1] + C2 r[h2]) . q[w] + b[w]``. It is trained in numpy by
noise-contrastive estimation on the class trigrams of *all* training tokens (counted by
Spark), and batched matrix products with a softmax turn it into a table of
normalised log-probabilities, one row for each pair of context classes. A word's
probability is its class's times its smoothed share of the class, so the model is
normalised over words; the unigram base score uses the same counts. Every step of the training
takes all counted trigrams, so that its time does not grow with the corpus and no token is left out.

Steps, all over the whole corpus:

1. a map packs documents into blocks of about ``BLOCK_CHARS`` characters with the
   block's distinct words, their training counts and the tokens as numbers;
2. the blocks' distinct words meet by word: a window sums their counts (a word
   has one row a block, however frequent it is); the result is written once;
3. class trigram counts by task, summed by code;
4. the counts go back to their block, and the block's documents are scored.

A word crosses the network once for each block it is in, never once a token, so a
frequent word is no hot key. The driver sees ``TOP`` words, the class totals and at most
``CLASSES ** 3`` trigram counts, whatever the corpus.

Edge cases: a null text is empty and has its end only; repeated rows are scored (and
counted in training) as often as they come; without training rows all counts are 0 and
the model is uniform over classes; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import shared_table

TOP, RARE = 80, 32
END = 0  # class and local number of the end; it is the context before a text, too
CLASSES = 1 + TOP + RARE
BLOCK_CHARS = 3 << 20
DIM = 24
SMOOTH = 0.1
#: texts that a task turns into Python objects at a time
TEXTS = 64
#: A block is one row of several MB. Writers look at their size at every row and readers take a row group at a
#: time, so that what a task holds does not grow with its file.
BLOCK_FILES = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1,
               "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def words(text: str | bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but space and the characters 9 to 13."""
    text = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return text.lower().split() if isinstance(text, bytes) else []


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % RARE


def blocks(docs: DataFrame, train_rows: Column, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents: ``block, doc_ids, train, lengths, tokens, vocab, counts, rare``;
    token ``k > 0`` is ``vocab[k - 1]``, 0 is an end."""
    is_text = docs.schema[text_col].dataType.typeName() in ("string", "varchar", "char")
    d = docs.select(F.col(id_col).alias("id"), (F.col(text_col) if is_text else F.lit(None)).cast("binary").alias("text"),
                    train_rows.alias("train"), F.spark_partition_id().cast("long").alias("part"))
    kind = d.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, part, state = 0, 0, None
        for batch in batches:
            state = state or _Block(batch.schema.field("id").type)
            for s in range(0, batch.num_rows, TEXTS):
                few = batch.slice(s, TEXTS).to_pydict()
                part = few["part"][0]
                for i, text, use in zip(few["id"], few["text"], few["train"]):
                    state.add(i, words(text), bool(use))
                    if state.chars >= BLOCK_CHARS:
                        yield state.row(part << 32 | k)
                        k, state = k + 1, _Block(state.id_type)
        if state and state.ids:
            yield state.row(part << 32 | k)

    return d.mapInArrow(run, f"block long, doc_ids array<{kind}>, train array<boolean>, lengths array<int>, "
                             "tokens binary, vocab array<binary>, counts array<long>, rare array<int>")


class _Block:
    def __init__(self, id_type: pa.DataType):
        self.id_type = id_type
        self.number: dict[bytes, int] = {}
        self.ids, self.train, self.lengths, self.tokens, self.chars = [], [], [], [], 0

    def add(self, doc_id, ws: list[bytes], train: bool) -> None:
        number = self.number
        for w in set(ws).difference(number):
            number[w] = len(number) + 1
        x = np.zeros(len(ws) + 1, np.int32)
        x[:-1] = np.fromiter(map(number.__getitem__, ws), np.int32, len(ws))
        self.ids.append(doc_id)
        self.train.append(train)
        self.lengths.append(len(x))
        self.tokens.append(x)
        self.chars += sum(map(len, ws)) + len(ws) + 1

    def row(self, block: int) -> pa.RecordBatch:
        counts = np.zeros(len(self.number) + 1, np.int64)
        tokens = np.concatenate(self.tokens)
        self.tokens = None
        learnt = np.repeat(np.asarray(self.train, bool), self.lengths)
        counts += np.bincount(tokens if learnt.all() else tokens[learnt], minlength=len(counts))
        vocab = list(self.number)
        self.number = None
        columns = {"block": pa.array([block], pa.int64()), "doc_ids": _one(pa.array(self.ids, self.id_type)),
                   "train": _one(pa.array(self.train, pa.bool_())), "lengths": _one(pa.array(self.lengths, pa.int32())),
                   "tokens": pa.array([tokens.tobytes()], pa.binary()), "vocab": _one(pa.array(vocab, pa.binary())),
                   "counts": _one(pa.array(counts[1:])), "rare": _one(pa.array([rare_class(w) for w in vocab], pa.int32()))}
        return pa.RecordBatch.from_pydict(columns)


def _one(values: pa.Array) -> pa.ListArray:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class LogBilinear:
    """Class model with two context positions."""

    def __init__(self, classes: int = CLASSES, dim: int = DIM, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.r = rng.normal(0, 0.1, (classes, dim))
        self.q = rng.normal(0, 0.1, (classes, dim))
        self.c = np.stack([np.eye(dim), np.eye(dim)]) * 0.5
        self.b = np.zeros(classes)

    def train(self, codes: np.ndarray, counts: np.ndarray, steps: int = 400, noise: int = 10, rate: float = 0.02) -> LogBilinear:
        """Noise-contrastive estimation on trigram codes ``(h1 * K + h2) * K + w`` and their counts; the noise is
        the unigram distribution of the classes. Nothing is drawn: every step takes the gradient of the whole
        objective, all counted tokens against ``noise`` times the expected noise of their contexts."""
        k = len(self.b)
        context, at = np.unique(codes // k, return_inverse=True)
        h1, h2 = context // k, context % k
        seen = np.zeros((len(context), k))
        np.add.at(seen, (at, codes % k), counts / counts.sum())
        uni = np.bincount(codes % k, counts, k) + 0.5
        uni /= uni.sum()
        both = (seen + noise * seen.sum(1, keepdims=True) * uni).astype(np.float32)
        seen = seen.astype(np.float32)
        log_noise = np.log(noise * uni)
        one, two = (np.eye(k, dtype=np.float32)[h] for h in (h1, h2))
        self.b = np.log(uni)
        params = [self.r, self.q, self.c, self.b]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, steps + 1):
            hidden = ((self.r @ self.c[0])[h1] + (self.r @ self.c[1])[h2]).astype(np.float32)
            s = hidden @ self.q.T.astype(np.float32) + (self.b - log_noise).astype(np.float32)
            err = both / (1.0 + np.exp(-np.clip(s, -30, 30))) - seen
            dh = err @ self.q.astype(np.float32)
            d1, d2 = (one.T @ dh).astype(float), (two.T @ dh).astype(float)
            grads = (d1 @ self.c[0].T + d2 @ self.c[1].T, (err.T @ hidden).astype(float),
                     np.stack([self.r.T @ d1, self.r.T @ d2]), err.sum(0, dtype=float))
            slow = rate * (1.0 - 0.9 * step / steps)
            for p, g, (a, v) in zip(params, grads, state):
                a += 0.1 * (g - a)
                v += 0.001 * (g * g - v)
                p -= slow * (a / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        return self

    def log_table(self) -> np.ndarray:
        """``log10 P(w | h1, h2)`` for all classes: matrix products in batches of contexts."""
        k = len(self.b)
        first, second = self.r @ self.c[0], self.r @ self.c[1]
        out = np.empty((k, k, k), np.float32)
        for h1 in range(k):
            s = (first[h1] + second) @ self.q.T + self.b
            s -= s.max(1, keepdims=True)
            out[h1] = (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10.0)
        return out


def uniform_table(classes: int = CLASSES) -> np.ndarray:
    return np.full((classes, classes, classes), -np.log10(classes), np.float32)


def _block_classes(vocab, rare, top: dict[bytes, int]) -> np.ndarray:
    """Class of every local number. Arrow looks the words up; none becomes a Python object."""
    vocab = vocab if isinstance(vocab, pa.Array) else pa.array(vocab, pa.binary())
    names = pa.array(list(top), pa.binary())
    at = pc.fill_null(pc.index_in(vocab, value_set=names), len(top)).to_numpy(zero_copy_only=False)
    own = np.array([*top.values(), END], np.int32)[at]
    out = np.full(len(vocab) + 1, END, np.int32)
    out[1:] = np.where(at < len(top), own, 1 + TOP + np.asarray(rare, np.int32))
    return out


def _context(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens back; the end stands before a text's first token."""
    first = np.zeros(len(classes), bool)
    first[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = True
    one, two = np.full((2, len(classes)), END, classes.dtype)
    one[1:] = classes[:-1]
    one[first] = END
    two[1:] = one[:-1]
    two[first] = END
    return two, one


def _codes(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Trigram codes, below ``CLASSES ** 3``, of all tokens, computed in place: four bytes a token."""
    code, one = _context(classes, lengths)
    code *= CLASSES
    code += one
    code *= CLASSES
    code += classes
    return code


def trigram_counts(packed: DataFrame, top: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the class trigrams of all training tokens: dense sums in
    each task (``CLASSES ** 3`` cells), then by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES ** 3, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):     # a block at a time
                train, lengths, vocab, rare = (batch.column(c)[i].values for c in ("train", "lengths", "vocab", "rare"))
                lengths = lengths.to_numpy(zero_copy_only=False).astype(np.int64)
                tokens = np.frombuffer(batch.column("tokens")[i].as_buffer(), np.int32)
                c = _block_classes(vocab, rare.to_numpy(zero_copy_only=False), top)[tokens]
                use = np.repeat(train.to_numpy(zero_copy_only=False).astype(bool), lengths)
                np.add.at(total, _codes(c, lengths)[use], 1)
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(codes, pa.int32()), "n": pa.array(total[codes], pa.int64())})

    rows = packed.select("train", "lengths", "tokens", "vocab", "rare").mapInArrow(run, "code int, n long") \
        .groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    return rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def score_documents(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score``."""
    kind = docs.schema[id_col].dataType.simpleString()
    packed = shared_table(blocks(docs, train_rows, id_col, text_col), "lm-blocks", BLOCK_FILES)
    vocab = packed.select("block", F.posexplode(F.arrays_zip("vocab", "counts", "rare")))
    by_word = Window.partitionBy("word")
    counted = vocab.select("block", "pos", F.col("col.vocab").alias("word"), F.col("col.counts").alias("n"),
                           F.col("col.rare").alias("rare"))
    counted = shared_table(counted.select("block", "pos", "word", "rare", F.sum("n").over(by_word).alias("c"), (
        F.row_number().over(by_word.orderBy("block", "pos")) == 1).alias("first")), "lm-counts")
    counts = counted.where("first")
    ends = packed.select(F.explode("train").alias("t")).agg(F.sum(F.col("t").cast("long")).alias("n")).first()["n"] or 0
    top_rows = counts.where("c > 0").orderBy(F.desc("c"), "word").limit(TOP).select("word", "c").collect()
    top = {bytes(r.word): k + 1 for k, r in enumerate(top_rows)}
    top_c = {k + 1: r.c for k, r in enumerate(top_rows)}
    in_class = {r["rare"]: (r["c"], r["v"]) for r in counts.groupBy("rare").agg(
        F.sum("c").alias("c"), F.sum((F.col("c") > 0).cast("long")).alias("v")).collect()}
    n_train = ends + sum(c for c, _ in in_class.values())
    n_types = (ends > 0) + sum(v for _, v in in_class.values())
    mass = np.zeros((CLASSES, 2))  # tokens and types of the rare classes, without the top words
    for r, (c, v) in in_class.items():
        mass[1 + TOP + r] = c, v
    for w, k in top.items():
        mass[1 + TOP + rare_class(w)] -= top_c[k], 1
    codes, numbers = trigram_counts(packed, top)
    table = LogBilinear().train(codes, numbers).log_table() if len(codes) else uniform_table()
    model = docs.sparkSession.sparkContext.broadcast((table, mass))  # CLASSES ** 3 floats

    # the class of a word: its own, if it is a top word, else by its ending
    names = docs.sparkSession.createDataFrame([(w, k) for w, k in top.items()], "word binary, k int")
    classed = counted.join(F.broadcast(names), "word", "left")  # TOP rows
    cls = F.coalesce("k", F.col("rare") + (1 + TOP))
    parts = max(1, -(-packed.count() // 2))  # a task holds about two blocks
    got = classed.select("block", F.struct("pos", "c", cls.alias("cls")).alias("x")).repartition(parts, "block") \
        .groupBy("block").agg(F.collect_list("x").alias("got"))
    # a block without words has no row there
    joined = packed.select("block", "doc_ids", "train", "lengths", "tokens").repartition(parts, "block").join(
        got.select("block", F.col("got.pos").alias("pos"), F.col("got.c").alias("c"), F.col("got.cls").alias("cls")),
        "block", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, mass = model.value
        flat = table.reshape(-1)
        base_norm = np.log10(n_train + SMOOTH * (n_types + 1))
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                lengths = np.asarray(row.lengths, np.int64)
                tokens = np.frombuffer(row.tokens, np.int32)
                size = 0 if row.pos is None else len(row.pos)
                c, cls = np.full(size + 1, float(ends)), np.zeros(size + 1, np.int32)
                if size:
                    at = np.asarray(row.pos, np.int64) + 1
                    c[at], cls[at] = np.asarray(row.c, float), np.asarray(row.cls, np.int32)
                inside = np.where(cls > TOP, np.log10((c + SMOOTH) / (mass[cls, 0] + SMOOTH * (mass[cls, 1] + 1))), 0.0)
                # one column of the block's tokens at a time
                first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                lp = inside[tokens]
                lp += flat[_codes(cls[tokens], lengths)]
                score = np.add.reduceat(lp, first)
                del lp
                base = np.add.reduceat((np.log10(c + SMOOTH) - base_norm)[tokens], first)
                yield pd.DataFrame({
                    "doc_id": pd.Series(list(row.doc_ids), dtype=object), "train": list(row.train), "n_tokens": lengths,
                    "n_known": np.add.reduceat((c > 0)[tokens], first, dtype=np.int64), "train_tokens": n_train,
                    "base_score": base, "score": score})

    return joined.mapInPandas(run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, "
                                   "base_score double, score double")
