"""Near-duplicate components by a chosen-path set similarity join.

A document is the set of its word shingles (64-bit hashes). Documents with equal
sets are one vertex, so copies are never paired with each other. ``SKETCH`` minwise
tokens are kept of each set. In every one of several independent trees a node
chooses one minwise coordinate (by a hash of its path) and branches its documents
by their token there; a node of one document ends, one of at most ``LEAF`` is a
leaf, a larger one branches again. A pair of Jaccard similarity J stays
together for k levels with probability ``J ** k``. Past ``LEVELS_AIMED`` levels a node branches by
``BRANCHES`` coordinates, each giving children of its own, so that a pair is likely to stay together under
one of them at any depth; the number of trees makes a miss after ``MAX_LEVELS`` levels in all of them
less likely than ``MISS``.

Leaves are compared exhaustively, in blocks: a node that would not get small (a
large family of near copies stays together at any depth) is cut into blocks by hash
and each pair of blocks is a task of its own, so no task holds a whole group and
nothing is capped. Comparison is by sketch first: a pair goes on if as many tokens
agree as a pair at the threshold reaches in all but ``MISS`` of cases, and if their
odd sketches (parities of the sets in ``ODD_BITS`` bins) do not prove that they
differ in too many elements. Links are then
confirmed on full sets, in two rounds: each document's most alike partner before it
in a cell first, and after merging what they confirm, all pairs between documents
that are still in different components. Pairs inside a component
need no look, as only components are returned.

Every step is a join, a grouping or a map over rows keyed by vertex, node or pair.
The driver sees counts only.

Edge cases: null and empty texts and texts without words have no set, link with
nothing and are their own component; a text of fewer words than a shingle has its whole
sequence as its one shingle; repeated rows are copies; a null id never is
the smallest unless a component has no other, and such a row is kept if its component has
no id at all; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import broadcast_if, shared_table, sized
from trellis.llm.components import connected_components
from trellis.llm.hashing import Hasher, mix

SKETCH = 96
ODD_BITS = 512
LEAF = 400
STAYS = 0.6  # a node of which a branch keeps this share is compared as it is
MAX_LEVELS = 8
LEVELS_AIMED = 3
BRANCHES = 2  # coordinates by which a node past LEVELS_AIMED branches
MISS = 1e-6
BROADCAST_ROWS = 1_000_000

#: stands for a null id inside the job
NULL_ID = -(1 << 63)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text. Words are runs of anything but space and
    the characters 9 to 13, A-Z lower-cased; their hashes come from one prefix sum over the bytes."""

    def __init__(self, size: int):
        self.size, self.hasher = size, Hasher(41)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = text.encode("utf-8", "surrogatepass").lower() if isinstance(text, str) else b""
        a = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = (a != 32) & ((a < 9) | (a > 13))
        edge = np.flatnonzero(np.diff(inside))
        if not len(edge):
            return np.zeros(0, np.uint64)
        h = self.hasher.of(self.hasher.prefix(a), edge[::2], edge[1::2])
        width = min(self.size, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = mix(out ^ h[k:len(h) - width + 1 + k])
        return np.unique(out)


def sketch_seeds(count: int = SKETCH) -> np.ndarray:
    return np.random.default_rng(17).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The minwise token under each hash function (multiplication by an odd number), 32 bits of it."""
    out = np.empty(len(seeds), np.uint64)
    for k, s in enumerate(seeds):
        out[k] = (shingles * s).min()
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """``ODD_BITS`` parities of the set's counts by the top bits of its hashes. Two sketches differ
    in at most as many bits as the sets do in elements."""
    bins = np.bincount((shingles >> np.uint64(64 - ODD_BITS.bit_length() + 1)).astype(np.int64), minlength=ODD_BITS)
    return np.packbits(bins & 1)


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """``id, h`` (a hash of the text), ``n`` (set size), ``v`` (digest of the set; null for
    an empty one), ``sig`` (its minwise tokens), ``mark`` (a byte of each token, then the odd sketch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        shingles, seeds = Shingler(size), sketch_seeds()
        for pdf in batches:
            n, v, sig, mark = [], [], [], []
            for text in pdf["text"]:
                s = shingles(text)
                n.append(len(s))
                v.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                tokens = sketch(s, seeds) if len(s) else None
                sig.append(tokens.tobytes() if len(s) else None)
                mark.append(tokens.astype(np.uint8).tobytes() + odd_sketch(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "h": pdf["h"], "n": n, "v": v, "sig": sig, "mark": mark})

    return docs.select("id", "h", "text").mapInPandas(run, "id long, h long, n long, v binary, sig binary, mark binary")


def meets(threshold: float) -> float:
    """Least probability that a pair at the threshold shares a node of one tree at every depth."""
    below = 1.0
    for _ in range(MAX_LEVELS - LEVELS_AIMED):
        below = 1.0 - (1.0 - threshold * below) ** BRANCHES
    return threshold ** LEVELS_AIMED * below


def miss_of(threshold: float, trees: int, size: int = SKETCH) -> float:
    """Probability that a pair at the threshold shares no leaf, over the number of its ``size`` tokens that
    agree: all trees draw from the same tokens."""
    return sum(math.comb(size, k) * threshold ** k * (1 - threshold) ** (size - k) * (1.0 - meets(k / size)) ** trees
               for k in range(size + 1))


def trees_for(threshold: float, miss: float = MISS) -> int:
    return next(t for t in range(1, 1 << 16) if miss_of(threshold, t) <= miss)


def least_agreement(threshold: float, size: int = SKETCH, miss: float = MISS) -> int:
    """Agreeing tokens that a pair at the threshold reaches in all but ``miss`` of cases."""
    total = 0.0
    for k in range(size + 1):
        total += math.comb(size, k) * threshold ** k * (1 - threshold) ** (size - k)
        if total > miss:
            return k
    return size


def leaves(vertices: DataFrame, trees: int) -> DataFrame:
    """``node, size, v``: the nodes where branching ended, of two vertices or more. A node ends as
    a leaf, too, when branching keeps most of it together: more levels would not split it."""
    rows = total = vertices.count() * trees
    level = vertices.select("v", F.lit(0).alias("above"), "sig", F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("t"))
    level = level.select("v", "above", F.xxhash64("t", F.expr(f"hex(substring(sig, (t % {SKETCH}) * 4 + 1, 4))")).alias("node"))
    done = []
    for depth in range(1, MAX_LEVELS + 1):
        sizes = sized(level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), rows)
        level = shared_table(sized(level.join(sizes, "node"), rows), "path-nodes")
        ends = F.lit(True) if depth == MAX_LEVELS else \
            (F.col("size") <= LEAF) | (F.col("size") >= STAYS * F.col("above")) & (F.col("above") > 0)
        done.append(level.where(ends).select("node", "size", "v"))
        level = level.where(~ends).select("node", F.col("size").alias("above"), "v")
        rows = level.count()
        if not rows:
            break
        ways = BRANCHES if depth >= LEVELS_AIMED else 1
        rows *= ways
        # the ways of a node go by different coordinates
        picked = F.expr(f"hex(substring(sig, cast(pmod(xxhash64(node, {depth}) + way * {SKETCH // BRANCHES}, {SKETCH}) as int) * 4 + 1, 4))")
        child = F.xxhash64("node", picked) if ways == 1 else F.xxhash64("node", "way", picked)
        level = sized(level.join(vertices.select("v", "sig"), "v"), rows) \
            .withColumn("way", F.explode(F.array(*[F.lit(w) for w in range(ways)]))) \
            .select("v", "above", child.alias("node"))
        total = max(total, rows)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return shared_table(sized(out, total), "path-leaves") if len(done) > 1 else out


def candidate_pairs(leaf: DataFrame, vertices: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs ``a, b`` of vertices that share a leaf, are in different components
    (``root``) and agree in enough tokens. ``forest``: for each vertex of a cell only the most
    alike one before it."""
    x = leaf.join(vertices.select("v", "root", "n", "mark"), "v")
    x = x.withColumn("blocks", F.ceil(F.col("size") / LEAF).cast("int"))
    x = x.withColumn("mine", F.pmod(F.xxhash64("v", "node"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"),
                 (F.col("mine") <= F.col("other")).alias("low"), (F.col("mine") >= F.col("other")).alias("high"),
                 "v", "root", "n", "mark")
    if not forest:
        # a cell whose vertices are of one component holds nothing to find
        split = x.groupBy("cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1")
        x = x.join(split.select("cell"), "cell")
    x = x.repartition("cell").sortWithinPartitions("cell", "v")
    need = least_agreement(percent / 100.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            cells = held["cell"].to_numpy()
            cut = int(np.searchsorted(cells, cells[-1])) if cells[0] != cells[-1] else 0
            if cut:  # the last cell may go on in the next batch
                yield compare_cells(held.iloc[:cut], percent, need, forest)
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None:
            yield compare_cells(held, percent, need, forest)

    return x.mapInPandas(run, "a binary, b binary").distinct()


def compare_cells(rows: pd.DataFrame, percent: int, need: int, forest: bool) -> pd.DataFrame:
    """Exhaustive comparison of the low with the high vertices of each cell by sketch: rows of a
    cell are neighbours, so row ``i`` meets row ``i + 1``, then ``i + 2`` and so on, all cells at once."""
    cell = rows["cell"].to_numpy()
    marks = np.frombuffer(b"".join(rows["mark"]), np.uint8).reshape(len(rows), -1)
    tokens, odd = marks[:, :SKETCH], np.ascontiguousarray(marks[:, SKETCH:]).view(np.uint64)
    v, n = rows["v"].to_numpy(), rows["n"].to_numpy()
    root = np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
    low, high = rows["low"].to_numpy(), rows["high"].to_numpy()
    first, second, score = [], [], []
    i, step = np.arange(len(rows)), 0
    while True:
        step += 1
        i = i[i + step < len(rows)]
        i = i[cell[i + step] == cell[i]]
        if not len(i):
            break
        j = i + step
        ok = (root[i] != root[j]) & (low[i] & high[j] | high[i] & low[j]) & \
            (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        a, b = i[ok], j[ok]
        if len(a):
            # similar enough sets differ in at most this share of their sizes' sum
            apart = np.bitwise_count(odd[a] ^ odd[b]).sum(1, dtype=np.int64)
            ok = apart * (100 + percent) <= (100 - percent) * (n[a] + n[b])
            a, b = a[ok], b[ok]
            same = (tokens[a] == tokens[b]).sum(1)
            near = same >= need
            first.append(a[near])
            second.append(b[near])
            score.append(same[near])
    first, second, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second, score))
    if forest and len(first):  # the most alike partner before each vertex
        order = np.lexsort((-score, second))
        keep = order[np.append(True, np.diff(second[order]) != 0)]
        first, second = first[keep], second[keep]
    return pd.DataFrame({"a": v[first], "b": v[second]})


def confirm(pairs: DataFrame, vertices: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. Texts travel, once for each pair:
    they compress better than sets."""
    pairs = shared_table(sized(pairs, vertices.count(), 20_000), "near-pairs")
    rows = pairs.count()
    ends = sized(pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct(), rows)
    who = shared_table(sized(vertices.select("v", "id", "h").join(ends, "v"), rows), "near-ends")
    texts = docs.select("id", "h", "text").join(broadcast_if(who, who.count(), BROADCAST_ROWS), ["id", "h"])
    texts = shared_table(texts.select("v", "text"), "near-texts")
    x = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a") \
        .join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, last, seen = Shingler(size), None, None
        for pdf in batches:
            ok = []
            for b, ta, tb in zip(pdf["b"], pdf["text_a"], pdf["text_b"]):
                if b != last:
                    last, seen = b, shingles(tb)
                s = shingles(ta)
                both = len(np.intersect1d(s, seen, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(seen) - both))
            yield pdf.loc[ok, ["a", "b"]]

    return shared_table(sized(x.mapInPandas(run, "a binary, b binary").distinct(), rows), "near-links")


def _rooted(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """``vertices`` with ``root``, the least vertex reachable by ``links``."""
    roots = connected_components(links)
    return vertices.drop("root").join(roots, vertices["v"] == roots["vertex"], "left") \
        .select(*[c for c in vertices.columns if c != "root"], F.coalesce("root", "v").alias("root"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, h, text``: a null id gets a stand-in, so that joins need no null-safe keys."""
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.withColumn("h", F.xxhash64("text"))


def _judge(d: DataFrame, size: int, percent: int, every_link: bool = False) -> DataFrame:
    """``id, h, n, component, stays`` for each row of ``d (id, h, text)``; ``component`` is the least id
    of the component, ``stays`` marks its first row by (id, text hash). ``every_link``: all candidate pairs
    are confirmed, and ``n_links`` counts the other rows that are linked to each."""
    sets = shared_table(document_sets(d, size), "near-sets")
    rows = sets.count()
    vertices = sets.where("n > 0").groupBy("v").agg(
        F.min(F.struct("id", "h")).alias("who"), F.first("n").alias("n"), F.first("sig").alias("sig"),
        F.first("mark").alias("mark"))
    vertices = shared_table(sized(vertices, rows, 20_000).select("v", "who.id", "who.h", "n", "sig", "mark"), "near-vertices")
    leaf = leaves(vertices, trees_for(percent / 100.0))
    apart = vertices.withColumn("root", F.col("v"))
    links = confirm(candidate_pairs(leaf, apart, percent, forest=not every_link), vertices, d, size, percent)
    rooted = shared_table(sized(_rooted(vertices.drop("sig"), links), rows, 20_000), "near-rooted")
    if every_link:
        roots = rooted.select("v", "root")
    else:
        rest = confirm(candidate_pairs(leaf, rooted, percent, forest=False), vertices, d, size, percent)
        # what the second round confirms joins components: vertices there are their roots
        at = lambda c: rooted.select(F.col("v").alias(c), F.col("root").alias(f"r{c}"))
        joins = rest.join(at("a"), "a").join(at("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        joins = connected_components(shared_table(sized(joins.distinct(), rest.count()), "near-joins"))
        roots = rooted.select("v", "root").join(joins.select(F.col("vertex").alias("root"), F.col("root").alias("top")),
                                                "root", "left").select("v", F.coalesce("top", "root").alias("root"))
    named = sets.select("id", "h", "n", "v").join(roots, "v", "left")
    counted = []
    if every_link:
        copies = sets.where("n > 0").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
        linked = ends.select(F.col("x.a").alias("to"), F.col("x.b").alias("v")).join(copies, "v") \
            .groupBy(F.col("to").alias("v")).agg(F.sum("c").alias("k"))
        named = named.join(copies, "v", "left").join(linked, "v", "left")
        counted = [(F.coalesce("c", F.lit(1)) - 1 + F.coalesce("k", F.lit(0))).alias("n_links")]
    first = F.min(F.struct((F.col("id") == NULL_ID).alias("none"), "id", "h"))
    named = named.join(named.where("root is not null").groupBy("root").agg(first.alias("first")), "root", "left")
    return named.select(
        "id", "h", "n", F.coalesce("first.id", "id").alias("component"), *counted,
        F.coalesce((F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h")), F.lit(True)).alias("stays"))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id",
                    text_col: str = "text", every_link: bool = False) -> DataFrame:
    """Per input row: ``doc_id, n_shingles, component_id, kept``; with ``every_link`` also ``n_links``, the
    other rows that reach the threshold with it (copies too), which confirms every candidate pair."""
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return _judge(_keyed(docs, id_col, text_col), size, percent, every_link).select(
        real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"), *["n_links"] * every_link)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the first by (id, text hash), once, and
    every row without words."""
    judged = shared_table(_judge(_keyed(docs, id_col, text_col), size, percent), "near-judged")
    gone = judged.where(~F.col("stays")).select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct()
    rows = docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))) \
        .withColumn("_h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.join(broadcast_if(gone, gone.count(), BROADCAST_ROWS), ["_id", "_h"], "left_anti")
    twice = judged.where("stays and n > 0").groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")) \
        .agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_id", "_h")
    if twice.limit(1).count():  # rows that agree in id and text
        repeated = rows.join(twice, ["_id", "_h"]).dropDuplicates(["_id", "_h"])
        rows = rows.join(twice, ["_id", "_h"], "left_anti").unionByName(repeated.select(*rows.columns))
    return rows.select(*docs.columns)
