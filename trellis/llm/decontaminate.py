"""Benchmark decontamination with suffix arrays of the training text.

The training documents are cut into shards (the row batches of a task). For each
shard a suffix array is built over its words, every suffix of every benchmark item is
binary-searched in it, word by word, which narrows an interval of the array, and
the intervals give the longest verbatim match of each suffix and all its places.
A place whose match is a whole window (``WINDOW`` words, or the whole item, if
it is shorter) is a hit; documents with a hit are affected.

The array is sparse: words that no item has cannot be matched, so a shard keeps only
its maximal runs of benchmark words that are long enough for the shortest window.
Every suffix that can start a reportable match is in such a run.

Scale: one map over the documents, no shuffle. The benchmark is a given test set:
it is read in blocks of at most ``BLOCK_WORDS`` words, one broadcast and one
pass of the chain for each, so a worker holds one block and one shard. A batch
of very long documents is cut into shards of ``SHARD_WORDS`` words.

Edge cases: null and empty texts have no words and are clean; an item without
words is in no window; a null item id counts as the text ''; repeated documents
are judged alike, repeated items count as many times as they have ids; without a
benchmark all is clean; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
BLOCK_WORDS = 4_000_000
SHARD_WORDS = 2_000_000

# a word character is 0-9, a-z or beyond ASCII; A-Z become a-z, the rest a space
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
               for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if isinstance(text, str) else []


class Benchmark:
    """A block of items as word numbers, with all their suffixes."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.items = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        texts = [[self.number.setdefault(w, len(self.number) + 1) for w in ws] for _, ws in items]
        lengths = np.array([len(t) for t in texts], np.int64)
        self.words = np.array([w for t in texts for w in t], np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        pos = np.arange(len(self.words)) - first[owner] if len(texts) else np.zeros(0, np.int64)
        self.owner = owner
        self.left = lengths[owner] - pos  # words from a suffix's start to its item's end
        self.need = np.minimum(window, lengths)[owner]  # the length of this item's windows
        self.longest = int(lengths.max()) if len(lengths) else 0
        self.shortest = int(np.minimum(window, lengths).min()) if len(lengths) else 0


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes, exact for the first
    ``depth`` words (prefix doubling; 0 ends a run and sorts first)."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    span, n = 1, len(text)
    while True:
        nxt = np.zeros(n, np.int64)
        if span < n:
            nxt[:-span] = rank[span:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        if span * 2 >= depth:
            return order
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        span *= 2


def search(text: np.ndarray, order: np.ndarray, bench: Benchmark) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """All benchmark suffixes in the suffix array at once, a word deeper in each
    step. Yields ``(depth, low, high, suffixes)``: the array interval whose places agree
    with these suffixes for ``depth`` words, once it is a window of theirs or longer."""
    m, n = len(bench.words), len(order)
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    padded = np.append(text, np.zeros(bench.longest + 1, np.int64))
    live = np.arange(m)
    for depth in range(bench.longest):
        live = live[bench.left[live] > depth]
        if not len(live):
            return
        word = bench.words[live + depth]
        a = _bound(padded, order, lo[live], hi[live], depth, word)
        b = _bound(padded, order, a, hi[live], depth, word + 1)
        ok = b > a
        live = live[ok]
        lo[live], hi[live] = a[ok], b[ok]
        whole = live[bench.need[live] <= depth + 1]
        if len(whole):
            key = lo[whole] * (n + 1) + hi[whole]
            by = np.argsort(key, kind="stable")
            for part in np.split(whole[by], np.flatnonzero(np.diff(key[by])) + 1):
                yield depth + 1, int(lo[part[0]]), int(hi[part[0]]), part


def _bound(padded, order, lo, hi, depth, word):
    """Lower bound of ``word`` among the words at ``depth`` in each interval."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        less = padded[order[mid] + depth] < word[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]


def shard_matches(docs: list[np.ndarray], bench: Benchmark) -> list[tuple[np.ndarray, list[int], int]]:
    """For each document (word numbers, 0 for words no item has): hit words as a
    mask, items with a window in it, and the longest verbatim match."""
    out = [(np.zeros(len(d), bool), set(), 0) for d in docs]
    text, place, owner = [], [], []
    for k, d in enumerate(docs):
        inside = np.concatenate([[0], (d > 0).view(np.int8), [0]])
        edge = np.flatnonzero(np.diff(inside))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= bench.shortest:
                text += [d[a:b], _ZERO]
                place += [np.arange(a, b + 1)]
                owner += [(k, b - a + 1)]
    if not text:
        return [(h, [], 0) for h, _, _ in out]
    text = np.concatenate(text)
    place = np.concatenate(place)
    owner = np.repeat([k for k, _ in owner], [c for _, c in owner])
    order = suffix_array(text, bench.longest)
    best = np.zeros(len(docs), np.int64)
    for depth, lo, hi, suffixes in search(text, order, bench):
        at = order[lo:hi]
        who = owner[at]
        best[who] = depth  # depths only grow
        exact = suffixes[bench.need[suffixes] == depth]
        if len(exact):  # the places of a window
            items = set(bench.owner[exact].tolist())
            for k, p in zip(who.tolist(), place[at].tolist()):
                out[k][0][p:p + depth] = True
                out[k][1].update(items)
    return [(h, sorted(i), int(b)) for (h, i, _), b in zip(out, best)]


_ZERO = np.zeros(1, np.int64)


def read_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list[Benchmark]:
    """The benchmark in blocks of at most ``BLOCK_WORDS`` words (at least one item each)."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"),
                            F.col(text_col).alias("t")).orderBy("i", "t").toLocalIterator()
    blocks, block, size = [], [], 0
    for r in rows:
        ws = words(r.t)
        if not ws:
            continue
        if block and size + len(ws) > BLOCK_WORDS:
            blocks.append(Benchmark(block, window))
            block, size = [], 0
        block.append((r.i, ws))
        size += len(ws)
    return [*blocks, Benchmark(block, window)] if block else blocks


MATCH = "n_words long, hits array<long>, items array<string>, longest long"


def match_column(benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, item_col: str = "item_id",
                 item_text_col: str = "text") -> Column:
    """For each row's text ``struct<n_words, hits, items, longest>``: ``hits`` are the starts
    and ends of the runs of hit words, ``items`` the item ids as text, sorted, ``longest`` the words
    of the longest verbatim match. Only the text goes to Python."""
    context = benchmark.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in read_blocks(benchmark, item_col, item_text_col, window)]

    @F.pandas_udf(MATCH)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out, shard, size = [], [], 0
            texts = texts.tolist()
            for k, text in enumerate(texts):
                shard.append(words(text))
                size += len(shard[-1])
                if size >= SHARD_WORDS or k == len(texts) - 1:
                    for n, h, items, longest in _judge(shard, [x.value for x in blocks]):
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], h.view(np.int8), [0]])))
                        out.append((n, edge.tolist(), items, longest))
                    shard, size = [], 0
            yield pd.DataFrame(out, columns=["n_words", "hits", "items", "longest"])

    return run(F.col(text_col))


def match(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          window: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document row: ``id_col, n_words, hits, items, longest``."""
    found = match_column(benchmark, text_col, window, item_col, item_text_col)
    return docs.select(F.col(id_col), found.alias("match")).select(id_col, "match.*")


def _judge(shard: list[list[bytes]], blocks: list[Benchmark]) -> list[tuple[int, np.ndarray, list[str], int]]:
    total = [(len(ws), np.zeros(len(ws), bool), set()) for ws in shard]
    best = [0] * len(shard)
    for bench in blocks:
        get = bench.number.get
        numbers = [np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)) for ws in shard]
        for k, (h, i, longest) in enumerate(shard_matches(numbers, bench)):
            total[k][1][:] |= h
            total[k][2].update(bench.items[x] for x in i)
            best[k] = max(best[k], longest)
    return [(n, m, sorted(i), b) for (n, m, i), b in zip(total, best)]


def digest(matched: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result columns of the query from ``match``'s rows."""
    n_hit = F.aggregate(F.transform("hits", lambda v, i: F.when(i % 2 == 0, -v).otherwise(v)), F.lit(0).cast("long"),
                        lambda a, v: a + v)
    return matched.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                          F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                          (F.size("hits") > 0).alias("contaminated"), "longest")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a benchmark window."""
    return docs.where(F.size(match_column(benchmark, text_col, window)["hits"]) == 0)
