"""Removal of long repeated byte strings by prefix-free parsing.

A byte is removed if a string of ``LENGTH`` bytes that covers it starts anywhere else
in the corpus, too. Windows (strings of that length) are not looked at one by one:

* Parsing. A rolling hash of 8 bytes marks triggers, whose places depend on the
  bytes alone, so equal strings are parsed alike (strong triggers, and weaker ones
  where no strong one is near). A window belongs to the first trigger in it; the
  windows of one trigger occurrence are a *phrase*: the bytes from its first
  window's start to its last window's end.
* Dictionary. Phrases are named by 64-bit hashes of their core (the ``CORE`` bytes after
  the trigger, which all windows of the phrase have in common) and of the whole
  phrase with its trigger's place. Names instead of sorted ranks suffice, as only
  equality for ``LENGTH`` bytes counts, not the order of unequal suffixes.
* Parse. Cores are counted over the corpus. A core that occurs once has no repeated
  window; if all phrases of a core are equal, all their windows are repeated.
  Only where phrases share a core but differ (the ends of repeated passages, and
  shared passages that are too short) their windows are looked at, once for each
  distinct phrase: first strings of ``LENGTH - GRID`` bytes at every ``GRID``-th place
  before the trigger, of which each window holds one; then, one by one, the windows
  whose string occurs in another phrase, too.
* Windows without any trigger (texts of a very short period) are compared directly.
  Those that are equal within a batch are repeated for sure and leave as ranges, with one
  of each kind for the comparison with other batches.

Scale: phrases are about one for a hundred bytes and travel as fixed-size rows; counts
are summed before the shuffle; a frequent passage is a frequent *core name*, summed
by partial aggregation and joined with AQE's skew splitting, never one task's
list. Texts are only shuffled if the ranges to remove outgrow a checked broadcast.

Edge cases: null and short texts lose nothing; repeated rows are repeats of each
other; an invalid place never arises as offsets count UTF-8 bytes; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import broadcast_if, forget, shared_table
from trellis.llm.hashing import Hasher, mix

LENGTH = 400
TRIGGER = 8
STRONG_BITS, WEAK_BITS = 7, 5
CORE = 64
GRID = 30
BROADCAST_ROWS = 400_000

#: kinds of rows: a phrase, a window without trigger, a range that is repeated for sure
PHRASE, LOOSE, SURE = 0, 1, 2
#: stands for a null id inside the job
NULL_ID = -(1 << 63)


def triggers(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strong and of the weak triggers (strong ones are weak, too)."""
    n = len(raw) - TRIGGER + 1
    h = mix(np.ndarray((n,), "<u8", raw, strides=(1,)))
    weak = np.flatnonzero(h >> np.uint64(64 - WEAK_BITS) == 0)
    return weak[h[weak] >> np.uint64(64 - STRONG_BITS) == 0], weak


def phrases(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """``trigger, first, last``: the windows starting at ``first..last`` (inclusive) belong to the
    trigger occurrence; and the ranges of window starts that have no trigger."""
    reach = LENGTH - CORE  # a window's trigger starts at most this far in
    end = len(raw) - LENGTH  # the last window's start
    strong, weak = triggers(raw)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    gaps = _claim(strong, 0, end, reach, out)
    none: list[tuple[int, int]] = []
    for a, b in gaps:
        lo = np.searchsorted(weak, a)
        none += _claim(weak[lo:np.searchsorted(weak, b + reach, side="right")], a, b, reach, out)
    t, first, last = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
    return t, first, last, none


def _claim(marks: np.ndarray, a: int, b: int, reach: int, out: list) -> list[tuple[int, int]]:
    """Deal the window starts ``a..b`` to the first mark within reach; returns what is left."""
    if not len(marks):
        return [(a, b)] if b >= a else []
    before = np.concatenate([[a], marks[:-1] + 1])
    first = np.maximum(np.maximum(before, marks - reach), a)
    last = np.minimum(marks, b)
    ok = first <= last
    out.append((marks[ok], first[ok], last[ok]))
    gap = np.flatnonzero(first > np.maximum(before, a))
    left = [(int(max(before[k], a)), int(min(first[k] - 1, b))) for k in gap.tolist()]
    tail = max(int(marks[-1]) + 1, a)
    return [(x, y) for x, y in [*left, (tail, b)] if x <= y]


#: texts and characters that are worked on, and handed on, at once
PART_TEXTS, PART_CHARS = 256, 1 << 21


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A batch in parts of at most ``PART_TEXTS`` rows and, but for a longer text, ``PART_CHARS`` characters."""
    for pdf in batches:
        size = pdf["text"].str.len().to_numpy()
        start = 0
        while start < len(pdf):
            end = start + 1 + int(np.searchsorted(np.cumsum(size[start + 1:start + PART_TEXTS]), PART_CHARS - size[start], side="right"))
            yield pdf.iloc[start:end].reset_index(drop=True)
            start = end


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    core_hash, full_hash = Hasher(23), Hasher(29)
    for pdf in _parts(batches):
        cols: list[list] = [[] for _ in range(6)]
        loose: dict[tuple[int, int], list] = {}
        for doc, text in enumerate(pdf["text"].tolist()):
            raw = text.encode("utf-8", "surrogatepass")
            if len(raw) < LENGTH:
                continue
            t, first, last, none = phrases(raw)
            a = np.frombuffer(raw, np.uint8)
            pc, pf = core_hash.prefix(a), full_hash.prefix(a)
            core = core_hash.of(pc, t, t + CORE)
            place = ((t - first) * LENGTH + (last - t + LENGTH)).astype(np.uint64)
            full = mix(full_hash.of(pf, first, last + LENGTH) ^ place * np.uint64(0x9E3779B97F4A7C15))
            for c, v in zip(cols, (core, full, np.full(len(t), doc), t, first, last)):
                c.append(v)
            for x, y in none:
                at = np.arange(x, y + 1)
                for w1, w2, i in zip(core_hash.of(pc, at, at + LENGTH).tolist(),
                                     full_hash.of(pf, at, at + LENGTH).tolist(), at.tolist()):
                    loose.setdefault((w1, w2), []).append((doc, i))
        core, full, doc, t, first, last = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
        doc, t, first, last = (x.astype(np.int64) for x in (doc, t, first, last))
        yield _rows(pdf, core.astype(np.uint64), full.astype(np.uint64), doc, t, first, last, PHRASE)
        if loose:
            w1, w2 = (np.array(x, np.uint64) for x in zip(*loose))
            d, i = (np.array(x, np.int64) for x in zip(*(places[0] for places in loose.values())))
            yield _rows(pdf, w1, w2, d, i, i, i, LOOSE)
            twice = sorted(p for places in loose.values() if len(places) > 1 for p in places)
            if twice:
                d, i = (np.array(x, np.int64) for x in zip(*twice))
                cut = np.flatnonzero((np.diff(d) != 0) | (np.diff(i) != 1) | (np.diff(i >> 19) != 0)) + 1
                a, b = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(d) - 1]])
                zero = np.zeros(len(a), np.uint64)
                yield _rows(pdf, zero, zero, d[a], i[a], i[a], i[b], SURE)


def _rows(pdf, core, full, doc, t, first, last, kind: int) -> pd.DataFrame:
    # trigger, its distance from the first and to the last window in one number; the kind in the core's low bits
    place = (t << 20) | (t - first << 10) | (t - last) if kind != SURE else (t << 20) | (last - first)
    core = (core & ~np.uint64(3)) | np.uint64(kind)
    return pd.DataFrame({"core": core.view(np.int64), "full": full.view(np.int64), "id": pdf["id"].to_numpy()[doc],
                         "h": pdf["h"].to_numpy()[doc], "place": place})


def _windows_of(place):
    """First and last window start of a phrase or a single window."""
    t = F.shiftright(place, 20)
    return (t - F.shiftright(place, 10).bitwiseAND(F.lit(1023))).alias("first"), \
        (t - place.bitwiseAND(F.lit(1023))).alias("last")


def _strings(step: int, length: int):
    """Names of strings of the phrases in ``need`` (core, full, place, marks) of each text: with
    ``step`` > 1 the grid strings, else the windows whose grid place is in ``marks``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = Hasher(31), Hasher(37)
        for pdf in _parts(batches):
            cols: list[list] = [[] for _ in range(5)]
            for text, need in zip(pdf["text"], pdf["need"]):
                a = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                p1, p2 = one.prefix(a), two.prefix(a)
                for x in need:
                    t = x["place"] >> 20
                    far, near = x["place"] >> 10 & 1023, x["place"] & 1023
                    if step > 1:
                        back = np.arange(near // step, far // step + 1) * step
                    else:
                        back = np.concatenate([np.arange(max(near, m), min(far, m + GRID - 1) + 1) for m in x["marks"]])
                    at = t - back
                    for c, v in zip(cols, (one.of(p1, at, at + length), two.of(p2, at, at + length),
                                           np.full(len(at), x["core"]), np.full(len(at), x["full"]), back)):
                        c.append(v)
            if cols[0]:
                w1, w2, core, full, back = (np.concatenate(c) for c in cols)
                # the place before the trigger is part of the name
                w1 = mix(w1 ^ back.astype(np.uint64))
                yield pd.DataFrame({"w1": w1.view(np.int64), "w2": w2.view(np.int64), "core": core, "full": full, "back": back})

    return run


def _shared_strings(d: DataFrame, need: DataFrame, step: int, length: int, name: str) -> DataFrame:
    """``core, full, back`` (a sorted list) of the strings that another phrase has at the same place."""
    need = shared_table(need.groupBy("id", "h").agg(F.collect_list(F.struct(
        *[c for c in need.columns if c not in ("id", "h")])).alias("need")), f"{name}-need")
    texts = d.join(broadcast_if(need, need.count(), BROADCAST_ROWS), ["id", "h"]).select("text", "need")
    found = shared_table(texts.mapInPandas(_strings(step, length), "w1 long, w2 long, core long, full long, back int"), name)
    same = found.groupBy("w1", "w2").agg(F.min("full").alias("f0"), F.max("full").alias("f1")).where("f0 != f1")
    backs = shared_table(found.join(same.select("w1", "w2"), ["w1", "w2"]).groupBy("core", "full").agg(
        F.sort_array(F.collect_set("back")).alias("back")), f"{name}-backs")
    forget(found)
    forget(need)
    return backs


def repeated_windows(d: DataFrame) -> DataFrame:
    """``id, h, first, last``: ranges of window starts whose windows are repeated, for ``d (id, h, text)``."""
    rows = shared_table(d.mapInPandas(_parse, "core long, full long, id long, h long, place long"), "repeat-phrases")
    kind = F.col("core").bitwiseAND(F.lit(3))
    # a core's phrases: how many, and whether they are all equal
    cores = rows.where(kind != SURE).groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("full").alias("f0"),
                                                         F.max("full").alias("f1")).where("n > 1")
    shared = shared_table(rows.join(cores.select("core", (F.col("f0") == F.col("f1")).alias("equal")), "core"),
                          "repeat-shared")
    ranges = _windows_of(F.col("place"))
    certain = rows.where(kind == SURE).select("id", "h", F.shiftright("place", 20).alias("first"), (
        F.shiftright("place", 20) + F.col("place").bitwiseAND(F.lit((1 << 20) - 1))).alias("last"))
    certain = shared_table(certain, "repeat-certain")
    forget(rows)
    sure = shared.where("equal").select("id", "h", *ranges).unionByName(certain)
    mixed = shared.where(~F.col("equal"))
    names = shared_table(mixed.groupBy("core", "full").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "place")).alias("at")), "repeat-names")
    twice = mixed.join(names.where("n > 1").select("core", "full"), ["core", "full"]).select("id", "h", *ranges)
    need = names.where(kind == PHRASE).select("at.id", "at.h", "core", "full", "at.place")
    marks = _shared_strings(d, need, GRID, LENGTH - GRID, "repeat-grid").withColumnRenamed("back", "marks")
    found = _shared_strings(d, need.join(marks, ["core", "full"]), 1, LENGTH, "repeat-windows")
    single = mixed.join(names.where((F.col("n") == 1) & (kind == PHRASE)).select("core", "full"), ["core", "full"])
    edges = single.join(found, ["core", "full"]).select("id", "h", "place", F.explode("back").alias("b")) \
        .select("id", "h", (F.shiftright("place", 20) - F.col("b")).alias("first"))
    return sure.unionByName(twice).unionByName(edges.withColumn("last", F.col("first")))


def merge_ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte runs ``[start, end)`` covered by the windows that start in ``first..last``."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate(last[order] + LENGTH)
    cut = np.flatnonzero(a[1:] > b[:-1]) + 1
    return a[np.concatenate([[0], cut])], b[np.concatenate([cut - 1, [len(b) - 1]])]


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _parts(batches):
        out = []
        for text, first, last in zip(pdf["text"], pdf["first"], pdf["last"]):
            raw = text.encode("utf-8", "surrogatepass")
            kept, spans = raw, []
            if first is not None and len(first):
                a, b = merge_ranges(np.asarray(first, np.int64), np.asarray(last, np.int64))
                spans = list(zip(a.tolist(), b.tolist()))
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
            out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                        [x for s in spans for x in s]))
        got = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        got.insert(0, "id", pdf["id"].to_numpy())
        yield got


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (starts and
    ends of the removed runs)."""
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("id", F.xxhash64("text").alias("h"), "text")
    ranges = repeated_windows(d).distinct().groupBy("id", "h").agg(F.collect_list("first").alias("first"),
                                                                   F.collect_list("last").alias("last"))
    ranges = shared_table(ranges, "repeat-ranges")
    x = d.join(broadcast_if(ranges, ranges.count(), BROADCAST_ROWS), ["id", "h"], "left").select("id", "text", "first", "last")
    out = x.mapInPandas(_strip, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"),
                      "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
