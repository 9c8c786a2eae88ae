"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of token ids (its documents one after the other). In each
round a queue earns ``window * share`` tokens; what it has earned but not sent is its
deficit, carried to the next round. It sends whole grains of ``GRAIN`` tokens as
soon as the deficit holds one, so after ``r`` rounds a queue has sent
``min(total, GRAIN * floor(r * quantum / GRAIN))`` ids. That closed form is the state of
the round-robin before any round, so every task can go on from any point and the
deficits carry over windows and partitions alike. The rounds, queue by queue,
make one stream, cut every ``window`` ids: a window's mixture is within one grain a
source of the target, and only the very last window is not full.

Steps: one pass tokenises and writes the ids (two bytes each where the vocabulary
allows) with every document's place among the ids of its source in its chunk
of rows; sums by (chunk, source) give the queue offsets; a second pass cuts the
documents at grant and window edges. The ids are shuffled at most once (not at all
while the offsets table is small enough for Spark to broadcast).

Targets default to the sources' natural proportions, which drains all queues
together; other targets leave dry queues out of the later rounds.

Edge cases: a null text is empty and has the end id only; a null source is a
queue of its own; repeated rows are packed as often as they come; sources
without a target get the least target given; an empty table gives no pieces.
Queues are the components of a mixture: more than ``MAX_QUEUES`` sources raise an error.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import shared_table

WINDOW = 4096
GRAIN = 64
END_ID = 2
MAX_QUEUES = 50_000
CHUNK_IDS = 4 << 20
CACHE_WORDS = 350_000


class PlainIds(dict):
    """Lower-case word of Latin letters -> its ids as bytes: the model alone, on the word's
    bytes in the byte-level alphabet."""

    def __init__(self, model, code: str):
        super().__init__()
        self.tokenize, self.code = model.tokenize, code
        # bytes that are no printable Latin-1 character move behind it
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printable)}

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        v = self[word] = array(self.code, [t.id for t in self.tokenize(mapped)]).tobytes() if word else b""
        return v


def _ending_in_marks() -> str:
    """Letters that end in a combining mark once they are lower-cased and composed, as U+0130 and the
    letters that composition leaves apart; a stop behind one joins its mark."""
    letters = (chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha())
    return "".join(c for c in letters if unicodedata.category(unicodedata.normalize("NFC", c.lower())[-1])[0] == "M")


#: looked up once, on the driver; tasks get the letters
JOINED_LETTERS = _ending_in_marks()


class WordIds(dict):
    """word -> its ids as bytes, filled on demand and emptied when it grows too large.

    Tokenizers of this kind drop white space and cut at it, and between letters and
    signs, before anything else, so a text's ids are those of its words in turn. A word
    of Latin letters needs the model alone (its bytes in the byte-level alphabet), any other
    the whole tokenizer, words with combining marks among them (a mark may join the letter before it). A probe text tells whether a tokenizer is of this kind; else, and
    where a text has a special token's brackets, texts are encoded whole."""

    PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([^\w\s'’]*)")  # letters, then signs
    #: marks, and characters newer than Python's tables, which may be marks or letters
    JOINING = frozenset(("Mn", "Mc", "Me", "Cn"))
    SIMPLE = frozenset(" \n.,abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZàâäáãåçèéêëíìîïñóòôöõúùûüßÀÂÄÁÃÅÇÈÉÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜ")
    PROBE = "The Größe, of x's  re-do it... 42nd señor\nÇa va!? $5.00 (AB,cd) naïve. ½ end."

    def __init__(self, tokenizer_path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_path)
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end = array(self.code, [END_ID]).tobytes()
        self.plain = PlainIds(self.tok.model, self.code)
        #: a full stop or comma right after a letter and before white space is a word of its own
        self.stop = re.compile(rf"([.,])(?<=[^\W\d_{JOINED_LETTERS}][.,])(?=[ \n]|$)")
        self.by_word = self._joined(self.PROBE) == self._whole(self.PROBE)

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS // 8:
            self.clear()
        low = word.lower()
        found = self.PLAIN.fullmatch(low) if len(low) == len(word) else None
        if found and not found[2].isascii() and any(unicodedata.category(c) in self.JOINING for c in found[2]):
            found = None
        if found and found[2]:
            v = self.plain[found[1]] + self[found[2]]
        elif found:
            v = self.plain[low]
        else:
            v = array(self.code, self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = v
        return v

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _joined(self, text: str) -> bytes:
        if self.SIMPLE.issuperset(text) and not any(x in text for x in ("..", ".,", ",.", ",,")):
            # every stop and comma is a word of its own, and so is the rest
            text = text.lower().replace(".", " . ").replace(",", " , ").replace("\n", " ")
            return b"".join(map(self.plain.__getitem__, text.split(" ")))
        return b"".join(map(self.__getitem__, self.stop.sub(r" \1", text).replace("\n", " ").split(" ")))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text with the end id."""
        if not text:
            return self.end
        return (self._joined(text) if self.by_word and "<|" not in text else self._whole(text)) + self.end


def tokenise(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, source, chunk, pos, n, ids``: ``pos`` counts the ids of the same source
    earlier in the chunk, a run of rows of about ``CHUNK_IDS`` ids in one task."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                    F.col(source_col).cast("string").alias("source"),
                    F.spark_partition_id().cast("long").alias("part"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds(tokenizer_path)
        chunk, total, seen = 0, 0, {}
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo:lo + 256]
                ids = [words.encode(t if isinstance(t, str) else None) for t in part["text"]]
                sources = [s if isinstance(s, str) else None for s in part["source"]]
                pos = []
                n = [len(x) // words.dtype.itemsize for x in ids]
                for s, k in zip(sources, n):
                    pos.append(seen.get(s, 0))
                    seen[s] = pos[-1] + k
                yield pd.DataFrame({"doc_id": part["doc_id"], "source": sources,
                                    "chunk": part["part"] * (1 << 32) + chunk, "pos": pos,
                                    "n": n, "ids": ids})
                total += sum(n)
                if total > CHUNK_IDS:
                    chunk, total, seen = chunk + 1, 0, {}

    return d.mapInPandas(run, f"doc_id {kind}, source string, chunk long, pos long, n long, ids binary")


class Schedule:
    """The round-robin in closed form over queues ``0..k-1``."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray | None, window: int = WINDOW, grain: int = GRAIN):
        self.window, self.grain = window, grain
        self.totals = np.asarray(totals, np.int64)
        whole = -(-self.totals // grain) * grain
        share = whole if weights is None else np.asarray(weights, float)
        self.quantum = window * (share / share.sum())

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Ids sent by every queue before each round: ``[round, queue]``."""
        earned = np.multiply.outer(rounds.astype(float), self.quantum)
        return np.minimum(self.totals, self.grain * np.floor(earned / self.grain).astype(np.int64))

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cuts many documents, each the ids ``start..start+length`` of its queue, at
        grants and window edges: ``(document, offset, place)`` of every piece, ``place`` being
        its first id's place in the stream."""
        doc, rounds = self._rounds(queue, start, length)
        q = queue[doc]
        before, after = self._own(q, rounds), self._own(q, rounds + 1)
        live = (after > before) & (after > start[doc]) & (before < (start + length)[doc])
        doc, rounds, before, after, q = doc[live], rounds[live], before[live], after[live], q[live]
        begin = np.maximum(before, start[doc])
        end = np.minimum(after, (start + length)[doc])
        place = self._turn(q, rounds) + begin - before
        # window edges inside a piece
        edges = (place + end - begin - 1) // self.window - place // self.window
        part = np.arange(int((edges + 1).sum())) - np.repeat(np.cumsum(edges + 1) - edges - 1, edges + 1)
        doc, begin, place = (np.repeat(x, edges + 1) for x in (doc, begin, place))
        moved = np.where(part > 0, (place // self.window + part) * self.window, place)
        return doc, begin + moved - place - start[doc], moved

    def _rounds(self, queue, start, length) -> tuple[np.ndarray, np.ndarray]:
        """Documents and the rounds that may send some of their ids, flat."""
        q = self.quantum[queue]
        first = np.maximum(0, (start / q).astype(np.int64) - 1)
        last = ((start + length + self.grain) / q).astype(np.int64) + 2
        count = last - first + 1
        rare = count > 4 * length + 64  # one grain of a rare source takes many rounds
        doc = np.repeat(np.flatnonzero(~rare), count[~rare])
        at = np.arange(len(doc)) - np.repeat(np.cumsum(count[~rare]) - count[~rare], count[~rare])
        docs, rounds = [doc], [first[doc] + at]
        for d in np.flatnonzero(rare).tolist():
            marks = np.arange(start[d] // self.grain, (start[d] + length[d]) // self.grain + 2)
            near = (marks * self.grain / q[d]).astype(np.int64)
            r = np.unique(np.concatenate([near - 1, near, near + 1, near + 2]).clip(0))
            docs.append(np.full(len(r), d))
            rounds.append(r)
        return np.concatenate(docs), np.concatenate(rounds)

    def _own(self, q: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        grains = np.floor(rounds.astype(float) * self.quantum[q] / self.grain).astype(np.int64)
        return np.minimum(self.totals[q], self.grain * grains)

    def _turn(self, q: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Ids in the stream before the turn of queue ``q`` in each round: earlier queues
        have had theirs in this round, later ones not. Rounds repeat, so each is summed once."""
        uniq, back = np.unique(rounds, return_inverse=True)
        out = np.empty(len(q), np.int64)
        for lo in range(0, len(uniq), 4096):  # bounded memory for many queues
            part = uniq[lo:lo + 4096]
            now = self.sent(part)
            grants = self.sent(part + 1) - now
            ahead = np.cumsum(grants, axis=1) - grants + now.sum(1, keepdims=True)
            mine = (back >= lo) & (back < lo + 4096)
            out[mine] = ahead[back[mine] - lo, q[mine]]
        return out


def pack(docs: DataFrame, tokenizer_path: str, targets: dict[str, float] | None = None, window: int = WINDOW,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: ``doc_id, source, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids`` (``ids`` as little-endian unsigned 32-bit)."""
    rows = shared_table(tokenise(docs, tokenizer_path, id_col, text_col, source_col), "pack-ids")
    sums = shared_table(rows.groupBy("source", "chunk").agg(F.sum("n").alias("n")), "pack-sums")
    per_source = sums.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_QUEUES + 1).collect()
    if len(per_source) > MAX_QUEUES:
        raise ValueError(f"more than {MAX_QUEUES} sources: map them to mixture components first")
    per_source.sort(key=lambda r: (r.source is not None, r.source or ""))
    names = [r.source for r in per_source]
    weights = None
    if targets and names:
        least = min(targets.values())
        weights = np.array([targets.get(s, least) for s in names])
    schedule = Schedule(np.array([r.n for r in per_source]), weights, window) if names else None
    number = {s: k for k, s in enumerate(names)}

    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null"),
                          "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = rows.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull()) \
        .join(offsets, ["_s", "_null", "chunk"]) \
        .select("doc_id", "source", (F.col("before") + F.col("pos")).alias("at"), "n", "ids")
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            queue = np.array([number[s if isinstance(s, str) else None] for s in pdf["source"]])
            length = pdf["n"].to_numpy()
            doc, begin, place = schedule.pieces(queue, pdf["at"].to_numpy(), length)
            order = np.lexsort((begin, doc))
            doc, begin, place = doc[order], begin[order], place[order]
            end = np.append(begin[1:], 0)
            final = np.append(doc[1:] != doc[:-1], True)
            end[final] = length[doc[final]]
            ids = [np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes() for raw, n in zip(pdf["ids"], length)]
            parts = [ids[d][4 * a:4 * b] for d, a, b in zip(doc.tolist(), begin.tolist(), end.tolist())]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[doc], "source": pdf["source"].to_numpy()[doc],
                                "start": begin, "length": end - begin, "ids_crc32": [zlib.crc32(p) for p in parts],
                                "doc_tokens": length[doc], "sequence_id": place // window, "offset": place % window,
                                "ids": parts})

    return placed.mapInPandas(cut, f"doc_id {kind}, source string, start long, length long, ids_crc32 long, "
                                   "doc_tokens long, sequence_id long, offset long, ids binary")
