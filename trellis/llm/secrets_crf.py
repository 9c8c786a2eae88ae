"""Secret scan: exact base patterns, widened by a linear-chain CRF.

A text is cut into tokens; every token is tagged B (a secret begins), I (goes
on) or O. The emission score of a tag is linear in features of the token's
shape, of its neighbours (two before, one after) and of the file; transitions
are learned too. Weights come from conditional maximum likelihood
(forward-backward in numpy) on windows around base matches and on random windows,
and Viterbi decodes whole texts.

Decoding is exact but cheap. A run of tags other than O can be in the best path only if
it beats tagging all of it O, so its tokens' gains (over O, with the dearest inner
transition added) sum to at least a constant. Texts in which no stretch does have no
span; elsewhere Viterbi runs over the stretches that do.

Scale: the scan is a map over documents without a shuffle. Training reads a
sample of at most ``2 * TRAIN_DOCS`` documents (hash order) of which windows of
class numbers, never texts, reach the driver. A worker holds one Arrow batch.

Edge cases: null text is empty and has no spans; repeated rows each get a
result; a corpus without a base match trains nothing and adds no spans; an
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import hash_sample

# The base patterns with the fewest characters that count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is the whole run
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "crf")

TRAIN_DOCS = 700
WINDOW = 24
WINDOWS_PER_DOC = 3
TOKEN = re.compile(r"[^\W_][\w+/.-]*|[^\w\s]|_+")
MIN_CRF_CHARS = 12  # a span of the model has this many characters and a digit

FEATURES = 19
_HEX_WORD = re.compile("[0-9a-f]+")
O, B, I = 0, 1, 2  # noqa: E741
OFFSETS = (0, -1, -2, 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base matches, sorted; code points."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _secret_part(text: str, span: tuple[int, int, int]) -> tuple[int, int]:
    """The characters of a base match that are secret: the value of an assignment, else all."""
    start, kind, end = span
    return (ASSIGN.match(text, start).start(2), end) if kind == 0 else (start, end)


def token_features(tok: str) -> int:
    """Shape features of a token as the bits of its class number."""
    n = len(tok)
    low = tok.lower()
    if n > 1 and tok.isalpha():  # a plain word, by far the commonest: no digit, no sign
        f = (n >= 6) | (n >= 12) << 1 | (n >= 20) << 2 | (n >= 32) << 3
        return f | (n >= 8 and _HEX_WORD.fullmatch(low) is not None) << 12 | (low in KEYWORDS) << 15
    digits = sum(c.isdigit() for c in tok)
    upper = sum("A" <= c <= "Z" for c in tok)
    lower = sum("a" <= c <= "z" for c in tok)
    kinds = [c.isdigit() for c in tok]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    f = (n >= 6, n >= 12, n >= 20, n >= 32, digits > 0, 0 < digits < n, digits * 4 >= n, digits == n,
         upper > 0 and lower > 0 and digits > 0, upper == 0 and lower > 0 and digits > 0,
         upper > 0 and lower == 0 and digits > 0, changes >= 3, n >= 8 and _HEX_WORD.fullmatch(low) is not None,
         tok in "=:", tok in "\"'`", low in KEYWORDS, any(c in "+/_-" for c in tok) and digits > 0,
         "." in tok, n == 1 and not tok.isalnum())
    return sum(1 << i for i, x in enumerate(f) if x)


class TokenClasses(dict):
    """token -> class; filled on demand, emptied when it grows past ``most``."""

    most = 300_000

    def __missing__(self, tok: str) -> int:
        if len(self) >= self.most:
            self.clear()
        v = self[tok] = token_features(tok)
        return v


def _bits(classes: np.ndarray) -> np.ndarray:
    return (classes[:, None] >> np.arange(FEATURES) & 1).astype(np.float64)


def file_features(n_tokens: int, n_digit: int, has_key: bool) -> np.ndarray:
    return np.array([1.0, float(has_key), min(1.0, 20.0 * n_digit / max(1, n_tokens))])


class Crf:
    """Weights: ``w[offset, tag, feature]``, ``f[tag, file feature]``, ``t[tag, tag]``; tag O scores 0."""

    def __init__(self, w: np.ndarray, f: np.ndarray, t: np.ndarray):
        self.w, self.f, self.t = w, f, t

    @classmethod
    def untrained(cls) -> Crf:
        f = np.zeros((3, 3))
        f[1:, 0] = -20.0
        return cls(np.zeros((len(OFFSETS), 3, FEATURES)), f, np.zeros((3, 3)))

    @classmethod
    def train(cls, windows: np.ndarray, tags: np.ndarray, file: np.ndarray, steps: int = 100, l2: float = 5e-4,
              rate: float = 0.15) -> Crf:
        """Adam on the mean conditional log-likelihood of equally long windows."""
        m = cls(np.zeros((len(OFFSETS), 3, FEATURES)), np.zeros((3, 3)), np.zeros((3, 3)))
        n, length = tags.shape
        feats = _window_features(windows).reshape(n * length, -1)  # one row a token
        gold = np.eye(3)[tags]
        # transitions that cannot be: O to I, and I at the start (held at a large penalty)
        barred = np.zeros((3, 3))
        barred[O, I] = -30.0
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (m.w, m.f, m.t)]
        gold_t = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
        for step in range(1, steps + 1):
            flat = m.w.transpose(0, 2, 1).reshape(-1, 3)
            e = (feats @ flat).reshape(n, length, 3) + (file @ m.f.T)[:, None, :]
            e[:, 0, I] -= 30.0
            t = m.t + barred
            al, be = np.empty_like(e), np.zeros_like(e)
            al[:, 0] = e[:, 0]
            for k in range(1, length):
                al[:, k] = _lse(al[:, k - 1][:, :, None] + t, 1) + e[:, k]
            for k in range(length - 2, -1, -1):
                be[:, k] = _lse(t + (e[:, k + 1] + be[:, k + 1])[:, None, :], 2)
            z = _lse(al[:, -1], 1)
            diff = gold - np.exp(al + be - z[:, None, None])
            pair = np.exp(al[:, :-1, :, None] + t + (e[:, 1:] + be[:, 1:])[:, :, None, :] - z[:, None, None, None])
            by_w = (feats.T @ diff.reshape(-1, 3)).reshape(len(OFFSETS), FEATURES, 3).transpose(0, 2, 1)
            grads = (by_w / n - l2 * m.w,
                     np.einsum("nlt,nf->tf", diff, file) / n - l2 * m.f, (gold_t - pair.sum((0, 1))) / n - l2 * m.t)
            for p, g, (a, b) in zip((m.w, m.f, m.t), grads, state):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p += rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)
        m.w -= m.w[:, :1].copy()
        m.f -= m.f[:1].copy()
        m.t += barred
        return m

    def decoder(self) -> Decoder:
        return Decoder(self)


class Decoder:
    """Viterbi over whole texts; emission scores by token class are cached."""

    def __init__(self, crf: Crf):
        self.crf, self.index = crf, {}
        self.rows = np.zeros((0, len(OFFSETS), 3))
        t = crf.t
        self.inner = float(t[1:, 1:].max() - t[O, O])
        self.least = -float(t[O, B] + t[1:, O].max() - t[1:, 1:].max() - t[O, O])

    def tags(self, classes: np.ndarray, file: np.ndarray) -> dict[int, int]:
        """Tags other than O by position."""
        uniq, pos = np.unique(classes, return_inverse=True)
        fresh = [c for c in uniq.tolist() if c not in self.index]
        if fresh:
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
            self.rows = np.concatenate([self.rows, np.einsum("cf,otf->cot", _bits(np.array(fresh)), self.crf.w)])
        own = self.rows[[self.index[c] for c in uniq.tolist()]][pos]  # token, offset, tag
        e = own[:, 0] + self.crf.f @ file
        e[1:] += own[:-1, 1]
        e[2:] += own[:-2, 2]
        e[:-1] += own[1:, 3]
        gain = e[:, 1:].max(1) - e[:, 0] + self.inner
        if gain.max() < min(0.0, self.least):
            return {}
        ends, starts = _best_sums(gain.tolist()), _best_sums(gain[::-1].tolist())[::-1]
        open_ = np.flatnonzero(ends + starts - gain >= self.least - 1e-9)
        out: dict[int, int] = {}
        if len(open_):
            for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                for k, tag in zip(part.tolist(), self._viterbi(e[part])):
                    if tag != O:
                        out[k] = tag
        return out

    def _viterbi(self, e: np.ndarray) -> list[int]:
        """Best tags of a stretch with O on both sides (or the text's ends)."""
        t = self.crf.t
        score, back = t[O] + e[0], []
        for row in e[1:]:
            step = score[:, None] + t
            back.append(step.argmax(0))
            score = step.max(0) + row
        k = int((score + t[:, O]).argmax())
        tags = [k]
        for b in reversed(back):
            k = int(b[k])
            tags.append(k)
        return tags[::-1]


def _best_sums(gains: list[float]) -> np.ndarray:
    """Largest sum of a stretch that ends at each place."""
    out, at = [], 0.0
    for g in gains:
        at = g + max(0.0, at)
        out.append(at)
    return np.array(out)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _window_features(windows: np.ndarray) -> np.ndarray:
    """Classes ``[window, token]`` -> bits ``[window, token, offset, feature]``; outside of the window no bit is set."""
    n, length = windows.shape
    bits = _bits(windows.reshape(-1)).reshape(n, length, FEATURES)
    out = np.zeros((n, length, len(OFFSETS), FEATURES))
    for k, off in enumerate(OFFSETS):
        src = slice(max(0, off), length + min(0, off))
        dst = slice(max(0, -off), length - max(0, off))
        out[:, dst, k] = bits[:, src]
    return out


def tokenise(text: str, classes: TokenClasses) -> tuple[np.ndarray, np.ndarray]:
    toks = TOKEN.findall(text)
    c = np.fromiter(map(classes.__getitem__, toks), dtype=np.int64, count=len(toks))
    return c, file_features(len(c), int((c >> 4 & 1).sum()), any(k in text.lower() for k in KEYWORDS))


def _training_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of classes and tags: around base matches, and one by one through the text elsewhere."""
    classes = TokenClasses()
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            c, file = tokenise(text, classes)
            if not len(c):
                continue
            tags = np.zeros(len(c), np.int64)
            starts = np.fromiter((m.start() for m in TOKEN.finditer(text)), np.int64, len(c))
            ends = np.append(starts[1:], len(text) + 1)
            hits = []
            for span in base_spans(text):
                a, b = _secret_part(text, span)
                inside = np.flatnonzero((starts >= a) & (starts < b) | (starts < a) & (ends > a) & (a > starts))
                inside = inside[starts[inside] >= a]
                if len(inside):
                    tags[inside], tags[inside[0]] = I, B
                    hits.append(int(inside[0]))
            digit = np.flatnonzero(c >> 4 & 1).tolist()
            places = hits[:WINDOWS_PER_DOC - 1] + (digit[len(digit) // 2:][:1] or [len(c) // 3])
            for p in places[:WINDOWS_PER_DOC]:
                lo = max(0, min(p - WINDOW // 2, len(c) - WINDOW))
                w, t = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
                part = c[lo:lo + WINDOW]
                w[:len(part)], t[:len(part)] = part, tags[lo:lo + WINDOW]
                out.append((w.tolist(), t.tolist(), file.tolist()))
        yield pd.DataFrame(out, columns=["w", "t", "f"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAIN_DOCS) -> Crf:
    """A CRF from at most about ``bound`` documents with a trace of a secret and ``bound`` others."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low = F.lower("text")
    trace = F.col("text").contains("AKIA") | F.col("text").rlike("[0-9a-f]{24}")
    for k in ("passw", "secret", "token", "api"):
        trace = trace | low.contains(k)
    key = F.xxhash64("id", F.length("text"))
    near = hash_sample(d.where(trace), key, bound)
    other = hash_sample(d, key, bound, seed=11)
    rows = near.unionByName(other).select("text").mapInPandas(
        _training_rows, "w array<long>, t array<long>, f array<double>").toPandas()
    if not len(rows):
        return Crf.untrained()
    # Spark gives the rows in an order that may change; sums over them must not
    rows = rows.sort_values("w", key=lambda s: s.map(str), kind="stable")
    tags = np.array(rows["t"].tolist())
    if not (tags == B).any():
        return Crf.untrained()
    return Crf.train(np.array(rows["w"].tolist()), tags, np.array(rows["f"].tolist()))


def all_spans(text: str, decoder: Decoder, classes: TokenClasses) -> list[tuple[int, int, int]]:
    """Base spans and what the model's spans cover beyond them."""
    spans = base_spans(text)
    c, file = tokenise(text, classes)
    tags = decoder.tags(c, file) if len(c) else {}
    if tags:
        places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        found: list[list[int]] = []
        for k in sorted(tags):
            if tags[k] == I and found and found[-1][2] == k - 1:
                found[-1][1:] = [places[k][1], k]
            else:
                found.append([*places[k], k])
        taken = list(spans)
        for a, b, _ in found:
            if b - a >= MIN_CRF_CHARS and any(x.isdigit() for x in text[a:b]):
                spans += [(s, 3, e) for s, e in _beyond(text, a, b, taken)]
    return sorted(spans)


def _beyond(text: str, a: int, b: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of ``a..b`` outside the sorted spans ``taken`` that hold a letter or digit, without white space around."""
    out = []
    for s, e in [*((s, e) for s, _, e in taken if s < b and e > a), (b, b)]:
        part = text[a:s]
        if any(x.isalnum() for x in part):
            out.append((a + len(part) - len(part.lstrip()), a + len(part.rstrip())))
        a = max(a, e)
    return out


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan_column(model: Crf, text_col: str = "text") -> Column:
    """``struct<redacted, spans>`` of each row's text; start and end count code
    points, the end is exclusive. Only the text goes to Python."""

    @F.pandas_udf(f"redacted string, spans {SPANS}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder, classes = model.decoder(), TokenClasses()
        for texts in batches:
            texts = [t if isinstance(t, str) else "" for t in texts]
            spans = [all_spans(t, decoder, classes) for t in texts]
            yield pd.DataFrame({"redacted": [redact(t, s) if s else t for t, s in zip(texts, spans)],
                                "spans": [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in spans]})

    return run(F.col(text_col))


def scan(docs: DataFrame, model: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``id_col, redacted, spans``."""
    model = model or train(docs, id_col, text_col)
    return docs.select(F.col(id_col), scan_column(model, text_col).alias("scan")).select(id_col, "scan.*")


def redact_documents(docs: DataFrame, model: Crf | None = None, id_col: str = "doc_id", text_col: str = "text",
                     length_col: str = "n_chars") -> DataFrame:
    """All rows of ``docs``; secrets in their texts are replaced by a mark, and the length column follows."""
    model = model or train(docs, id_col, text_col)
    d = docs.select(F.struct(*docs.columns).alias("row"), scan_column(model, text_col).alias("scan"))
    found = F.size("scan.spans") > 0
    text = F.when(found, F.col("scan.redacted")).otherwise(F.col("row")[text_col])
    new = {text_col: text}
    if length_col in docs.columns:
        new[length_col] = F.when(found, F.length("scan.redacted").cast(docs.schema[length_col].dataType)) \
            .otherwise(F.col("row")[length_col])
    return d.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    runs: list[list[int]] = []
    for a, _, b in sorted(spans):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of the scan: counts and joined spans."""
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    joined = lambda c: F.array_join(F.transform(
        c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(F.col(id_col), *[count(k).alias(f"n_{k}") for k in KINDS],
                          F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

