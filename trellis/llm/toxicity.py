"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers are composed into one machine that reads a clause word
by word. The lexicon transducer rewrites a word as a symbol with a weight
(insult, threat, target, negation, reported speech, other); the negation, report
and target transducers then mark each insult or threat by what stands before it in
its clause: inside the scope of a negation, inside reported speech, near a target.
What the composed machine puts out for a clause is one weighted mark per insult
or threat, and the clause scores the sum of its marks, each scaled by the weight
of its kind. A document's score is the logistic function of its clauses' scores.

Insults and their weights are learned: of the words and word stems (the first
``STEM`` bytes) of a bounded sample of labelled training documents those count whose
log-odds for toxic documents are well above 0 (lower confidence bound); a word that
is not in the lexicon itself goes by its longest stem there. The weights of the marks come from a
logistic fit on the same sample. Targets, negations, report verbs and threats are
short fixed lists.

Scale: one map over the documents; the model (lexicon of at most ``MAX_LEXICON``
words, 16 mark weights) travels in the closure. The sample is at most about
``TRAIN_DOCS`` documents; word counts are summed in the tasks before the shuffle.

Edge cases: null and empty texts have no clauses and get the score of a
document without hits; repeated rows are scored alike; labels without id or class
are left out; without both classes among the labels every score is the share of
toxic labels (0 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import label_sample

TRAIN_DOCS = 20_000
MAX_LEXICON = 20_000
LEAST_BOUND = 1.0
STEM = (6, 5, 4)

# Closed word classes of the grammar, in English, German, French, Spanish.
TARGETS = "you your yours he she they him them du dich dein ihr euch sie tu toi vous ton votre usted vosotros tus ellos"
NEGATIONS = "not no never nor neither without nicht kein keine nie niemals ohne pas jamais aucun sans nunca ni tampoco sin"
REPORTS = "said says claimed wrote quoted reported alleged sagte schrieb behauptete dit a-t-il prétend dijo escribió afirmó"
THREATS = "kill hurt destroy beat shoot burn töten schlagen zerstören tuer frapper brûler matar golpear quemar"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: output symbols: (insult or threat) x negated x reported x targeted
MARKS = 16
NEGATION_SCOPE = 4
TARGET_SCOPE = 4

_CLAUSE = re.compile(rb"[.,;:!?()\n]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b in b".,;:!?()\n" else 32
               for b in range(256))
_WORDS = bytes(32 if b in b".,;:!?()\n" else b for b in range(256))


class Transducer:
    """Deterministic: ``step(state, symbol) -> (state, symbol)``, a table over a
    finite set of states; state 0 starts a clause."""

    def __init__(self, table: dict[tuple[int, int], tuple[int, int]]):
        self.table = table

    @classmethod
    def flag(cls, symbols: list[int], raises: int, marks: dict[int, int], scope: int | None) -> Transducer:
        """Rewrites the symbols in ``marks`` while the flag is up: symbol
        ``raises`` raises it for ``scope`` symbols (None: to the end of the clause)."""
        table = {}
        top = scope or 1
        for state in range(top + 1):
            for s in symbols:
                left = top if s == raises else state if scope is None else max(0, state - 1)
                table[state, s] = (left, marks.get(s, s) if state else s)
        return cls(table)

    def compose(self, after: Transducer) -> Transducer:
        """First ``self``, then ``after`` on its output; pairs of states are numbered as they are reached."""
        number, todo, table = {(0, 0): 0}, [(0, 0)], {}
        symbols = {s for _, s in self.table}
        while todo:
            pair = todo.pop()
            for s in symbols:
                a, mid = self.table[pair[0], s]
                b, out = after.table[pair[1], mid]
                if (a, b) not in number:
                    number[a, b] = len(number)
                    todo.append((a, b))
                table[number[pair], s] = (number[a, b], out)
        return Transducer(table)


def grammar() -> Transducer:
    """Negation, report and target transducers, composed. An insult leaves as mark
    ``100 + 4 neg + 2 rep + tgt``, a threat as ``108 + ...``."""
    plain = list(range(6))
    # open the marks: an insult is mark 100, a threat mark 108
    opened = Transducer({(0, s): (0, {INSULT: 100, THREAT: 108}.get(s, s)) for s in plain})
    marks = [*plain, *range(100, 100 + MARKS)]
    bit = lambda k: {m: m | k if (m - 100) & k == 0 else m for m in range(100, 100 + MARKS)}
    add = lambda k: {m: 100 + ((m - 100) | k) for m in bit(k)}
    neg = Transducer.flag(marks, NEGATION, add(4), NEGATION_SCOPE)
    rep = Transducer.flag(marks, REPORT, add(2), None)
    tgt = Transducer.flag(marks, TARGET, add(1), TARGET_SCOPE)
    return opened.compose(neg).compose(rep).compose(tgt)


def closed_classes() -> dict[bytes, tuple[int, float]]:
    lex = {}
    for words, symbol in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)):
        lex.update({w.encode(): (symbol, 1.0) for w in words.split()})
    return lex


def clauses(text: str | None) -> list[list[bytes]]:
    low = (text or "").encode("utf-8", "replace").translate(_LOWER)
    return [c.split() for c in _CLAUSE.split(low)]


def text_words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "replace").translate(_LOWER).translate(_WORDS).split())


def with_stems(words: set[bytes]) -> set[bytes]:
    """The words and their stems; a stem ends in ``*``."""
    return words | {w[:k] + b"*" for w in words for k in STEM if len(w) > k}


class Grammar:
    """Lexicon transducer with the composed clause grammar."""

    def __init__(self, insults: dict[bytes, float]):
        self.lexicon = closed_classes()
        # a learned word that is also in a closed class stays a threat, else becomes an insult
        for w, v in insults.items():
            self.lexicon[w] = (THREAT, v) if self.lexicon.get(w, (0,))[0] == THREAT else (INSULT, v)
        self.hits = frozenset(w for w, (s, _) in self.lexicon.items() if s in (INSULT, THREAT))
        self.stems = frozenset(w[:-1] for w in self.hits if w.endswith(b"*"))
        self.table = grammar().table

    def look_up(self, word: bytes) -> tuple[int, float]:
        """Lexicon transducer: symbol and weight of a word."""
        found = self.lexicon.get(word)
        if found is None and self.stems:
            found = next((self.lexicon[word[:k] + b"*"] for k in STEM if len(word) > k and word[:k] in self.stems), None)
        return found or (OTHER, 0.0)

    def may_hit(self, words: set[bytes]) -> bool:
        return not self.hits.isdisjoint(words) or not self.stems.isdisjoint({w[:k] for w in words for k in STEM})

    def clause_marks(self, words: list[bytes]) -> list[tuple[int, float]]:
        """What the machine puts out for a clause: ``(mark, weight)``."""
        state, out, table = 0, [], self.table
        for w in words:
            symbol, weight = self.look_up(w)
            state, put = table[state, symbol]
            if put >= 100:
                out.append((put - 100, weight))
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Sums of weights by mark, the heaviest clause, and the log of the number of scored clauses."""
        x = np.zeros(MARKS + 2)
        if not self.may_hit(text_words(text)):
            return x
        for c in clauses(text):
            marks = self.clause_marks(c)
            for m, v in marks:
                x[m] += v
            if marks:
                x[MARKS] = max(x[MARKS], sum(v for _, v in marks))
                x[MARKS + 1] += 1
        x[MARKS + 1] = np.log1p(x[MARKS + 1])
        return x


class Model:
    def __init__(self, grammar_: Grammar, weights: np.ndarray, bias: float):
        self.grammar, self.weights, self.bias = grammar_, weights, bias

    def score(self, text: str | None) -> float:
        z = float(self.grammar.features(text) @ self.weights) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge; columns are scaled by their root mean square."""
    scale = np.sqrt((x * x).mean(0)) + 1e-9
    z = np.concatenate([x / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], l2 * len(x) / 100 + 1e-3)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * w
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1])


def learn_insults(sample: DataFrame, n_pos: int, n_neg: int) -> dict[bytes, float]:
    """Words of toxic documents with the lower bound of their log-odds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pos, neg = Counter(), Counter()
            for text, y in zip(pdf["text"], pdf["_y"]):
                (pos if y else neg).update(with_stems(text_words(text)))
            both = set(pos) | set(neg)
            yield pd.DataFrame({"w": list(both), "p": [pos[w] for w in both], "n": [neg[w] for w in both]})

    seen = sample.select("text", "_y").mapInPandas(count, "w binary, p long, n long") \
        .groupBy("w").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("p >= 3")
    odds = F.log((F.col("p") + 0.5) / (n_pos + 1.0)) - F.log((F.col("n") + 0.5) / (n_neg + 1.0))
    bound = odds - 2.0 * F.sqrt(1.0 / (F.col("p") + 0.5) + 1.0 / (F.col("n") + 0.5))
    rows = seen.select("w", bound.alias("v")).where(F.col("v") >= LEAST_BOUND) \
        .orderBy(F.desc("v"), "w").limit(MAX_LEXICON).collect()
    return {bytes(r.w): float(r.v) for r in rows}


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text",
          label: str = "toxic", bound: int = TRAIN_DOCS) -> Model:
    """Learn from at most about ``bound`` labelled rows that fulfil ``train_rows`` (a condition on ``_id``)."""
    ids = label_sample(labels, label, id_col, train_rows, bound)
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .join(F.broadcast(ids), "_id")  # at most about ``bound`` rows
    counts = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    if not n_pos or not n_neg:
        share = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.0
        return Model(Grammar({}), np.zeros(MARKS + 2), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    g = Grammar(learn_insults(sample, n_pos, n_neg))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [g.features(t).tolist() for t in pdf["text"]], "y": pdf["_y"]})

    rows = sample.select("text", "_y").mapInPandas(features, "x array<double>, y int").toPandas()
    rows = rows.sort_values("x", key=lambda s: s.map(str), kind="stable")
    w, b = fit_logistic(np.array(rows["x"].tolist()), rows["y"].to_numpy(float))
    return Model(g, w, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for every row. Only the text goes to Python."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return docs.select(F.col(id_col), run(F.col(text_col)).alias("score"))
